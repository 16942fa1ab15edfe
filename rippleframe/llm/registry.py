"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, lexical, lines, mixing, ngram_join, secrets, simhash, token_counts, topk, toxicity, trie, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_topk": topk.op8_topk,
    "op9_secrets": secrets.op9_secrets,
    "op10_warc": warc.op10_warc,
    "op11_bpa": lexical.op11_bpa,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_trie": trie.op13_trie,
}

ORACLES = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op8_topk": topk.OP8_SQL, "op11_bpa": lexical.OP11_SQL, "op12_ngram_join": ngram_join.OP12_SQL, "op13_trie": trie.OP13_SQL}
