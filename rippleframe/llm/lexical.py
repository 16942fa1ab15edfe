"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into terms once; of each document the counts of the queries' terms are
written, with its length. Corpus counts come from that table, over all documents, and turn
a count into an impact. Tasks walk the table in slabs of at most ``SLAB`` postings. A slab
holds one list a term, highest impact first. For a query, the lists are read in step from
the top; each document met is looked up in all the query's lists (direct access), which
gives its whole score and its position in each list. A list's best position ends the run
of positions seen without a gap, by reading or by direct access. No unseen document can
score more than the sum of the impacts just after the best positions, and a slab's search
ends once that sum is strictly below the k-th score so far, so that ties are settled by
id. A task keeps one list of k a query over its slabs; lists of tasks are merged as a tree.

Queries go in blocks whose terms fit ``BROADCAST_BYTES``; nothing of a document reaches the
driver but the counts of the block's terms.

Defined results: a null or empty text has no terms and is not counted; items with the same
id, null too, are one item with the terms of all; rows of documents that repeat are
documents of their own; a null doc_id is ranked after all ids of its score; an item without
terms, or a table without documents, gives no rows; a text is read whole, however long;
columns but the named ones are not read and may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialize, read_table

K = 50
#: Postings that a task holds as impact lists at a time.
SLAB = 1 << 20
#: Positions of each list that are read in a search's first step; the step doubles.
FIRST_STEP = 8
#: Bytes that one term of a block takes in a task's dictionary, beside its own.
TERM_BYTES = 200

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_TERM_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else b if b in _TERM_BYTES else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is beyond ASCII; A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _distinct_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in set(terms_of(text)):
                ids.append(item)
                terms.append(term)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term (binary): each item's terms, once each."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("t")).filter("t IS NOT NULL")
    return texts.mapInArrow(_distinct_terms, "item_id long, term binary").distinct()


def _counted(numbers: dict[bytes, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(map(numbers.get, words))
                found.pop(None, None)
                ids.append(doc)
                sizes.append(len(words))
                for t in sorted(found):
                    terms.append(t)
                    counts.append(found[t])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Slab:
    """Impact lists of some documents: postings in order of document, then term."""

    def __init__(self, lengths: np.ndarray, begin: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray):
        self.size, self.width = len(lengths), len(weight)
        self.doc = np.repeat(np.arange(self.size), np.diff(begin))
        self.impact = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * lengths[self.doc]))
        self.keys = self.doc * self.width + term
        self.order = np.lexsort((self.doc, -self.impact, term))
        self.begin = np.searchsorted(term[self.order], np.arange(self.width + 1))
        self.place = np.empty(len(term), dtype=np.int64)
        self.place[self.order] = np.arange(len(term)) - self.begin[term[self.order]]

    def direct(self, docs: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document and list the posting, and whether there is one."""
        want = docs[:, None] * self.width + lists[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return at, self.keys[at] == want


def best_positions(slab: Slab, terms: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the slab that may be among the k best of it and of ``held`` (scores), and their scores."""
    lists = terms[slab.begin[terms + 1] > slab.begin[terms]]
    begin, size = slab.begin[lists], slab.begin[lists + 1] - slab.begin[lists]
    seen = [np.zeros(n, dtype=bool) for n in size]
    best = np.zeros(len(lists), dtype=np.int64)
    known = np.zeros(slab.size, dtype=bool)
    top, docs, scores = held, [], []
    depth, step = 0, FIRST_STEP
    while True:
        kth = int(top.min()) if len(top) >= k else 1
        open_lists = np.flatnonzero(best < size)
        bound = int(slab.impact[slab.order[begin[open_lists] + best[open_lists]]].sum())
        if bound < max(kth, 1):
            break
        read = [slab.doc[slab.order[b + depth : b + min(depth + step, n)]] for b, n in zip(begin, size, strict=True) if depth < n]
        depth, step = depth + step, step * 2
        new = np.unique(np.concatenate(read))
        new = new[~known[new]]
        known[new] = True
        at, hit = slab.direct(new, lists)
        own = np.where(hit, slab.impact[at], 0).sum(axis=1)
        for j in range(len(lists)):
            seen[j][slab.place[at[hit[:, j], j]]] = True
            rest = seen[j][best[j] :]
            gap = int(rest.argmin()) if len(rest) else 0
            best[j] += gap if len(rest) and not rest[gap] else len(rest)
        docs.append(new)
        scores.append(own)
        top = np.concatenate([top, own])
        if len(top) > k:
            top = np.partition(top, len(top) - k)[len(top) - k :]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, own = np.concatenate(docs), np.concatenate(scores)
    stays = own >= max(int(top.min()) if len(top) >= k else 1, 1)
    return found[stays], own[stays]


def _search(items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        # Score, whether the id is null, id: the best of each item so far.
        lists = [(none, none, none) for _ in items]
        waiting, postings = [], 0

        def search():
            ids = pa.concat_arrays([b.column(0) for b in waiting])
            null, key = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            sizes = np.concatenate([b.column(1).to_numpy() for b in waiting])
            if 50 * int(sizes.max()) * n_docs < 2**63:
                lengths = 50 + 50 * sizes * n_docs // n_terms
            else:
                lengths = np.array([50 + 50 * int(x) * n_docs // n_terms for x in sizes], dtype=np.int64)
            begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in waiting]))])
            term, count = (np.concatenate([b.column(c).flatten().to_numpy() for b in waiting]).astype(np.int64) for c in (2, 3))
            if not len(term):
                return
            slab = Slab(lengths, begin, term, count, weight)
            for i, (_, terms) in enumerate(items):
                held = lists[i]
                docs, own = best_positions(slab, terms, k, held[0])
                if len(docs):
                    score, absent, ident = (np.concatenate(x) for x in zip(held, (own, null[docs], key[docs]), strict=True))
                    order = np.lexsort((ident, absent, -score))[:k]
                    lists[i] = score[order], absent[order], ident[order]

        for batch in batches:
            # A batch of very many postings goes in parts; a part has one row at least.
            ends = batch.column(2).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLAB, side="right")) - 1)
                size = int(ends[upto] - ends[at])
                if waiting and postings + size > SLAB:
                    search()
                    waiting, postings = [], 0
                waiting.append(batch.slice(at, upto - at))
                postings += size
                at = upto
        if waiting:
            search()
        for (item, _), (score, absent, ident) in zip(items, lists, strict=True):
            if len(score):
                ids = pa.array(ident, mask=absent.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), ids, pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: lists of tasks merged in groups, then across groups."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    groups = max(2, math.isqrt(lists.rdd.getNumPartitions()))
    some = lists.withColumn("g", F.spark_partition_id() % groups)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "g").orderBy(*order))).filter(F.col("r") <= k)
    final = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return final.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Lists of one block of items: ``terms`` (item_id, term), whose distinct terms fit a task."""
    numbers: dict[bytes, int] = {}
    of_item: dict[int | None, list[int]] = {}
    for row in terms.toLocalIterator():
        of_item.setdefault(row["item_id"], []).append(numbers.setdefault(bytes(row["term"]), len(numbers)))
    texts = docs.filter("t IS NOT NULL")
    postings = materialize(texts.mapInArrow(_counted(numbers), _POSTINGS), "lexical-postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(max(1, len(numbers)), dtype=np.int64)
    for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in held], dtype=np.int64)
    items = [(item, np.array(sorted(t), dtype=np.int64)) for item, t in of_item.items()]
    lists = postings.mapInArrow(_search(items, weight, n_docs, max(1, n_terms), k), "item_id long, doc_id long, score long")
    out = materialize(_merged(materialize(lists, "lexical-lists"), k), "lexical-ranked")
    discard(postings)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of highest score above 0."""
    spark = docs.sparkSession
    terms = materialize(query_terms(items, item_col, text_col), "lexical-terms")
    size = terms.agg(F.coalesce(F.sum(F.length("term") + TERM_BYTES), F.lit(0))).first()[0]
    blocks = -(-size // BROADCAST_BYTES)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    out = None
    for b in range(blocks):
        ranked = _block(texts, terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k)
        out = ranked if out is None else out.unionByName(ranked)
    discard(terms)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_bpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of each benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_CUT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark)),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
c AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN f ON f.term = q.term JOIN w ON w.term = q.term, s GROUP BY item_id, rid, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM c WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 50
"""
