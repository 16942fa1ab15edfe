"""SimHash near-dedup by segment popcounts.

A 64-bit fingerprint is embedded as 32 counts, the set bits of its two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so fingerprints
within 3 bits are within 3 in Manhattan distance, and at least one half of 16 counts is
within 1. The grid has a cell for each half's counts; a fingerprint goes to the cells of
both halves and to those one count higher, so each such pair meets in a cell. There the
Manhattan distance comes first, as a lower bound, and what it leaves is checked exactly. A
cell gives links that span its groups, never all its pairs; a cell of more than ``CELL``
fingerprints is dealt by each of its four 16-bit blocks in turn, one of which any such pair
shares. Only distinct fingerprints enter the grid, so copies cost nothing there.

Defined results: a null or blank text has fingerprint zero and links like any other; a
null id ranks after every id; rows that repeat an id are each returned (or, when
dropping, all but one dropped); an empty table gives an empty result; columns but the two
named are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, read_table, reading, shuffle_partitions
from .components import components

WORDS = 3
SEED = 42
BITS = 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Fingerprints of a cell that are compared with one another as they are.
CELL = 4096


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of ASCII-lower-cased word shingles, unsigned."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, shingles), iter(lambda: seed, None))
    h = np.fromiter(hashes, dtype="<u8", count=max(1, len(w) - words + 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(col):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return run(col)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The 32 counts, two bits each in one word."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            fp = part.column(0).to_numpy().view(np.uint64)
            counts = segment_counts(fp)
            keys, of = [], []
            for half in (0, 1):
                c = (counts >> np.uint64(32 * half)) & low
                tag = np.uint64(half << 32)
                keys.append(c | tag)
                of.append(fp)
                for s in range(16):
                    more = ((c >> np.uint64(2 * s)) & np.uint64(3)) < 2
                    keys.append((c[more] + np.uint64(1 << (2 * s))) | tag)
                    of.append(fp[more])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of).view(np.int64))], names=["cell", "fp"]
            )


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The counts in unary, so that the Manhattan distance of two is the bits in which they differ."""
    odd = np.uint64(0x5555555555555555)
    high = fp >> np.uint64(1)
    return ((fp | high) & odd) | (((fp & high) & odd) << np.uint64(1))


def _spanning(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links of a cell that span its groups."""
    left = np.unique(fps)
    if len(left) <= CELL:
        return _compared(left, bits)
    a, b = [], []
    for block in range(4):
        part = (left >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        order = np.argsort(part, kind="stable")
        for group in np.split(left[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(group) > 1:
                x, y = _compared(group, bits)
                a += x
                b += y
    return a, b


def _compared(left: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Each visited fingerprint takes its neighbours from what is unvisited."""
    a, b = [], []
    counts = unary_counts(left)
    while len(left):
        queue, left, counts = [(left[0], counts[0])], left[1:], counts[1:]
        while queue and len(left):
            at, own = queue.pop()
            near = np.flatnonzero(np.bitwise_count(counts ^ own) <= bits)
            near = near[np.bitwise_count(left[near] ^ at) <= bits]
            if len(near):
                found = left[near]
                queue.extend(zip(found, counts[near], strict=True))
                stays = np.ones(len(left), dtype=bool)
                stays[near] = False
                left, counts = left[stays], counts[stays]
                a.extend([int(at)] * len(found))
                b.extend(found.tolist())
    return a, b


def _verify(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_cell = None

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.uint64).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if held_cell is not None and cell[0] != held_cell:
                yield batch_of(*_spanning(np.concatenate(held), bits))
                held, held_cell = [], None
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            last = starts[-2]
            if held_cell is not None and last == 0:
                held.append(fp)
                continue
            first = 0
            if held_cell is not None:
                yield batch_of(*_spanning(np.concatenate([*held, fp[: starts[1]]]), bits))
                first = 1
            sizes = np.diff(starts)[first:-1]
            begins = starts[first:-2]
            pairs = begins[sizes == 2]
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= bits]
            a, b = fp[near].tolist(), fp[near + 1].tolist()
            for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _spanning(fp[at : at + n], bits)
                a += x
                b += y
            yield batch_of(a, b)
            held, held_cell = [fp[last:]], cell[last]
        if held_cell is not None:
            yield batch_of(*_spanning(np.concatenate(held), bits))

    return run


def link_fingerprints(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps(fp), distinct -> (a, b): verified links that connect whatever is within ``bits`` (at most 3) of each other."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid holds for at most 3 bits")
    n = 2 * shuffle_partitions(fps.sparkSession)
    cells = fps.select("fp").mapInArrow(_cells, "cell long, fp long")
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_verify(bits), "a long, b long")


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """prints(doc_id, rid, fp) -> (fp, keep struct<no_id, doc_id, rid>): the first row of each fingerprint's group."""
    reps = materialize(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best")), "nd-reps")
    roots = components(link_fingerprints(reps, bits), "nd")
    rooted = materialize(
        reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"), "nd-rooted"
    )
    discard(reps, roots)
    best = rooted.groupBy("root").agg(F.min("best").alias("keep"))
    out = materialize(rooted.join(best, "root").select("fp", "keep"), "nd-classes")
    discard(rooted)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row a document: doc_id, fp (signed long), component_id."""
    prints = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")).withColumn("rid", F.monotonically_increasing_id()),
        "nd-prints",
    )
    return prints.join(classes(prints, bits), "fp").select("doc_id", "fp", F.col("keep.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with the row of the smallest id of each group; columns as they came."""
    fp, rid = fresh(docs, "nd_fp", "nd_rid")
    held = materialize(docs.withColumn(fp, _fingerprints(F.col(text_col))).withColumn(rid, F.monotonically_increasing_id()), "nd-docs")
    prints = held.select(F.col(id_col).cast("long").alias("doc_id"), F.col(rid).alias("rid"), F.col(fp).alias("fp"))
    found = classes(prints, bits)
    keep = found.select(F.col("keep.rid").alias(rid)).distinct()
    return reading(held.join(keep, rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]), held, found)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
