"""Exact dedup with a sharded cuckoo-filter index over text digests.

Digests are dealt to shards by their leading bits. A shard holds a cuckoo filter
(16-bit fingerprints, buckets of four) and, bucketed by the same rule, the full keys.
A filter miss proves that a digest is new; a hit is verified against the stored key
(SHA-256 and byte length). When an insertion runs out of kicks the filter is rebuilt at
twice the size from the stored keys. Before the shuffle every Arrow batch is folded to
one row a digest, so a text that fills a third of the corpus reaches its shard as one
row per batch. A task holds one shard at a time.

Defined results: a null text counts as the empty text; a null id ranks below every id;
of rows that repeat both id and text exactly one stays; an empty table gives an empty
result; columns but the two named are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, read_table, reading, shuffle_partitions, text_or_empty

SLOTS = 4
MAX_KICKS = 256
#: Digests that a shard is meant to hold; the number of shards follows the input.
SHARD_ROWS = 400_000


class CuckooFilter:
    """Membership with deletion: ``SLOTS`` fingerprints a bucket, two buckets a key."""

    def __init__(self, capacity: int = 1024) -> None:
        n = 1
        while n * SLOTS * 0.9 < max(capacity, 1):
            n *= 2
        self.mask = n - 1
        self.table = np.zeros((n, SLOTS), dtype=np.uint16)
        self.count = 0

    @staticmethod
    def address(digest: bytes) -> tuple[int, int]:
        """(hash, fingerprint) of a digest; fingerprint 0 marks an empty slot."""
        return int.from_bytes(digest[4:12], "little"), int.from_bytes(digest[12:14], "little") or 1

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995 >> 3)) & self.mask

    def contains(self, digest: bytes) -> bool:
        h, fp = self.address(digest)
        i = h & self.mask
        return fp in self.table[i].tolist() or fp in self.table[self._other(i, fp)].tolist()

    def insert(self, digest: bytes) -> bool:
        """False when no slot was found; the filter then has to be rebuilt."""
        h, fp = self.address(digest)
        i = h & self.mask
        for b in (i, self._other(i, fp)):
            row = self.table[b].tolist()
            if 0 in row:
                self.table[b, row.index(0)] = fp
                self.count += 1
                return True
        for kick in range(MAX_KICKS):
            slot = (kick + fp) % SLOTS
            fp, self.table[b, slot] = int(self.table[b, slot]), fp
            b = self._other(b, fp)
            row = self.table[b].tolist()
            if 0 in row:
                self.table[b, row.index(0)] = fp
                self.count += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        h, fp = self.address(digest)
        i = h & self.mask
        for b in (i, self._other(i, fp)):
            row = self.table[b].tolist()
            if fp in row:
                self.table[b, row.index(fp)] = 0
                self.count -= 1
                return True
        return False


class CuckooIndex:
    """One shard: the filter and the bucketed keys that hits are verified against.

    ``content`` maps a bucket (leading digest bytes) to {(digest, n_bytes): payload}.
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, dict] = {}
        self.false_hits = 0
        self.resizes = 0

    def __len__(self) -> int:
        return self.filter.count

    def get(self, digest: bytes, n_bytes: int):
        """The payload of a live digest, else None. A filter hit is never trusted unverified."""
        if not self.filter.contains(digest):
            return None
        found = self.content.get(digest[:3], {}).get((digest, n_bytes))
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, n_bytes: int, payload) -> None:
        """Add a digest that is not live."""
        self.content.setdefault(digest[:3], {})[digest, n_bytes] = payload
        if not self.filter.insert(digest):
            self._resize()

    def update(self, digest: bytes, n_bytes: int, payload) -> None:
        self.content[digest[:3]][digest, n_bytes] = payload

    def delete(self, digest: bytes, n_bytes: int) -> bool:
        """Remove a live digest from filter and keys; a digest that is not live changes nothing."""
        if self.get(digest, n_bytes) is None:
            return False
        bucket = self.content[digest[:3]]
        del bucket[digest, n_bytes]
        if not bucket:
            del self.content[digest[:3]]
        return self.filter.delete(digest)

    def items(self) -> Iterator[tuple[bytes, int, object]]:
        for bucket in self.content.values():
            for (digest, n), payload in bucket.items():
                yield digest, n, payload

    def _resize(self) -> None:
        size = (self.filter.mask + 1) * 2
        while True:
            self.resizes += 1
            fresh = CuckooFilter(int(size * SLOTS * 0.9))
            if all(fresh.insert(d) for d, _, _ in self.items()):
                self.filter = fresh
                return
            size *= 2


def shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:4], "big") % shards


def with_digest(docs: DataFrame, text_col: str, digest: str = "digest", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the digest (32 bytes) and the length of the text, null as empty, under names that ``docs`` must not have."""
    t = text_or_empty(text_col)
    return docs.withColumns({digest: F.unhex(F.sha2(t, 256)), n_bytes: F.octet_length(t).cast("long")})


_FOLDED = "shard int, digest binary, n_bytes long, keep_id long, keep_rid long, n long"
_GROUPS = "digest binary, n_bytes long, keep_id long, keep_rid long, group_size long"


def _better(a: tuple, b: tuple) -> tuple:
    """Of (id, rid): the larger id, null last; then the smaller rid."""
    ka, kb = ((x[0] is not None, x[0] or 0, -x[1]) for x in (a, b))
    return a if ka >= kb else b


def _fold(shards: int):
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list] = {}
            for d, n, i, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = seen.get((d, n))
                if x is None:
                    seen[d, n] = [(i, r), 1]
                else:
                    x[0] = _better(x[0], (i, r))
                    x[1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard_of(d, shards) for d, _ in seen], pa.int32()),
                    pa.array([d for d, _ in seen], pa.binary()),
                    pa.array([n for _, n in seen], pa.int64()),
                    pa.array([x[0][0] for x in seen.values()], pa.int64()),
                    pa.array([x[0][1] for x in seen.values()], pa.int64()),
                    pa.array([x[1] for x in seen.values()], pa.int64()),
                ],
                names=["shard", "digest", "n_bytes", "keep_id", "keep_rid", "n"],
            )

    return fold


def _index_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard."""

    def rows_of(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        rows = list(index.items())
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in part], pa.binary()),
                    pa.array([x[1] for x in part], pa.int64()),
                    pa.array([x[2][0][0] for x in part], pa.int64()),
                    pa.array([x[2][0][1] for x in part], pa.int64()),
                    pa.array([x[2][1] for x in part], pa.int64()),
                ],
                names=["digest", "n_bytes", "keep_id", "keep_rid", "group_size"],
            )

    shard, index = None, CuckooIndex()
    for b in batches:
        for s, d, n_bytes, i, r, n in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if s != shard:
                yield from rows_of(index)
                shard, index = s, CuckooIndex()
            found = index.get(d, n_bytes)
            if found is None:
                index.insert(d, n_bytes, ((i, r), n))
            else:
                index.update(d, n_bytes, (_better(found[0], (i, r)), found[1] + n))
    yield from rows_of(index)


def group_digests(keys: DataFrame, n_rows: int) -> DataFrame:
    """keys(digest, n_bytes, doc_id, rid) -> one row a digest, through the cuckoo shards."""
    shards = max(shuffle_partitions(keys.sparkSession), -(-n_rows // SHARD_ROWS))
    return (
        keys.select("digest", "n_bytes", "doc_id", "rid")
        .mapInArrow(_fold(shards), _FOLDED)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_index_shards, _GROUPS)
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = materialize(with_digest(texts, "text").drop("text").withColumn("rid", F.monotonically_increasing_id()), "exact-keys")
    groups = group_digests(keys, keys.count()).filter("group_size > 1")
    joined = keys.join(groups, ["digest", "n_bytes"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``decide`` drops; columns as they came."""
    digest, n_bytes, gone_id, gone_digest = fresh(docs, "text_digest", "text_bytes", "gone_id", "gone_digest")
    decided = materialize(decide(docs, id_col, text_col).filter("group_size > 1"), "exact-decided")
    keepers = decided.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
    of_keeper = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    dropped = decided.filter("not kept")
    gone = dropped.join(keepers, of_keeper, "left_anti").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    kept = with_digest(docs, text_col, digest, n_bytes).drop(n_bytes).join(
        gone, (F.col(digest) == F.col(gone_digest)) & F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)), "left_anti"
    )
    # What is left of a group is its keeper and rows that repeat the keeper's id and text.
    again = dropped.join(keepers, of_keeper, "left_semi").select(F.col("digest").alias(gone_digest)).distinct()
    if not again.isEmpty():
        repeated = F.col(digest) == F.col(gone_digest)
        once = kept.join(again, repeated, "left_semi").dropDuplicates([digest])
        kept = kept.join(again, repeated, "left_anti").unionByName(once)
    return reading(kept.drop(digest), decided)


# --- the stored index -------------------------------------------------------------------

_ENTRY = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("refs", T.LongType()),
])


class StoredIndex:
    """A cuckoo index kept as a table of live keys (shard, digest, n_bytes, refs) in the shared folder.

    ``insert`` and ``delete`` take frames of texts, apply them shard by shard through
    ``CuckooIndex`` and return a new index; ``lookup`` flags the rows whose text is live.
    Deleting a text that is not live changes nothing; refs count how often a text is held.
    """

    def __init__(self, entries: DataFrame, shards: int) -> None:
        self.entries, self.shards = entries, shards

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 16) -> StoredIndex:
        return cls(spark.createDataFrame([], _ENTRY), shards)

    def _shard(self) -> Column:
        return (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % self.shards).cast("int").alias("shard")

    def _keys(self, texts: DataFrame, text_col: str, sign: int) -> DataFrame:
        keyed = with_digest(texts.select(F.col(text_col).alias("text")), "text")
        counted = keyed.groupBy("digest", "n_bytes").agg((F.count(F.lit(1)) * sign).alias("refs"))
        return counted.select(self._shard(), "digest", "n_bytes", "refs", F.lit(1).alias("step"))

    def _by_shard(self, changes: DataFrame) -> DataFrame:
        """Entries, then changes, shard by shard."""
        both = self.entries.withColumn("step", F.lit(0)).unionByName(changes)
        return both.repartition(self.shards, "shard").sortWithinPartitions("shard", "step")

    def _apply(self, changes: DataFrame) -> StoredIndex:
        def rows_of(shard: int | None, index: CuckooIndex) -> pa.RecordBatch:
            rows = list(index.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())],
                names=["shard", "digest", "n_bytes", "refs"],
            )

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, index = None, CuckooIndex()
            for b in batches:
                for s, d, n, refs, _ in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if s != shard:
                        yield rows_of(shard, index)
                        shard, index = s, CuckooIndex()
                    held = index.get(d, n)
                    left = (held or 0) + refs
                    if held is None and left > 0:
                        index.insert(d, n, left)
                    elif held is not None and left > 0:
                        index.update(d, n, left)
                    elif held is not None:
                        index.delete(d, n)
            yield rows_of(shard, index)

        return StoredIndex(materialize(self._by_shard(changes).mapInArrow(run, _ENTRY), "cuckoo-index"), self.shards)

    def insert(self, texts: DataFrame, text_col: str = "text") -> StoredIndex:
        return self._apply(self._keys(texts, text_col, 1))

    def delete(self, texts: DataFrame, text_col: str = "text") -> StoredIndex:
        return self._apply(self._keys(texts, text_col, -1))

    def lookup(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """``texts`` with a boolean column ``is_live``: each distinct text is asked of its shard's filter, hits are verified."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, index = None, CuckooIndex()
            for b in batches:
                live = []
                for s, d, n, refs, step in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if s != shard:
                        shard, index = s, CuckooIndex()
                    if step == 0:
                        index.insert(d, n, refs)
                    elif index.get(d, n) is not None:
                        live.append((d, n))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in live], pa.binary()), pa.array([x[1] for x in live], pa.int64())], names=["digest", "n_bytes"])

        digest, n_bytes, live_digest, live_bytes = fresh(texts, "text_digest", "text_bytes", "live_digest", "live_bytes")
        live = self._by_shard(self._keys(texts, text_col, 1)).mapInArrow(run, "digest binary, n_bytes long")
        live = live.select(F.col("digest").alias(live_digest), F.col("n_bytes").alias(live_bytes))
        out = with_digest(texts, text_col, digest, n_bytes).join(live, (F.col(digest) == F.col(live_digest)) & (F.col(n_bytes) == F.col(live_bytes)), "left")
        return out.select(*[F.col(f"`{c}`") for c in texts.columns], F.col(live_digest).isNotNull().alias("is_live"))


def text_sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


# --- query ------------------------------------------------------------------------------

def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each document."""
    return decide(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
