"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Documents of the same set are one class.
Shingles are put in one order for all: rare ones first, by a count of ``BUCKETS`` counters
over all documents, then by hash. Two sets at the threshold share a shingle among the first
few of that order, their prefixes. Classes with the same prefix and size are one group;
only groups enter the join on prefix shingles, filtered by size and by the position of the
shingle. Prefix shingles that the same groups have are one bucket, with each group's first
position among them, so a long passage in two texts costs as much as a short one. Group pairs that are left are expanded to pairs of members where they meet, and a
parity sketch of at least twice as many bits as a set has shingles refutes pairs there
without an error: sketches differ in no more bits than there are shingles in one set alone.
Sets of up to ``WHOLE`` shingles, where a few bits decide, are carried whole and compared at
once. What remains becomes rows and is verified by the shingles of both texts.

Links come in rounds. In up to ``ROUNDS`` of them each class is verified against the nearest
class of another component in its buckets, by sketch, and against the least one that is
clearly near; the links found are contracted by union-find. The last round compares, without
exception, all that share a prefix shingle and still lie in different components, so a
family of near copies costs few rows and no link is lost. Classes of a bucket that are
neither linked nor told apart by sizes are compared by sketches, which is quadratic in time,
in no rows. A bucket of more than ``SALT`` classes is dealt to several tasks, each of which
has a part against the rest.

Sets and digests rest on 64-bit and 128-bit hashes. Defined results: a null, empty or blank
text has no shingles, is linked with nothing and is its own component; a null doc_id ranks
after all ids, so it names a component only where there is no other; rows that repeat an id
or a text are each returned; an empty table gives an empty result; texts are read whole;
columns but the two named are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialize, read_table, shuffle_partitions
from .components import components

WORDS = 4
PERCENT = 85
#: Counters of shingles, a power of two, and how many of them go in one row.
BUCKETS = 1 << 21
PART = 1 << 15
#: Classes of a bucket that a task holds at a time, and members of a group in one row.
SALT = 2000
CHUNK_MEMBERS = 64
#: Rounds that contract what is nearest before all is compared, and one in how many shingles they look at.
ROUNDS = 2
NEAREST_OF = 4
#: Sets of up to this size are carried whole, at 32 bits a shingle.
WHOLE = 150
#: Words whose hashes a task keeps at a time, and shingles that it counts at a time.
MEMO = 1 << 20
CHUNK = 1 << 20

_U64 = np.uint64
_MULTIPLIER = _U64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word; emptied when it has grown to ``MEMO``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def shingles(text: bytes, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; fewer words are one shingle, none give none."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, split), dtype=np.uint64, count=len(split))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * _MULTIPLIER + w[i : len(w) - k + 1 + i]
    return np.unique(_scrambled(h))


def prefix_size(n: int, percent: int) -> int:
    """Shingles among which a set of ``n`` meets any set that it is linked with."""
    return n - -(-n * percent // 100) + 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _tally(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, size = _Hashes(), np.zeros(BUCKETS, dtype=np.int32), [], 0

        def count():
            at, n = np.unique(_bucket(np.concatenate(held)), return_counts=True)
            counts[at] += n.astype(np.int32)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, hashes, words))
                size += len(held[-1])
                if size >= CHUNK:
                    count()
                    held, size = [], 0
        if held:
            count()
        # A task's count of a byte's range is exact; what is more is common enough wherever it stands.
        small = np.minimum(counts, 255).astype(np.uint8)
        for at in range(0, BUCKETS, PART):
            part = small[at : at + PART]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // PART]), pa.array([part.tobytes()])], names=["part", "counts"])

    return run


def _levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(counts, dtype=np.uint8).astype(np.float32)
            sums[part] = sums[part] + own if part in sums else own
    for part, total in sums.items():
        level = np.round(4 * np.log2(1 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([level.tobytes()])], names=["part", "levels"])


def rarity(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each of ``BUCKETS`` counters how often its shingles occur in all texts(t), as a quarter of a binary logarithm."""
    parts = texts.select("t").mapInArrow(_tally(words), "part long, counts binary").repartition(shuffle_partitions(texts.sparkSession), "part")
    out = np.zeros(BUCKETS, dtype=np.uint8)
    for row in parts.mapInArrow(_levels, "part long, levels binary").collect():
        out[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out


def parity_sketch(h: np.ndarray) -> bytes:
    """One bit for each remainder of the hashes by a power of two, at least twice their number, set where an odd number of them has it."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def whole_set(h: np.ndarray) -> bytes:
    """The upper halves of the hashes, ascending, of sets that are not too large; empty for others."""
    return (h >> _U64(32)).astype(np.uint32).tobytes() if len(h) <= WHOLE else b""


_PRINT = "doc_id long, th long, n long, class binary, group binary, prefix array<long>, sketch binary, whole binary"


def _printed(levels: np.ndarray, words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sizes, classes, groups, prefixes, ends, sketches, wholes = [], [], [], [], [0], [], []
            for text in batch.column(2).to_pylist():
                h = shingles(text, hashes, words)
                sizes.append(len(h))
                prefix = h
                if len(h):
                    prefix = h[np.argsort(levels[_bucket(h)], kind="stable")][: prefix_size(len(h), percent)]
                    classes.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    groups.append(hashlib.blake2b(prefix.tobytes(), digest_size=16, salt=str(len(h)).encode()[:16]).digest())
                    sketches.append(parity_sketch(h))
                    wholes.append(whole_set(h))
                else:
                    for column in (classes, groups, sketches, wholes):
                        column.append(None)
                prefixes.append(prefix)
                ends.append(ends[-1] + len(prefix))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.binary()), lists, pa.array(sketches, pa.binary()), pa.array(wholes, pa.binary())],
                names=[c.split()[0] for c in _PRINT.split(", ")],
            )

    return run


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches on fewer bits: as bits are remainders by a power of two, halves fold onto each other."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


class Bucket:
    """Classes of the groups that a bucket holds, as arrays; ``met`` gives those that a further class may be linked with."""

    def __init__(self, percent: int, prefixes: bool):
        self.percent, self.prefixes = percent, prefixes
        self.rows: list[tuple[int, int, int, list[dict]]] = []

    def close(self) -> None:
        of = [(n, gid, pos, m) for n, gid, pos, members in self.rows for m in members]
        self.n, self.gid, self.pos = (np.array([r[k] for r in of], dtype=np.int64) for k in range(3))
        self.comp = np.array([r[3]["comp"] for r in of], dtype="S16")
        self.names, self.wholes = [r[3]["class"] for r in of], [r[3]["whole"] for r in of]
        words = np.array([len(r[3]["sketch"]) // 8 for r in of])
        self.slot, self.words, self.sketches = np.zeros(len(of), dtype=np.int64), words, {}
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            self.slot[at] = np.arange(len(at))
            self.sketches[w] = np.frombuffer(b"".join(of[i][3]["sketch"] for i in at), dtype=np.uint64).reshape(len(at), w)

    def met(self, n: int, gid: int, pos: int, member: dict, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes (of the first ``upto``) in other components that no filter rules out, bits in which sketches differ, and the most that may."""
        part = slice(0, upto)
        m, p = self.percent, 100 + self.percent
        own = self.n[part]
        least = -(-(own + n) * m // p)
        ok = (100 * np.minimum(own, n) >= m * np.maximum(own, n)) & (self.comp[part] != np.array(member["comp"], dtype="S16"))
        if self.prefixes:
            # The smaller set has the shingle among those that any larger one meets it in.
            index = own - -(-own * (2 * m) // p) + 1
            mine = n - -(-n * (2 * m) // p) + 1
            first = (own < n) | ((own == n) & (self.gid[part] < gid))
            ok &= (self.gid[part] != gid) & (np.minimum(own - self.pos[part], n - pos) >= least) & np.where(first, self.pos[part] < index, pos < mine)
        at = np.flatnonzero(ok)
        found, bits = [at[:0]], [at[:0]]
        sketch = np.frombuffer(member["sketch"], dtype=np.uint64)
        for w in np.unique(self.words[at]).tolist():
            of = at[self.words[at] == w]
            words = min(w, len(sketch))
            apart = np.bitwise_count(_folded(self.sketches[w][self.slot[of]], words) ^ _folded(sketch, words)).sum(axis=1).astype(np.int64)
            near = apart <= own[of] + n - 2 * least[of]
            found.append(of[near])
            bits.append(apart[near])
        of, apart = np.concatenate(found), np.concatenate(bits)
        if member["whole"] and len(of):
            of, apart = self._by_sets(of, apart, np.frombuffer(member["whole"], dtype=np.uint32), least)
        return of, apart, own[of] + n - 2 * least[of]

    def _by_sets(self, of: np.ndarray, apart: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without those whose sets, where they are whole, have too few shingles in common."""
        sets = [np.frombuffer(self.wholes[i], dtype=np.uint32) for i in of.tolist()]
        sizes = np.array([len(x) for x in sets])
        there = np.flatnonzero(sizes)
        if not len(there):
            return of, apart
        flat = np.concatenate([sets[i] for i in there])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes[there]) - sizes[there])
        stays = np.ones(len(of), dtype=bool)
        stays[there] = common >= least[of[there]]
        return of[stays], apart[stays]


class _Every:
    """All pairs that a bucket leaves: a, b."""

    schema = "a binary, b binary"

    def __init__(self):
        self.a, self.b = [], []

    def meet(self, bucket: Bucket, name: bytes, of: np.ndarray, apart: np.ndarray, most: np.ndarray) -> None:
        for i in of.tolist():
            self.a.append(min(name, bucket.names[i]))
            self.b.append(max(name, bucket.names[i]))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.a, pa.binary()), pa.array(self.b, pa.binary())], names=["a", "b"])
        self.a, self.b = [], []
        return out


class _Best:
    """Of each class the nearest one a bucket leaves, and the least of those that are clearly near: a, apart, near, clear."""

    schema = "a binary, apart long, near binary, clear binary"

    def __init__(self):
        self.best: dict[bytes, list] = {}

    def _offer(self, name: bytes, other: bytes, apart: int, clear: bool) -> None:
        held = self.best.setdefault(name, [apart, other, None])
        if (apart, other) < (held[0], held[1]):
            held[:2] = apart, other
        if clear and (held[2] is None or other < held[2]):
            held[2] = other

    def meet(self, bucket: Bucket, name: bytes, of: np.ndarray, apart: np.ndarray, most: np.ndarray) -> None:
        for i, bits, clear in zip(of.tolist(), apart.tolist(), (4 * apart <= 3 * most).tolist(), strict=True):
            self._offer(name, bucket.names[i], bits, clear)
            self._offer(bucket.names[i], name, bits, clear)

    def batch(self) -> pa.RecordBatch:
        kept = list(self.best.items())
        columns = [[k for k, _ in kept], *([v[j] for _, v in kept] for j in range(3))]
        self.best = {}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["a", "apart", "near", "clear"])


def _compared(percent: int, told: type):
    """Rows (prefixes, key, salt, streamed, n, gid, pos, members), sorted by the first four: what ``told`` says of the pairs that no filter rules out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bucket, closed, out = None, None, False, told()

        def close():
            nonlocal closed
            bucket.close()
            closed, at = True, 0
            for n, gid, pos, members in bucket.rows:
                for m in members:
                    if at:
                        out.meet(bucket, m["class"], *bucket.met(n, gid, pos, m, at))
                    at += 1

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for prefixes, key, salt, streamed, n, gid, pos, members in zip(*columns, strict=True):
                if (prefixes, key, salt) != name:
                    if bucket and not closed:
                        close()
                    name, bucket, closed = (prefixes, key, salt), Bucket(percent, prefixes), False
                if not streamed:
                    bucket.rows.append((n, gid, pos, members))
                    continue
                if not closed:
                    close()
                if bucket.rows:
                    for m in members:
                        out.meet(bucket, m["class"], *bucket.met(n, gid, pos, m))
            yield out.batch()
        if bucket and not closed:
            close()
        yield out.batch()

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                found = [shingles(t, hashes, words).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["th", "set"])

    return run


def _side(classes: DataFrame, end: str, *columns: str) -> DataFrame:
    return classes.select(F.col("class").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """pairs(a, b) of classes -> those that are linked by their texts, written."""
    left = materialize(pairs, f"{label}-left")
    at = materialize(left.join(_side(classes, "a", "th"), "a").join(_side(classes, "b", "th"), "b"), f"{label}-at")
    wanted = materialize(at.select(F.explode(F.array("th_a", "th_b")).alias("th")).distinct(), f"{label}-wanted")
    found = texts.join(F.broadcast(wanted) if wanted.count() * 32 <= BROADCAST_BYTES else wanted, "th", "left_semi")
    sets = materialize(found.dropDuplicates(["th"]).select("th", "t").mapInArrow(_sets(words), "th long, set array<long>"), f"{label}-sets")
    one = lambda end: sets.select(F.col("th").alias(f"th_{end}"), F.col("set").alias(f"set_{end}"))
    both = at.join(one("a"), "th_a").join(one("b"), "th_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = both.filter(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")
    out = materialize(links.distinct(), f"{label}-links")
    discard(left, at, wanted, sets)
    return out


def _buckets(shared: DataFrame, members: DataFrame, percent: int, told: type) -> DataFrame:
    """What ``told`` says of members(gid, class, comp, n, sketch, whole) in different components that no filter rules out, bucket by bucket.

    A bucket is a prefix shingle with the groups that have it, or a group of several
    components. Tasks hold at most about ``SALT`` classes of a bucket; what a bucket has beyond
    goes to further parts of it, and is shown to each part before. Pairs that are ruled out
    never become rows.
    """
    spark = members.sparkSession
    spans = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
    spans = materialize(spans, "ngram-spans")
    placed = shared.select("token", "gid", "n", "pos").join(spans, "gid")
    salts = F.ceil(F.sum("size") / SALT).cast("int").alias("salts")
    opened = placed.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), salts).filter("least <> most").select("token", "salts")
    held = materialize(placed.join(opened, "token").select(F.lit(True).alias("prefixes"), F.col("token").alias("key"), "gid", "pos", "salts"), "ngram-open")
    mixed = spans.filter("lo <> hi").select(F.lit(False).alias("prefixes"), F.col("gid").alias("key"), "gid", F.lit(0).alias("pos"), F.ceil(F.col("size") / SALT).cast("int").alias("salts"))
    rows = held.unionByName(mixed)
    # Members of a group come in chunks, so no row grows with its group.
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / CHUNK_MEMBERS)).alias("part")
    asked = members.join(spans.select("gid", "size"), "gid").join(rows.select("gid").distinct(), "gid", "left_semi")
    chunks = asked.groupBy("gid", part).agg(F.first("n").alias("n"), F.collect_list(F.struct("class", "comp", "sketch", "whole")).alias("members"))
    own = F.pmod(F.xxhash64("gid", "part"), F.col("salts")).cast("int")
    dealt = rows.join(chunks, "gid").withColumn("own", own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("streamed", F.col("salt") != F.col("own"))
    columns = ["prefixes", "key", "salt", "streamed"]
    ordered = dealt.select(*columns, "n", "gid", "pos", "members").repartition(shuffle_partitions(spark), *columns[:3]).sortWithinPartitions(*columns)
    return ordered.mapInArrow(_compared(percent, told), told.schema)


def _shared(groups: DataFrame) -> DataFrame:
    """groups(gid, n, prefix) -> buckets of several groups: token, gid, n, pos, some.

    A bucket is named by a hash over the groups that have a shingle. Names that collide
    join their buckets, and the first position passes any filter that a later one does, so
    no pair is lost. ``some`` marks the buckets with one of the shingles that rounds look at.
    """
    bucket = Window.partitionBy("shingle")
    rows = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "shingle"))
    named = rows.withColumns({"held": F.count(F.lit(1)).over(bucket), "token": F.bit_xor(F.xxhash64("gid")).over(bucket)}).filter("held > 1")
    some = F.pmod(F.xxhash64("shingle"), F.lit(NEAREST_OF)) == 0
    return named.groupBy("token", "gid").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.bool_or(some).alias("some"))


def _nearest(shared: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Each class with the nearest in another component, and with the least that is clearly near, over a part of the shingles.

    What this part of the shingles misses is left to the round that takes all.
    """
    best = _buckets(shared.filter("some"), members, percent, _Best).groupBy("a").agg(F.min(F.struct("apart", "near")).alias("best"), F.min("clear").alias("clear"))
    pairs = best.select("a", F.explode(F.array_compact(F.array("best.near", "clear"))).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.cast("binary").alias("t"))
    levels = rarity(texts, words)
    prints = materialize(texts.mapInArrow(_printed(levels, words, percent), _PRINT), "ngram-prints")
    rows = materialize(prints.select("doc_id", "n", "class"), "ngram-rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    of_class = [F.min(place).alias("best"), F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("n", "group", "prefix", "sketch", "whole")]]
    classes = materialize(prints.filter("n > 0").groupBy("class").agg(*of_class).withColumn("gid", F.xxhash64("group")), "ngram-classes")
    discard(prints)
    plain = materialize(classes.select("class", "gid", "n", "th", "sketch", "whole", "best"), "ngram-plain")
    # Groups whose short names collide are compared as one, which adds pairs and loses none.
    groups = materialize(classes.groupBy("group").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "ngram-groups")
    discard(classes)
    shared = materialize(_shared(groups), "ngram-shared")
    discard(groups)
    of = lambda r: plain.join(r.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("comp", F.coalesce("root", "class"))
    links, roots, moved = None, None, True
    members = materialize(plain.select("gid", "class", F.col("class").alias("comp"), "n", "sketch", "whole"), "ngram-members")
    # The last round takes all; those before it stop once they find nothing.
    for told in [_Best] * ROUNDS + [_Every]:
        if told is _Best and not moved:
            continue
        pairs = _nearest(shared, members, percent) if told is _Best else _buckets(shared, members, percent, _Every).distinct()
        found = _linked(pairs, plain, texts, words, percent, "ngram-round")
        moved = not found.isEmpty()
        if moved:
            links = found if links is None else links.unionByName(found)
            discard(roots, members)
            roots = components(links, "ngram")
            members = materialize(of(roots).select("gid", "class", "comp", "n", "sketch", "whole"), "ngram-members")
    roots = roots if roots is not None else spark.createDataFrame([], "node binary, root binary")
    discard(shared, members)
    placed = of(roots).select("class", "comp", "best")
    least = placed.groupBy("comp").agg(F.min("best.no_id").alias("no_id"), F.min("best.doc_id").alias("component"))
    named = materialize(placed.join(least, "comp").select("class", "component"), "ngram-named")
    discard(roots, plain)
    out = rows.join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return similar(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS sh FROM d
), e AS (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(s.doc_id) AS component_id FROM r JOIN s ON s.rid = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.rid = s.rid
"""
