"""Fuzzy line dedup by MinHash.

Distinct lines are signed over all their character shingles: for each of ``BANDS * ROWS``
masks, the least shingle hash under xor with the mask. Lines that agree in all rows of a
band are candidates. Candidates whose signatures differ in more than ``MOST_APART`` of
``CHECKED`` values are passed over: at a similarity of 0.8 that many differ with a chance
below one in ten thousand. The rest count only if the exact Jaccard similarity of their
shingle sets reaches the threshold.

A band bucket is first compared with two of its lines in each of ``STARS`` rounds, and
verified links are contracted by distributed union-find. What still lies in different
components of a bucket is then compared pair by pair, so no candidate is left out, yet
a bucket of near copies costs about its size. That comparison carries parity sketches: each
distinct shingle flips one of ``SKETCH_BITS`` bits, so the bits in which two sketches differ
are never more than the shingles in only one of the lines. Pairs with more such bits than
the threshold allows are refuted inside the join, without an error, and give no row. Pairs
that were refuted by their text are not compared again. Of each component the first line by document id and position stays.

Signing and verifying run as numpy and Python in Arrow batches of bounded size, the rest
with DataFrame functions; the README gives the figures of the form with DataFrame
functions alone, which did not fit its limits.

Defined results: a null text counts as empty (one empty line); lines with no character
but white space are never duplicates and stay; lines shorter than a shingle are their own
single shingle; a null id ranks last; rows that repeat both id and text are decided once
and get the same result, rows that repeat an id with other texts rank by a hash of the
text; an empty table gives an empty result; only the two named columns are read, so extra
columns of any name change nothing. Two lines at similarity s meet in a band with a chance
of about ``1 - (1 - s**ROWS)**BANDS``, 0.991 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table
from .components import components

SHINGLE = 5
BANDS = 12
ROWS = 5
STARS = 2
THRESHOLD = 0.8
#: Signature values whose low four bits are kept, in two words, and the most that may differ.
CHECKED = 32
MOST_APART = 18
#: Bits of a parity sketch, a power of two.
SKETCH_BITS = 1024
#: Characters and lines that are signed or sketched at a time: so few that the arrays stay in a core's cache.
BLOCK_CHARS = 1 << 15
BLOCK_LINES = 1 << 10
#: Bits of a hash that stay where a line's number in its block takes the others.
HASH_BITS = 54

_U64 = np.uint64


def _place() -> Column:
    """What lines rank by."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "line_no")


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, t: a row is known by its id and a hash of its text, whatever the partitions."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("doc_id", F.xxhash64("t").alias("th"), "t")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, line_no, line, key (null for blank lines)."""
    every = rows_of(docs, id_col, text_col).select("doc_id", "th", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
    return every.withColumn("key", F.when(F.col("line").rlike("\\S"), F.unhex(F.md5("line"))))


def _mixes() -> tuple[np.ndarray, np.ndarray]:
    """An odd multiplier and a mask for each row: orders of hashes that do not depend on one another, as those under masks alone would."""
    r = np.random.default_rng(20_011)
    return r.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _hashed_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all shingles of all lines, where each line's begin, and how many it has."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + _U64(1)
    h = np.zeros(len(chars), dtype=np.uint64)
    for k in range(SHINGLE):
        # Lines that are shorter than a shingle have their only one at their start.
        rest = h[: max(0, len(chars) - k)]
        np.multiply(rest, _U64(0x100000001B3), out=rest)
        np.add(rest, chars[k:], out=rest)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for i in np.flatnonzero(sizes < SHINGLE):
        own = 0
        for c in chars[begins[i] : ends[i]].tolist():
            own = (own * 0x100000001B3 + c) % 2**64
        h[begins[i]] = own
    # The positions at the end of a line at which no shingle begins.
    begin = np.ones(len(chars), dtype=bool)
    for k in range(SHINGLE - 1):
        begin[(ends - 1 - k)[sizes > k + 1]] = False
    return _scrambled(h[begin]), np.cumsum(counts) - counts, counts


def signatures(lines: list[str]) -> np.ndarray:
    """The signature of each line, of one character at least: (lines, BANDS * ROWS) of uint32."""
    hashes, starts, _ = _hashed_shingles(lines)
    short = (hashes >> _U64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat((short * a) ^ m, starts) for a, m in zip(*_mixes(), strict=True)], axis=1)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each line, and their parity sketch: (lines, SKETCH_BITS // 64) of int64."""
    hashes, _, counts = _hashed_shingles(lines)
    # One sort of line and hash together; a block has at most BLOCK_LINES lines.
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
    keys = np.sort((owner << _U64(HASH_BITS)) | (hashes >> _U64(64 - HASH_BITS)))
    once = np.ones(len(keys), dtype=bool)
    once[1:] = keys[1:] != keys[:-1]
    keys = keys[once]
    owner, hashes = (keys >> _U64(HASH_BITS)).astype(np.int64), keys & _U64((1 << HASH_BITS) - 1)
    bits = owner * SKETCH_BITS + (hashes & _U64(SKETCH_BITS - 1)).astype(np.int64)
    odd = (np.bincount(bits, minlength=len(lines) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.bincount(owner, minlength=len(lines)), np.packbits(odd, bitorder="little").view(np.int64).reshape(len(lines), -1)


def _blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of bounded size; a longer line is a block of its own at most with those before it."""
    begin, held = 0, 0
    for k, line in enumerate(lines):
        held += len(line)
        if held >= BLOCK_CHARS or k + 1 - begin >= BLOCK_LINES or k + 1 == len(lines):
            yield begin, k + 1
            begin, held = k + 1, 0


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(1).to_pylist()
        for a, b in _blocks(lines):
            sig = signatures(lines[a:b]).astype(np.uint64)
            bands = np.zeros((b - a, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = _scrambled(bands * _U64(0x9E3779B97F4A7C15) + sig[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
            low = (sig[:, :CHECKED] & _U64(15)).reshape(b - a, 2, 16) << (_U64(4) * np.arange(16, dtype=np.uint64))
            words = np.bitwise_or.reduce(low, axis=2).view(np.int64)
            flat = pa.array(bands.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["id", "line", "first", "bands", "s0", "s1"])


_FIRST = "struct<no_id:boolean,doc_id:bigint,th:bigint,line_no:int>"


def signed(distinct: DataFrame) -> DataFrame:
    """distinct(id, line, first) -> the same with bands, s0 and s1."""
    return distinct.select("id", "line", "first").mapInArrow(_signed, f"id long, line string, first {_FIRST}, bands array<long>, s0 long, s1 long")


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(1).to_pylist()
        for a, b in _blocks(lines):
            counts, words = sketches(lines[a:b])
            columns = [pa.array(words[:, w].copy()) for w in range(words.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), *columns], names=["id", "n", *_WORDS])


_WORDS = [f"k{w}" for w in range(SKETCH_BITS // 64)]


def sketched(texts: DataFrame) -> DataFrame:
    """texts(id, line) -> id, n (distinct shingles) and the words of the parity sketch."""
    return texts.select("id", "line").mapInArrow(_sketched, f"id long, n long, {', '.join(f'{w} long' for w in _WORDS)}")


def _may_reach(x: str, y: str, threshold: float) -> Column:
    """False only if too many shingles are in one of the two lines alone."""
    most = (F.col(f"{x}n") + F.col(f"{y}n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    apart = F.lit(0)
    for w in _WORDS:
        apart = apart + F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}")))
    return (F.abs(F.col(f"{x}n") - F.col(f"{y}n")) <= most) & (apart <= most)


def shingle_set(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def _verify(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, one = None, set()
        for batch in batches:
            b_ids, lines_a, lines_b = (batch.column(k).to_pylist() for k in range(3))
            near = np.zeros(batch.num_rows, dtype=bool)
            for k, (b, x, y) in enumerate(zip(b_ids, lines_a, lines_b, strict=True)):
                if b != name:
                    name, one = b, shingle_set(y)
                if threshold * len(one) > max(len(x) - SHINGLE + 1, 1):
                    continue
                other = shingle_set(x)
                common = len(one & other)
                near[k] = common >= threshold * (len(one) + len(other) - common)
            hit = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([hit.column(3), hit.column(4)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b, comp_a, comp_b) -> the components (a, b) whose lines are similar enough."""
    side = lambda end: texts.select(F.col("id").alias(end), F.col("line").alias(f"line_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("b", "line_a", "line_b", "comp_a", "comp_b").mapInArrow(_verify(threshold), "a long, b long")


def _apart(x: Column, y: Column) -> Column:
    """In how many of 16 four-bit values two words differ."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
    z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
    return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))


def _close(x: str, y: str) -> Column:
    return _apart(F.col(f"{x}s0"), F.col(f"{y}s0")) + _apart(F.col(f"{x}s1"), F.col(f"{y}s1")) <= MOST_APART


def _open(banded: DataFrame, seed: int) -> DataFrame:
    """Buckets that hold several components: band and two of its lines."""
    order = F.xxhash64("id", F.lit(seed))
    line = F.struct("id", "comp", "s0", "s1")
    return banded.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(line, order).alias("p"), F.max_by(line, order).alias("q")).filter("lo <> hi")


def _ordered(pairs: DataFrame) -> DataFrame:
    """id, comp, o.id, o.comp -> a, b, comp_a, comp_b with a < b."""
    first = F.col("id") < F.col("o.id")
    pick = lambda x, y: (F.when(first, F.col(x)).otherwise(F.col(y)), F.when(first, F.col(y)).otherwise(F.col(x)))
    (a, b), (ca, cb) = pick("id", "o.id"), pick("comp", "o.comp")
    return pairs.select(a.alias("a"), b.alias("b"), ca.alias("comp_a"), cb.alias("comp_b")).distinct()


def _candidates(banded: DataFrame, texts: DataFrame, seed: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of a round, and the table it holds, if any."""
    unlike = F.col("comp") != F.col("o.comp")
    if seed < STARS:
        near = banded.join(_open(banded, seed).select("band", "p", "q"), "band").select("id", "comp", "s0", "s1", F.explode(F.array_distinct(F.array("p", "q"))).alias("o"))
        return _ordered(near.filter(unlike & _close("", "o."))), None
    left = banded.join(_open(banded, seed).select("band"), "band", "left_semi")
    open_texts = texts.join(left.select("id").distinct(), "id", "left_semi")
    held = materialize(left.join(sketched(open_texts), "id"), "line-rest")
    other = held.select("band", F.struct("id", "comp", "s0", "s1", "n", *_WORDS).alias("o"))
    return _ordered(held.join(other, "band").filter((F.col("id") < F.col("o.id")) & unlike & _close("", "o.") & _may_reach("", "o.", threshold))), held


def similar_components(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """lines as ``signed`` gives them, written -> (node, root): linked lines with the smallest id they reach."""
    every = lines.select("id", F.explode("bands").alias("band"))
    # Written first, so that the counting shuffle is gone before the next one; the bands grow with the lines and are never broadcast.
    shared = materialize(every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "line-bands")
    banded = materialize(every.join(shared.hint("merge"), "band", "left_semi").join(lines.select("id", "s0", "s1"), "id").withColumn("comp", F.col("id")), "line-shared")
    discard(shared)
    texts = materialize(lines.select("id", "line").join(banded.select("id").distinct(), "id", "left_semi"), "line-texts")
    roots = lines.sparkSession.createDataFrame([], "node long, root long")
    tried = None
    for seed in range(STARS + 1):
        pairs, held = _candidates(banded, texts, seed, threshold)
        pairs = materialize(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "line-pairs")
        found = materialize(_verified(pairs, texts, threshold).distinct(), "line-links")
        moved = components(found, "lines")
        discard(held, found)
        top = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # A component that has not moved yet is a single line.
        both = materialize(known.unionByName(moved.join(roots.select("node"), "node", "left_anti")), "line-roots")
        discard(roots)
        roots = both
        if seed < STARS:
            merged = moved.select(F.col("node").alias("comp"), "root")
            again = materialize(banded.join(merged, "comp", "left").select("band", "id", "s0", "s1", F.coalesce("root", "comp").alias("comp")), "line-shared")
            compared = pairs if tried is None else materialize(tried.unionByName(pairs), "line-tried")
            discard(banded, *((tried, pairs) if tried is not None else ()))
            banded, tried = again, compared
        else:
            discard(banded, tried, pairs)
        discard(moved)
    discard(texts)
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, component, first (of the line), best (first line of the component): a written table, one row a distinct line."""
    every = lines_of(docs, id_col, text_col).filter("key IS NOT NULL")
    distinct = every.groupBy("key").agg(F.min(_place()).alias("first"), F.first("line").alias("line"))
    lines = materialize(signed(distinct.withColumn("id", F.monotonically_increasing_id())), "line-signed")
    roots = similar_components(lines, threshold)
    rooted = lines.select("id", F.unhex(F.md5("line")).alias("key"), "first").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    rooted = rooted.select("key", F.coalesce("root", "id").alias("component"), "first")
    best = rooted.groupBy("component").agg(F.min("first").alias("best"))
    out = materialize(rooted.join(best, "component").select("key", "component", "first", "best"), "line-classes")
    discard(lines, roots)
    return out


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, component (null for blank lines), kept: one row a line."""
    every = lines_of(docs, id_col, text_col).drop("line")
    joined = every.join(classes(docs, id_col, text_col, threshold).select("key", "component", "best"), "key", "left")
    kept = F.col("key").isNull() | (_place() == F.col("best"))
    return joined.select("doc_id", "line_no", "component", kept.alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_kept, text: the documents of their blank lines and the first line of each component."""
    found = classes(docs, id_col, text_col, threshold)
    # One row a component; a document's list is no longer than the document.
    kept = found.filter("first = best").groupBy(F.col("best.doc_id").alias("k_id"), F.col("best.th").alias("k_th")).agg(F.collect_list("best.line_no").alias("held"))
    rows = rows_of(docs, id_col, text_col).join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")
    parts = F.array(F.struct(F.split("t", "\n", -1).alias("ls"), F.coalesce("held", F.array().cast("array<int>")).alias("held")))

    def lines_left(s: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(s["ls"]) - 1), lambda i: ~F.get(s["ls"], i).rlike("\\S"))
        return F.transform(F.array_sort(F.concat(s["held"], blank)), lambda i: F.get(s["ls"], i))

    # Inside the lambda each text is split once, not once a line.
    left = F.transform(parts, lines_left)
    out = rows.select("doc_id", F.size(F.split("t", "\n", -1)).cast("long").alias("n_lines"), F.get(left, 0).alias("left"))
    return out.select("doc_id", "n_lines", F.size("left").cast("long").alias("n_kept"), F.array_join("left", "\n").alias("text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, text_sha256 of what is left, for every document."""
    return dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))
