"""Byte-level BPE with two tiers of lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are
entries themselves; the entry found is compared byte by byte, so a stranger never passes.
Tier two: a pre-token that misses is merged with a heap of candidate pairs over a doubly
linked list of byte spans, lowest rank first, leftmost on ties.

Defined results: a null text is the empty text (no ids); texts are encoded whole, however
long; special tokens are never produced. The worker's memo of resolved pre-tokens is only
a cache: it is emptied at ``MEMO_PIECES`` entries and never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MEMO_PIECES = 200_000
#: Characters of text that are encoded at a time; a single longer text makes a block of its own.
BLOCK_CHARS = 1 << 20


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys on exactly n slots.

    A bucket of several keys stores the first displacement that puts all of them on free
    slots; a bucket of one key stores its slot directly (as ``-1 - slot``).
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        self.order = np.full(n, -1, dtype=np.int64)
        if not keys:
            return
        h = self.digest(keys)
        b = self._bucket(h)
        by_bucket = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.diff(b[by_bucket])) + 1
        groups = sorted(np.split(by_bucket, cuts), key=len, reverse=True)
        free = np.ones(n, dtype=bool)
        tries = np.arange(512, dtype=np.int64)[:, None]
        at = 0
        for at, g in enumerate(groups):
            if len(g) == 1:
                break
            base = 0
            while True:
                slots = self._slot(h[g][None, :], tries + base)
                ok = free[slots].all(axis=1)
                srt = np.sort(slots, axis=1)
                ok &= (srt[:, 1:] != srt[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.displace[b[g[0]]] = base + k
                    free[slots[k]] = False
                    self.order[slots[k]] = g
                    break
                base += len(tries)
        else:
            at = len(groups)
        for g, slot in zip(groups[at:], np.flatnonzero(free), strict=True):
            self.displace[b[g[0]]] = -1 - slot
            self.order[slot] = g[0]

    @staticmethod
    def digest(keys: Iterable[bytes]) -> np.ndarray:
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(k) for k in keys), dtype=np.uint64)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        """A fresh hash for each displacement, so the search visits all slots."""
        x = h ^ ((displacement.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The key index on each key's slot; only equal bytes prove that the key is in the set."""
        h = self.digest(keys)
        d = self.displace[self._bucket(h)]
        return self.order[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))]


class Vocabulary:
    """Ranks of a rank file, its perfect hash, and the pattern that splits text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.ranks = ranks
        self.entries = list(ranks)
        self.ids = np.array(list(ranks.values()), dtype=np.uint32)
        self.hash = PerfectHash(self.entries)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> Vocabulary:
        """A rank file; by default the public 50k byte-level vocabulary and its pattern."""
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern or public_tokenizers.PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: heap over linked bytes."""
        n, ranks = len(piece), self.ranks
        if n < 2:
            return [ranks[piece]] if n else []
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != e:
                continue
            live[j] = False
            end[i] = e
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class _Memo(dict):
    """Text of a pre-token -> its number in order of first sight."""

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        return k


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i] + lengths[i], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Encoder:
    """Encodes blocks of texts; keeps what it has resolved between blocks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.memo = _Memo()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.offsets = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _resolve(self, pieces: list[bytes]) -> None:
        if not pieces:
            return
        entries, ids, merge = self.v.entries, self.v.ids, self.v.merge
        at = self.v.hash.slots(pieces)
        known = np.fromiter((entries[k] == p for k, p in zip(at.tolist(), pieces, strict=True)), dtype=bool, count=len(pieces))
        lengths = np.ones(len(pieces), dtype=np.int64)
        merged = [merge(pieces[k]) for k in np.flatnonzero(~known).tolist()]
        lengths[~known] = [len(m) for m in merged]
        offsets = self.used + np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[offsets[known]] = ids[at[known]]
        if merged:
            self.flat[ragged(offsets[~known], lengths[~known])] = np.concatenate([np.array(m, dtype=np.uint32) for m in merged])
        self.used += total
        self.offsets = np.concatenate([self.offsets, offsets])
        self.lengths = np.concatenate([self.lengths, lengths])

    def _numbers(self, text: str) -> np.ndarray:
        found = self.find(text)
        return np.fromiter(map(self.memo.__getitem__, found), dtype=np.int64, count=len(found))

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_PIECES:
            self._forget()
        known = len(self.memo)
        numbers = [self._numbers(t) for t in texts]
        if len(self.memo) > known:
            fresh = list(self.memo)[known:] if known else list(self.memo)
            self._resolve([p.encode() for p in fresh])
        return numbers

    def counts(self, texts: list[str]) -> list[int]:
        return [int(self.lengths[x].sum()) for x in self._block(texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (uint32)."""
        numbers = self._block(texts)
        each = np.array([len(x) for x in numbers], dtype=np.int64)
        x = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        lengths = self.lengths[x] if len(x) else np.zeros(0, dtype=np.int64)
        ids = self.flat[ragged(self.offsets[x], lengths)] if len(x) else np.zeros(0, dtype=np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = ends[np.concatenate([[0], np.cumsum(each)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids.tolist()))


def blocks_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK_CHARS`` characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def share_vocabulary(spark: SparkSession, vocabulary: Vocabulary | None = None):
    """A broadcast of the vocabulary; its size is that of the rank file, a few MB, whatever the corpus."""
    return spark.sparkContext.broadcast(vocabulary or Vocabulary.load())


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, ids array<long>, decoded binary: the encoded texts and what their ids decode to."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for a, b in blocks_of(texts):
                    ids = encoder.encode(texts[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(a, b - a), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                        names=["doc_id", "ids", "decoded"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>, decoded binary")


def digest_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without moving the ids out of the worker."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = Encoder(shared.value), hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, of_ids, of_bytes = [], [], []
                for a, b in blocks_of(texts):
                    for ids in encoder.encode(texts[a:b]):
                        counts.append(len(ids))
                        of_ids.append(sha(ids.astype("<u4").tobytes()).hexdigest())
                        of_bytes.append(sha(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [n for a, b in blocks_of(texts) for n in encoder.counts(texts[a:b])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


# --- query ------------------------------------------------------------------------------

def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return digest_texts(read_table(spark, sf_dir, "documents"))
