"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a hashed word vector and the mean of hashed vectors of its
character n-grams, so unseen words built from telling pieces still tell. Words are read in
windows of ``WINDOW`` at a stride of half of it; every window of the whole text is scored
and a document's logit is that of its worst window.

Training (in one task, by seed): at most ``train_docs`` labelled rows, taken by hash of
the id, two clean ones for each toxic one where there are as many; the gradient goes
through each document's worst window. The driver gets the weights alone, a few MB.

Defined results: a null text counts as empty; a text without words is scored as one empty
window; labels that are null or of absent documents are not learnt from, and of labels that
repeat an id toxic ones count; without any label of both kinds every score is the share of
toxic rows (or 0); a null id is scored like any other and is not held out; rows that repeat
are each scored; an empty table gives an empty result; columns but the two named are not
read, and may have any name.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table

WINDOW = 32
STRIDE = 16
DIM = 16
HIDDEN = 8
BUCKETS = 1 << 15
TRAIN_DOCS = 4500
EPOCHS = 6
GRAMS = (3, 4, 5, 6)
MEMO_WORDS = 100_000
#: Windows scored at a time.
WINDOWS = 2048

_find = re.compile(r"\w+").findall


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed word of each word, hashed n-grams, owner of each n-gram, ascending)."""
    coded = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(c) for c in coded], dtype=np.int64)
    flat = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), size)
    power = np.uint64(0x100000001B3)
    grams, owners = [], []
    roll = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        roll = roll[:m] * power + flat[n - 1 :]
        if n in GRAMS:
            inside = owner[:m] == owner[n - 1 :]
            grams.append(_mix(roll[inside] + np.uint64(n)))
            owners.append(owner[:m][inside])
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat((np.cumsum(size) - size).astype(np.uint64), size)
    whole = np.add.reduceat(flat * ((place * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)) * (place + power), np.cumsum(size) - size)
    g, o = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return _mix(whole).astype(np.int64), g[order], o[order]


def featured(words: list[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed word of each word, hashed n-grams, number of n-grams of each word), made a block of words at a time."""
    parts = []
    for at in range(0, len(words), block):
        some = words[at : at + block]
        whole, grams, owner = features(some)
        parts.append((whole.astype(np.int32), grams.astype(np.int32), np.bincount(owner, minlength=len(some))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each)."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
    return r[cuts], np.add.reduceat(values[order], cuts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def windows_of(n: int) -> int:
    return 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)


class Network:
    """The weights, forward pass and gradient."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "chars": f(BUCKETS, DIM, k=0.1), "words": f(BUCKETS, DIM, k=0.03),
            "Wf": f(DIM, 3 * HIDDEN, k=0.3), "Uf": f(HIDDEN, 3 * HIDDEN, k=0.3), "bf": np.zeros(3 * HIDDEN, np.float32),
            "Wb": f(DIM, 3 * HIDDEN, k=0.3), "Ub": f(HIDDEN, 3 * HIDDEN, k=0.3), "bb": np.zeros(3 * HIDDEN, np.float32),
            "att": f(2 * HIDDEN, k=0.3), "out": f(2 * HIDDEN, k=0.5), "bias": np.full(1, -1.0, np.float32),
        }
        self.constant: float | None = None

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        whole, grams, owner = features(words)
        n = np.bincount(owner, minlength=len(words)).astype(np.float32)
        starts = np.cumsum(n).astype(np.int64) - n.astype(np.int64)
        summed = np.add.reduceat(self.p["chars"][grams], starts, axis=0)
        return self.p["words"][whole] + summed / n[:, None], (whole, grams, owner, n)

    def _gru(self, gates: np.ndarray, mask: np.ndarray, U: np.ndarray, keep: bool):
        n, T, _ = gates.shape
        H = HIDDEN
        h = np.zeros((n, H), np.float32)
        hs = np.empty((T, n, H), np.float32)
        kept = []
        for t in range(T):
            x = gates[:, t]
            u = h @ U
            rz = _sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
            r, z = rz[:, :H], rz[:, H:]
            c = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
            new = (c + z * (h - c)) * mask[:, t, None]
            if keep:
                kept.append((h, r, z, c, u[:, 2 * H :]))
            h = hs[t] = new
        return hs, kept

    def forward(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from their gate inputs (n, T, 3H) both ways."""
        hf, kf = self._gru(gf, mask, self.p["Uf"], keep)
        hb, kb = self._gru(gb[:, ::-1], mask[:, ::-1], self.p["Ub"], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        a = h @ self.p["att"] - 1e4 * (1 - mask.T)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        return pooled @ self.p["out"] + self.p["bias"][0], (kf, kb, h, a, pooled)

    def _gru_back(self, dh_all: np.ndarray, kept: list, mask: np.ndarray, U: np.ndarray, dU: np.ndarray) -> np.ndarray:
        H, T = HIDDEN, len(kept)
        dg = np.empty((dh_all.shape[1], T, 3 * H), np.float32)
        dh = np.zeros(dh_all.shape[1:], np.float32)
        for t in reversed(range(T)):
            h, r, z, c, uc = kept[t]
            d = (dh + dh_all[t]) * mask[:, t, None]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            dg[:, t] = np.concatenate([dr, dz, dc], axis=1)
            du = np.concatenate([dr, dz, dc * r], axis=1)
            dU += h.T @ du
            dh = d * z + du @ U.T
        return dg

    def backward(self, dlogit: np.ndarray, cache, mask: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        kf, kb, h, a, pooled = cache
        p = self.p
        g = {k: np.zeros_like(p[k]) for k in ("Uf", "Ub")}
        g["out"], g["bias"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dp = dlogit[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dp, h)
        ds = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", ds, h)
        dh = a[:, :, None] * dp + ds[:, :, None] * p["att"]
        dgf = self._gru_back(dh[:, :, :HIDDEN], kf, mask, p["Uf"], g["Uf"])
        dgb = self._gru_back(dh[::-1, :, HIDDEN:], kb, mask[:, ::-1], p["Ub"], g["Ub"])[:, ::-1]
        return g, dgf, dgb

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, side by side."""
        return x @ np.concatenate([self.p["Wf"], self.p["Wb"]], axis=1) + np.concatenate([self.p["bf"], self.p["bb"]])


def _windows(length: int) -> np.ndarray:
    """Word positions of each window of a text; ``length`` stands for no word."""
    at = np.arange(windows_of(length))[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < length, at, length)


def train(texts: list[str], toxic: list[int], seed: int = 7, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.02) -> Network:
    net = Network(seed)
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    r = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _find((t or "").lower())], np.int32) for t in texts]
    words = list(vocabulary) or ["x"]
    whole, grams, n_grams = featured(words)
    starts = np.cumsum(n_grams) - n_grams
    sums = {k: np.zeros_like(v) for k, v in net.p.items()}
    firsts = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("chars", "words")}
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / (epochs + 1))
        for pick in np.array_split(r.permutation(len(docs)), max(1, len(docs) // batch)):
            used, inverse = np.unique(np.concatenate([docs[k] for k in pick] + [np.zeros(1, np.int32)]), return_inverse=True)
            idx, of, at = [], [], 0
            for j, k in enumerate(pick):
                n = len(docs[k])
                local = np.append(inverse[at : at + n], len(used))
                at += n
                w = local[_windows(n)]
                idx.append(w)
                of.append(np.full(len(w), j))
            idx, of = np.concatenate(idx), np.concatenate(of)
            n_used = n_grams[used]
            at_used = np.repeat(starts[used] - (np.cumsum(n_used) - n_used), n_used) + np.arange(n_used.sum())
            g_used = grams[at_used]
            x = net.p["words"][whole[used]] + np.add.reduceat(net.p["chars"][g_used], np.cumsum(n_used) - n_used, axis=0) / n_used[:, None].astype(np.float32)
            x = np.concatenate([x, np.zeros((1, DIM), np.float32)])
            gate = net.gates(x)
            mask = (idx < len(used)).astype(np.float32)
            logit = np.concatenate([
                net.forward(gate[i][..., : 3 * HIDDEN], gate[i][..., 3 * HIDDEN :], m)[0]
                for i, m in ((idx[s : s + WINDOWS], mask[s : s + WINDOWS]) for s in range(0, len(idx), WINDOWS))
            ])
            order = np.lexsort((-logit, of))
            worst = order[np.concatenate([[True], np.diff(of[order]) > 0])]
            i, m = idx[worst], mask[worst]
            gi = gate[i]
            l, cache = net.forward(gi[..., : 3 * HIDDEN], gi[..., 3 * HIDDEN :], m, keep=True)
            d = ((_sigmoid(l) - y[pick]) / len(pick)).astype(np.float32)
            g, dgf, dgb = net.backward(d, cache, m)
            dg = np.concatenate([dgf, dgb], axis=2).reshape(-1, 6 * HIDDEN)
            xi = x[i].reshape(-1, DIM)
            dW = xi.T @ dg
            g["Wf"], g["Wb"] = dW[:, : 3 * HIDDEN], dW[:, 3 * HIDDEN :]
            db = dg.sum(axis=0)
            g["bf"], g["bb"] = db[: 3 * HIDDEN], db[3 * HIDDEN :]
            hit, total = _summed(i.reshape(-1), dg @ np.concatenate([net.p["Wf"], net.p["Wb"]], axis=1).T)
            live = hit < len(used)
            dx, touched = total[live], hit[live]
            step += 1
            for k, v in g.items():
                firsts[k] = 0.9 * firsts[k] + 0.1 * v
                sums[k] = 0.999 * sums[k] + 0.001 * v * v
                net.p[k] -= lr * 0.5 * (firsts[k] / (1 - 0.9**step)) / (np.sqrt(sums[k] / (1 - 0.999**step)) + 1e-6)
            n_touched = n_used[touched]
            g_touched = grams[np.repeat(starts[used[touched]] - (np.cumsum(n_touched) - n_touched), n_touched) + np.arange(n_touched.sum())]
            for k, rows, grad in (
                ("words", whole[used[touched]], dx),
                ("chars", g_touched, np.repeat(dx / n_touched[:, None].astype(np.float32), n_touched, axis=0)),
            ):
                if not len(rows):
                    continue
                hit, total = _summed(rows, grad)
                sums[k][hit] += total * total
                net.p[k][hit] -= 5 * lr * total / (np.sqrt(sums[k][hit]) + 1e-6)
    return net


class Scorer:
    """Scores texts with a trained network; the memo of words is emptied at ``MEMO_WORDS``."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = self.net.gates(np.zeros((1, DIM), np.float32))

    def _numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Row of ``table`` for each word; row 0 is no word."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        memo, out, known = self.memo, [], len(self.memo)
        for t in texts:
            found = _find(t.lower())
            for w in set(found).difference(memo):
                memo[w] = len(memo) + 1
            out.append(np.fromiter(map(memo.__getitem__, found), np.int64, len(found)))
        if len(memo) > known:
            fresh = list(memo)[known:]
            for at in range(0, len(fresh), 20_000):
                x, _ = self.net.vectors(fresh[at : at + 20_000])
                self.table = np.concatenate([self.table, self.net.gates(x)])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        numbers = self._numbers([t or "" for t in texts])
        best = np.full(len(texts), -np.inf)
        parts, owners, held = [], [], 0

        def flush():
            idx, of = np.concatenate(parts), np.concatenate(owners)
            g = self.table[idx]
            logit, _ = self.net.forward(g[..., : 3 * HIDDEN], g[..., 3 * HIDDEN :], (idx > 0).astype(np.float32))
            np.maximum.at(best, of, logit)

        for k, x in enumerate(numbers):
            padded = np.append(x, 0)
            for at in range(0, windows_of(len(x)), WINDOWS):
                w = np.arange(at, min(at + WINDOWS, windows_of(len(x))))[:, None] * STRIDE + np.arange(WINDOW)
                parts.append(padded[np.minimum(w, len(x))])
                owners.append(np.full(len(w), k))
                held += len(w)
                if held >= WINDOWS:
                    flush()
                    parts, owners, held = [], [], 0
        if parts:
            flush()
        return _sigmoid(best)


def _train(seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for i, t, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                # Of rows that repeat an id the least text is learnt from.
                rows[i] = min(rows.get(i, (t, y)), (t, y))
        found = [rows[i] for i in sorted(rows)]
        rows.clear()
        net = train([t for t, _ in found], [y for _, y in found], seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.p, net.constant))], pa.binary())], names=["net"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, seed: int = 7) -> Network:
    """Learn from at most ``train_docs`` labelled rows outside the held-out fifth."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    bad = rows.filter("y = 1").orderBy(*by_hash).limit(train_docs // 3).collect()
    good = rows.filter("y = 0").orderBy(*by_hash).limit(min(train_docs - len(bad), max(200, 2 * len(bad)))).collect()
    if not bad and not good:
        return train([], [], seed)
    ids = docs.sparkSession.createDataFrame([tuple(x) for x in bad + good], "id long, y int")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), "id")
    # One task, for a bounded number of rows.
    made = found.select("id", "t", "y").repartition(1).mapInArrow(_train(seed), "net binary").first()
    if made is None:
        return train([], [], seed)
    net = Network(seed)
    net.p, net.constant = pickle.loads(made["net"])
    return net


def held_out(id_col):
    """Whether crc32 of the id, as text, is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``at`` or more; columns as they came."""
    shared, held = docs.sparkSession.sparkContext.broadcast(net), {}

    @F.pandas_udf("double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = held.setdefault("scorer", Scorer(shared.value))
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series(np.concatenate([scorer.scores(rows[k : k + 128]) for k in range(0, len(rows), 128)] or [np.zeros(0)]))

    (name,) = fresh(docs, "toxic_score")
    return docs.withColumn(name, judged(F.col(text_col))).filter(F.col(name) < at).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
