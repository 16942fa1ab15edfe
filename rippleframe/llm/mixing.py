"""Mixing sources to target weights by soft membership.

A hashed-word softmax classifier, fitted on a bounded sample of a labelled table, gives
each document's posterior over domains. With n tokens and posteriors p, document d adds
n*p to the domain totals at rate 1; nonnegative rates r are fitted by projected gradient
on the squared gap between the expected totals and the targets. A step depends on the
corpus only through the domain totals, so an iteration is one distributed sum, and a
document's rate follows from the gaps of the steps so far. The fit goes on until the
shares are within ``TOLERANCE`` of the targets. If they cannot be reached, or not in
``STEPS`` steps, the best rates found are returned with a warning that gives both shares.

Tokens are those of the byte-level ranks that ``bpe`` encodes with, counted by the tiktoken
library, which gives the same counts in less time.

Defined results: a null or blank text has no tokens and rate 1; a null id has its rate like
any other; rows that repeat each have their rate; without labels of two domains there is
nothing to mix and rates are 1; an empty table gives an empty result; columns but doc_id and
text are not read, and may have any name.
"""

from __future__ import annotations

import pickle
import warnings
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import share_vocabulary, slices
from .common import fresh, materialize, read_table

DIM = 1 << 13
TRAIN_DOCS = 3000
#: Most steps of a fit; one that converges takes few.
STEPS = 200
#: Largest gap between a share and its target at which a fit ends.
TOLERANCE = 1e-6
MEMO_WORDS = 200_000
#: Shares of quality-0 and quality-1 text.
TARGETS = {"0": 0.15, "1": 0.85}

class Classifier:
    """Softmax over the mean of hashed word weights; rows of ``w`` are hash buckets."""

    def __init__(self, domains: list[str]) -> None:
        self.domains, self.w, self.b = domains, np.zeros((DIM, len(domains))), np.zeros(len(domains))
        self.memo: dict[str, int] = {}

    def counts(self, text: str | None) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, found = self.memo, (text or "").split()
        for w in set(found).difference(memo):
            memo[w] = zlib.crc32(w.encode("utf-8", "replace")) % DIM
        return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return self.b + (self.w[x].mean(axis=0) * 20 if len(x) else 0)

    def posterior(self, text: str | None) -> np.ndarray:
        z = self._logits(self.counts(text))
        z = np.exp(z - z.max())
        return z / z.sum()

    def fit(self, texts: list[str], domains: list[str], epochs: int = 5, seed: int = 3) -> Classifier:
        r, g2 = np.random.default_rng(seed), np.full_like(self.w, 1e-6)
        y = [self.domains.index(d) for d in domains]
        share = np.bincount(y, minlength=len(self.domains)) / max(1, len(y))
        self.b = np.log(share + 1e-6)
        data = [self.counts(t) for t in texts]
        for _ in range(epochs):
            for k in r.permutation(len(data)):
                x = data[k]
                if not len(x):
                    continue
                z = self._logits(x)
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[k]] -= 1
                hit, n = np.unique(x, return_counts=True)
                g = (n[:, None] / len(x)) * p * 20
                g2[hit] += g * g
                self.w[hit] -= 0.1 * g / np.sqrt(g2[hit])
                self.b -= 0.01 * p
        return self


def fit_classifier(docs: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Classifier | None:
    """labelled(doc_id, domain); None if it has fewer than two domains."""
    rows = labelled.filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    if not picked:
        return None
    ids = docs.sparkSession.createDataFrame([tuple(x) for x in picked], "id long, domain string")
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("t")).join(F.broadcast(ids), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)})
        domains = sorted({d for _, _, d in rows})
        if len(domains) > 1:
            made = Classifier(domains).fit([t for _, t, _ in rows], [d for _, _, d in rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((made.domains, made.w, made.b))], pa.binary())], names=["fitted"])

    # One task, for a bounded number of rows; the driver gets the weights alone.
    row = found.select("id", "t", "domain").repartition(1).mapInArrow(run, "fitted binary").first()
    if row is None:
        return None
    domains, w, b = pickle.loads(row["fitted"])
    out = Classifier(domains)
    out.w, out.b = w, b
    return out


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens, p array<double>; tokens are those of ``bpe``."""
    shared, vocabulary = docs.sparkSession.sparkContext.broadcast(classifier), share_vocabulary(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        v = vocabulary.value
        encode = tiktoken.Encoding("ranks", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary
        for b in batches:
            for part in slices(b):
                texts = [t or "" for t in part.column(1).to_pylist()]
                # Blank texts have no tokens.
                counts = [len(encode(t)) if t.strip() else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array([shared.value.posterior(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def shares_of(domains: list[str], targets: dict[str, float]) -> np.ndarray:
    share = np.array([targets.get(d, 0.0) for d in domains])
    return share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))


def way_of(tokens: pa.Array, p: pa.Array, share: np.ndarray, cover: bool) -> np.ndarray:
    """What a token of each document adds to the domains; with ``cover``, what that exceeds the target shares by. 0 without tokens."""
    some = (tokens.to_numpy() > 0)[:, None]
    return some * (p.flatten().to_numpy().reshape(-1, len(share)) - (share if cover else 0.0))


def rates_of(way: np.ndarray, gaps: list[np.ndarray], floor: float = 0.0) -> np.ndarray:
    """Rates, ``floor`` at least, of documents with ``way_of`` after the steps so far."""
    r = np.ones(len(way))
    for g in gaps:
        r = np.maximum(floor, r - way @ g)
    return r


def fit_rates(post: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, cover: bool = False) -> list[np.ndarray]:
    """The steps' gaps, from which ``rates_of`` gives every rate. ``post`` has to be a written table.

    A document's part of the gradient is divided by its tokens, a diagonal scaling that the
    projection allows, so a very long document does not set the pace and rates follow the
    posterior alone. The gradient is taken in the metric of the domains' moments, in which a
    unit step is safe; once rates lie at the floor, also in the metric of the others' moments,
    in which steps are longer. A pass tries several steps and the best is kept. Targets are
    shares of today's total; with ``cover`` no rate goes below 1 and the total is free to grow.
    """
    k = len(domains)
    share, floor = shares_of(domains, targets), float(cover)

    def sums(gaps: list[np.ndarray], tries: list[np.ndarray]) -> np.ndarray:
        """For each try: the mass, the domain tokens and the moments of documents above the floor; last, the moments of all."""
        wide = 2 * k + k * k

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(tries) * wide + k * k)
            for b in batches:
                n, way = b.column(0).to_numpy()[:, None], way_of(b.column(0), b.column(1), share, cover)
                mass, tokens = n * way, n * way_of(b.column(0), b.column(1), share, False)
                r = rates_of(way, gaps, floor)
                for t, g in enumerate(tries):
                    new = np.maximum(floor, r - way @ g)
                    free = new > floor
                    total[t * wide : (t + 1) * wide] += np.concatenate([new @ mass, new @ tokens, (mass[free].T @ way[free]).reshape(-1)])
                total[len(tries) * wide :] += (mass.T @ way).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        rows = post.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(tries) * wide + k * k)
        for i, x in rows:
            out[i] = x
        return out

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[:k] - want, x[k : 2 * k], np.linalg.pinv(x[2 * k :].reshape(k, k), rcond=1e-9)

    first = sums([], [np.zeros(k)])
    inverse = np.linalg.pinv(first[-k * k :].reshape(k, k), rcond=1e-9)
    want = np.zeros(k) if cover else share * first[k : 2 * k].sum()
    gap, now, free = parts(first[: -k * k])
    gaps: list[np.ndarray] = []
    for _ in range(steps):
        if np.abs(gap).max() <= TOLERANCE * now.sum():
            return gaps
        step, longer = inverse @ gap, free @ gap
        tries = [step, 2 * step, 4 * step, longer, longer / 2]
        found = [parts(x) for x in sums(gaps, tries)[: -k * k].reshape(len(tries), -1)]
        best = min(range(len(tries)), key=lambda t: found[t][0] @ inverse @ found[t][0])
        if found[best][0] @ inverse @ found[best][0] >= (1 - 1e-6) * (gap @ inverse @ gap):
            break
        gaps.append(tries[best])
        gap, now, free = found[best]
    if np.abs(gap).max() > TOLERANCE * now.sum():
        reached = ", ".join(f"{d}: {x:.4f} of {y:.4f}" for d, x, y in zip(domains, now / now.sum(), share, strict=True))
        warnings.warn(f"mixing stopped after {len(gaps)} steps short of its targets; shares reached {reached}; largest gap {np.abs(gap).max() / now.sum():.2e} of the tokens", stacklevel=2)
    return gaps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, steps: int = STEPS, cover: bool = False, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, n_tokens, p, rate for every document."""
    classifier = fit_classifier(docs, labelled, train_docs)
    if classifier is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.array(F.lit(1.0)).alias("p"), F.lit(1.0).alias("rate"))
    post = materialize(posteriors(docs, classifier), "mix-posteriors")
    gaps = fit_rates(post, classifier.domains, targets or TARGETS, steps, cover)
    share = shares_of(classifier.domains, targets or TARGETS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            way = way_of(b.column(1), b.column(2), share, cover)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates_of(way, gaps, float(cover)))], names=["doc_id", "n_tokens", "p", "rate"])

    return post.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, cover: bool = True) -> DataFrame:
    """``docs`` with each row as often as its rate says, the fraction settled by a hash of the id; with ``cover`` none goes."""
    own_id, rate, one = fresh(docs, "mix_id", "mix_rate", "mix_one")
    rates = mix(docs, labelled, targets, cover=cover).groupBy(F.col("doc_id").alias(own_id)).agg(F.max("rate").alias(rate))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    joined = docs.join(rates, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left")
    times = F.floor(F.coalesce(F.col(rate), F.lit(1.0)) + u).cast("int")
    return joined.withColumn(one, F.explode(F.array_repeat(F.lit(1), times))).drop(own_id, rate, one)


def quality_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, p, rate for every document, for the target shares of quality."""
    return mix(read_table(spark, sf_dir, "documents"), quality_domains(spark, sf_dir))
