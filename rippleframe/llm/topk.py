"""Exact top-k by tiled matrix products.

Queries go out in blocks of at most ``BROADCAST_BYTES``, one after another: the driver holds
one block, whatever their number, and a block's lists are written before the next is read.
Each task multiplies slices of a block with tiles of its shard, ``CELLS`` scores at a time,
selects the best of each tile, and keeps one running list a query. Lists of tasks are merged as a tree: first within groups of
tasks, then across groups.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null id; vectors of unequal length are padded with zeros; a query whose
id repeats is asked once and rows with its id are its own; ties go to the smaller id; an
empty table gives an empty result; columns but the two named are not read. Products that
could leave 2**53 are computed in whole numbers; scores that do not fit a long are held at
its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, read_table

TILE = 2048
#: Scores that a task holds at a time: a slice of the queries against one tile.
CELLS = 1 << 21
K = 20
#: Below every score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of each usable vector."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(n, dim)
    width = max(dim, int(sizes.max(initial=0)))
    out = np.zeros((n, width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out[:, :dim]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def products(q: np.ndarray, m: np.ndarray, most_q: float | None = None) -> np.ndarray:
    """Inner products of rows, in doubles where none can leave their whole numbers; ``most_q`` bounds the components of q."""
    bound = float(np.abs(q).max(initial=0)) if most_q is None else most_q
    if bound * float(np.abs(m).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    most = -(NONE + 1)
    exact = q.astype(object) @ m.T.astype(object) if q.shape[1] else np.zeros((len(q), len(m)), object)
    return np.clip(exact, -most, most).astype(np.int64)


def _best_of_tile(s: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids, scores: of each row of a tile's scores all that reach its k-th, padded with NONE, so ties are settled by id later."""
    if len(own) <= k:
        return np.broadcast_to(own, s.shape), s
    floor = np.partition(s, len(own) - k, axis=1)[:, len(own) - k]
    keep = s >= floor[:, None]
    width = int(keep.sum(axis=1).max())
    order = np.argsort(own, kind="stable")
    first = np.argsort(~keep[:, order], axis=1, kind="stable")[:, :width]
    scores = np.where(np.take_along_axis(keep[:, order], first, 1), np.take_along_axis(s[:, order], first, 1), NONE)
    return own[order][first], scores


def _search(q_ids: np.ndarray, q: np.ndarray, k: int, cells: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One list a query; beside it a task holds the scores of a slice of queries and one tile.
        ids, scores = np.zeros((len(q_ids), k), dtype=np.int64), np.full((len(q_ids), k), NONE, dtype=np.int64)
        most = float(np.abs(q).max(initial=0))
        for batch in batches:
            for part in (batch.slice(at, TILE) for at in range(0, batch.num_rows, TILE)):
                own, m = part.column(0).to_numpy(), _matrix(part.column(1), q.shape[1])
                step = max(1, cells // len(own))
                for at in range(0, len(q_ids), step):
                    rows = slice(at, at + step)
                    s = products(q[rows], m, most)
                    s[q_ids[rows, None] == own[None, :]] = NONE
                    tile_ids, s = _best_of_tile(s, own, k)
                    ids[rows], scores[rows] = best_of(np.concatenate([ids[rows], tile_ids], 1), np.concatenate([scores[rows], s], 1), k)
        live = scores != NONE
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, live.sum(axis=1))), pa.array(ids[live]), pa.array(scores[live])], names=["query_id", "vec_id", "score"]
        )

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries (vec_id, v) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    queries = materialize(queries.dropDuplicates(["vec_id"]), "topk-queries")
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (dim or 1) * 8 // BROADCAST_BYTES))
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids = rows.column(0).to_numpy()
        q = _matrix(rows.column(1).combine_chunks(), dim or 0) if n else np.zeros((0, 0), np.int64)
        lists = vectors.mapInArrow(_search(ids, q, k, CELLS), "query_id long, vec_id long, score long") if len(ids) else spark.createDataFrame([], "query_id long, vec_id long, score long")
        if blocks > 1:
            lists = materialize(lists, "topk-lists")
        out = lists if out is None else out.unionByName(lists)
    # Groups of tasks as many as each group has tasks.
    lists = out.withColumn("g", F.spark_partition_id() % max(2, math.isqrt(out.rdd.getNumPartitions())))
    order = [F.desc("score"), F.asc("vec_id")]
    some = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*order))).filter(F.col("r") <= k)
    final = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for rows whose id is divisible by 20, against all rows."""
    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
