"""The prefix trie of conversations, as balanced parentheses per shard.

A turn is known by a digest of its role and text, a conversation by the digests of its
turns in order, its path. Conversations are range partitioned and sorted by path, so each
shard (a run of ``NODES`` new nodes of a task) holds a connected piece of the trie. It is
encoded as balanced parentheses, an opening one a node in preorder. ``RangeMinMax`` keeps
the least excess of each block of parentheses and of each pair of blocks above, and finds
the parenthesis that closes a node, which delimits its subtree. Ranks of "()" count its
leaves, and cumulative arrays in preorder give its members and savings.

Only the paths of a shard's first and last conversation, its spines, can reach into other
shards; all other nodes are final where they are built. Spine nodes are merged by a digest
of their path: members, children and what hangs from them are added up, and what spine
nodes themselves bring is added to their ancestors in the shard that owns the node, the
first one that has it. A node below a spine learns its parent's id by a join whose key
names the shard, so no key is hot.

Defined results: rows without conv_id take no part; a null turn comes first, turns of equal
number go by the digest of role and text, repeated rows are turns of their own; a null
role or text is empty; a conversation without turns ends at the root; an empty table has no
nodes; texts are digested whole; columns but the four named are not read and may have any
name. A conversation's digests, 24 bytes a turn, are one value; its texts are not gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, shuffle_partitions

#: Most turns that a conversation takes from the one it is rebuilt on.
SHARED = 8
#: Conversations that are rebuilt on one another.
FAMILY = 5
#: New nodes of a shard.
NODES = 1 << 16
#: Parentheses of a block whose least excess is kept.
BLOCK = 512
#: Bytes of a path by which conversations are dealt to tasks; within a task the whole path orders them.
RANGE_BYTES = 1024
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "spine boolean, shard long, side int, depth long, shared long, key binary, parent_key binary, parent_side int, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, own_bytes long, ends string"
)


def paths(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<struct<digest, bytes>> in order, as the table has them."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = table.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).isNotNull().alias("numbered"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The same rows with each conversation's first turns from the first of its family, as many as its id's checksum says."""
    own = own.withColumn("head", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED + 1)).cast("int"))
    first = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, SHARED).alias("first"))
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first_id"), "left")
    none = F.slice("turns", 1, 0)
    taken = F.when(F.col("first").isNull() | (F.col("head") == 0), none).otherwise(F.slice("first", 1, F.greatest(F.col("head"), F.lit(1))))
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    return both.select("conv_id", F.concat(taken, rest).alias("turns"))


class RangeMinMax:
    """Balanced parentheses with the least excess of each block, and of each pair below it up to the root."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        self.levels = [self.blocks.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    def _first(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """In each block the first position from ``start`` whose excess is at most the target; BLOCK if there is none."""
        out = np.empty(len(block), dtype=np.int64)
        for at in range(0, len(block), 4096):
            part = slice(at, at + 4096)
            ok = (self.blocks[block[part]] <= target[part, None]) & (np.arange(BLOCK)[None, :] >= start[part, None])
            out[part] = np.where(ok.any(axis=1), ok.argmax(axis=1), BLOCK)
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each opening one."""
        target = self.excess[at] - 1
        block = at // BLOCK
        inside = self._first(block, at % BLOCK + 1, target)
        out = block * BLOCK + inside
        far = np.flatnonzero(inside == BLOCK)
        if len(far):
            goal, node, level = target[far], block[far].copy(), np.zeros(len(far), dtype=np.int64)
            climbing = np.ones(len(far), dtype=bool)
            for k, low in enumerate(self.levels):
                # A left child looks at its right sibling; found, the search turns down from there.
                up = np.flatnonzero(climbing)
                right = up[(node[up] % 2 == 0) & (node[up] + 1 < len(low))]
                hit = right[low[node[right] + 1] <= goal[right]]
                node[hit] += 1
                level[hit] = k
                climbing[hit] = False
                left = np.flatnonzero(climbing)
                node[left] //= 2
            for k in range(len(self.levels) - 1, 0, -1):
                down = np.flatnonzero(level >= k)
                node[down] *= 2
                worse = down[self.levels[k - 1][node[down]] > goal[down]]
                node[worse] += 1
                level[down] = k - 1
            out[far] = node * BLOCK + self._first(node, np.zeros(len(far), dtype=np.int64), goal)
        return out


class Shard:
    """A piece of the trie: entries are distinct paths in order, with the conversations that end there."""

    def __init__(self, number: int):
        self.number = number
        self.opens: list[bool] = []
        self.depth, self.bytes, self.parent, self.at = [], [], [], []
        self.ended: list[int] = []
        self.least: list[int] = []
        self.ends: list[str | None] = []
        self.stack: list[int] = []
        self.path, self.first = b"", None

    def _open(self, n_bytes: int) -> None:
        self.at.append(len(self.opens))
        self.opens.append(True)
        self.depth.append(len(self.stack))
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.bytes.append(n_bytes)
        self.ended.append(0)
        self.least.append(np.iinfo(np.int64).max)
        self.ends.append(None)
        self.stack.append(len(self.at) - 1)

    def add(self, path: bytes, sizes: list[int], count: int, least: int, ends: str) -> None:
        if not self.stack:
            self._open(0)
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same : same + WIDTH] == self.path[same : same + WIDTH]:
            same += WIDTH
        same //= WIDTH
        while len(self.stack) > same + 1:
            self.stack.pop()
            self.opens.append(False)
        for n in sizes[same:]:
            self._open(n)
        self.path = path
        v = self.stack[-1]
        self.ended[v], self.least[v], self.ends[v] = count, least, ends
        if self.first is None:
            self.first = (path, list(self.stack))

    def rows(self) -> pa.RecordBatch:
        last = list(self.stack)
        opens = np.array(self.opens + [False] * len(last))
        at, n = np.array(self.at), len(self.at)
        close = RangeMinMax(opens).find_close(at)
        after = np.arange(n) + (close - at + 1) // 2
        spine = np.zeros(n, dtype=bool)
        spine[self.first[1]] = spine[last] = True
        depth, parent, n_bytes = np.array(self.depth), np.array(self.parent), np.array(self.bytes)

        total = lambda own: (lambda c: c[after] - c[np.arange(n)])(np.concatenate([[0], np.cumsum(own)]))
        n_convs = total(np.array(self.ended))
        # A leaf is a pair "()": what ranks of pairs up to both ends of a subtree differ by.
        pair = np.zeros(len(opens), dtype=np.int64)
        pair[:-1] = opens[:-1] & ~opens[1:]
        pair[at[spine]] = 0
        rank = np.concatenate([[0], np.cumsum(pair)])
        n_leaves = rank[close + 1] - rank[at]
        saved = total(np.where(spine, 0, (n_convs - 1) * n_bytes))
        least = np.array(self.least)
        by_depth = np.argsort(depth, kind="stable")
        for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:0:-1]:
            np.minimum.at(least, parent[level], least[level])
        has_parent = np.flatnonzero(parent >= 0)
        counted = has_parent[~(spine[has_parent])]
        children = np.bincount(parent[counted], minlength=n)

        side = np.where(np.isin(np.arange(n), self.first[1]), 0, 1)
        shared = int(depth[np.intersect1d(self.first[1], last)].max())
        keys: list[bytes | None] = [None] * n
        for path, nodes in (self.first, (self.path, last)):
            digest = hashlib.md5()
            for k, v in enumerate(nodes):
                if k:
                    digest.update(path[(k - 1) * WIDTH : k * WIDTH])
                keys[v] = digest.copy().digest()
        under = parent >= 0
        spine_parent = under & spine[parent]
        parent_keys = [keys[p] if s and u else None for p, s, u in zip(parent.tolist(), spine.tolist(), under.tolist(), strict=True)]
        parent_conv = np.where(under & ~spine_parent, least[parent], 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(spine), pa.array(np.full(n, self.number, dtype=np.int64)), pa.array(side.astype(np.int32)), pa.array(depth), pa.array(np.full(n, shared)),
                pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()), pa.array(np.where(spine_parent, side[parent], 0).astype(np.int32), mask=~spine_parent),
                pa.array(least), pa.array(parent_conv, mask=~(under & ~spine_parent)), pa.array(n_convs), pa.array(children), pa.array(n_leaves), pa.array(saved),
                pa.array(n_bytes), pa.array(self.ends, pa.string()),
            ],
            names=[c.split()[0] for c in _NODE.split(", ")],
        )


def _shards(nodes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        shard = Shard(number)
        # The run of conversations with the same path: ids ascend, so their digest needs no list.
        path, sizes, count, least, digest = None, [], 0, 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in range(3))
            for conv, own, own_sizes in zip(*columns, strict=True):
                if own == path:
                    count += 1
                    digest.update(f",{conv}".encode())
                    continue
                if path is not None:
                    shard.add(path, sizes, count, least, digest.hexdigest())
                    if len(shard.at) >= nodes:
                        yield shard.rows()
                        number += 1
                        shard = Shard(number)
                path, sizes, count, least, digest = own, own_sizes, 1, conv, hashlib.sha256(str(conv).encode())
        if path is not None:
            shard.add(path, sizes, count, least, digest.hexdigest())
            yield shard.rows()

    return run


def _merged(spines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spine nodes whole (key, parent_key and their values), and shard, side, depth -> conv_id."""
    below = spines.filter("parent_key IS NOT NULL").select("parent_key", "key").distinct().groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("spine_children"))
    nodes = spines.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.max("own_bytes").alias("own_bytes"), F.max("ends").alias("ends"), F.min("shard").alias("owner"),
    )
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("spine_children", F.lit(0).cast("long")))
    own_leaf = (F.col("n_children") == 0).cast("long").alias("own_leaf")
    nodes = materialize(nodes.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "ends", "owner", own_leaf, ((F.col("n_convs") - 1) * F.col("own_bytes")).alias("own_saved")), "trie-spines")
    placed = spines.select("key", "shard", "side", "depth", "shared", "n_leaves", "saved").join(nodes.select("key", "owner", "own_leaf", "own_saved", F.col("conv_id").alias("least")), "key")
    mine = lambda c: F.when(F.col("shard") == F.col("owner"), F.col(c)).otherwise(F.lit(0).cast("long"))
    path = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    branch = Window.partitionBy("shard")
    for c in ("own_leaf", "own_saved"):
        # The last conversation's path leaves the first one's at depth ``shared``: above it both count.
        placed = placed.withColumn(f"{c}_path", F.sum(mine(c)).over(path)).withColumn(f"{c}_side", F.sum(F.when(F.col("side") == 1, mine(c)).otherwise(F.lit(0).cast("long"))).over(branch))
    both = (F.col("side") == 0) & (F.col("depth") <= F.col("shared"))
    added = lambda c: F.col(f"{c}_path") + F.when(both, F.col(f"{c}_side")).otherwise(F.lit(0).cast("long"))
    placed = materialize(placed.select("key", "shard", "side", "depth", "least", (F.col("n_leaves") + added("own_leaf")).alias("n_leaves"), (F.col("saved") + added("own_saved")).alias("saved")), "trie-placed")
    sums = placed.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    up = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "ends").join(sums, "key").join(up, "parent_key", "left")
    return whole, placed.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("above"))


def trie(convs: DataFrame, nodes: int = NODES) -> DataFrame:
    """convs(conv_id, turns) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    n = shuffle_partitions(convs.sparkSession)
    # Digests are joined as text of their hexadecimal digits, so the path is one expression.
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    flat = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    ordered = flat.withColumn("dealt", F.substring("path", 1, RANGE_BYTES)).repartitionByRange(n, "dealt").sortWithinPartitions("path", "conv_id")
    built = materialize(ordered.select("conv_id", "path", "sizes").mapInArrow(_shards(nodes), _NODE), "trie-shards")
    spines = built.filter("spine")
    whole, above = _merged(spines)
    values = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    inner = built.filter("NOT spine")
    deep = inner.filter("parent_side IS NULL").select(*values)
    hung = inner.filter("parent_side IS NOT NULL").drop("parent_conv_id").join(above, ["shard", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("above")).select(*values)
    return whole.select(*values).unionByName(deep).unionByName(hung)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node of the trie of rebuilt conversations."""
    own = materialize(paths(read_table(spark, sf_dir, "conversations")), "trie-paths")
    out = materialize(trie(rebuilt(own)), "trie-nodes")
    discard(own)
    return out


# The checksum of the id's digits, bit by bit; prefixes are lists of turns.
OP13_SQL = """
WITH RECURSIVE tab AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS v FROM (SELECT unnest(range(256)) AS n))),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT own.*, xor(list_reduce(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 9 AS h FROM own, tab),
made AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
step AS (SELECT conv_id, turns, 0 AS d, md5('') AS k, CAST(NULL AS VARCHAR) AS up FROM made UNION ALL
  SELECT conv_id, turns, d + 1, md5(k || turns[d + 1].r || ':' || len(turns[d + 1].r) || turns[d + 1].t), k FROM step WHERE d < len(turns)),
node AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END) AS bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256 FROM step GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, p.conv_id AS parent_conv_id FROM node LEFT JOIN kids ON kids.up = node.k LEFT JOIN node p ON p.k = node.up),
climb AS (SELECT k AS top, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * bytes AS saved, up FROM full_node UNION ALL
  SELECT n.k, c.leaf, c.saved, n.up FROM climb c JOIN full_node n ON n.k = c.up),
sums AS (SELECT top, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climb GROUP BY top)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_node JOIN sums ON sums.top = full_node.k
"""
