"""Distributed union-find over a table of links, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: More rounds than any table of 2**60 nodes needs, as each round at least halves them.
MAX_ROUNDS = 60


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links(a, b) -> (node, root): each linked node with the smallest node it reaches.

    A round hooks each node onto its smallest neighbour, follows the hooks to their ends and
    contracts the links to those ends; at least half of the linked nodes go in each round.
    Hooks come from ``min``, so a node with very many links is folded before the shuffle.
    Rounds are written as tables, which cuts the lineage; each is deleted once its successor
    is written. Self links and repeated links change nothing; links with a null end are
    ignored; no links give no rows; columns other than a and b are not read.
    """
    links = links.select(F.col("a"), F.col("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    edges = materialize(links.filter("a <> b").distinct(), f"{label}-links")
    parents = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        roots = materialize(low.select("node", F.least("node", "low").alias("root")), f"{label}-hooks")
        # Hooks lead to ever smaller nodes; doubling the steps takes each node to the end of its path.
        moving = True
        while moving:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = roots.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
            step = materialize(step, f"{label}-paths")
            discard(roots)
            moving = not step.filter("moved").isEmpty()
            roots = step
        roots_of = roots.select("node", "root")
        old_edges, old_parents = edges, parents
        if parents is None:
            parents = materialize(roots_of, f"{label}-parents")
        else:
            top = roots_of.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parents = materialize(parents.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{label}-parents")
        moved = edges.join(roots_of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            roots_of.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"
        )
        edges = moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = materialize(edges.distinct(), f"{label}-links")
        discard(old_edges, old_parents, roots)
        if edges.isEmpty():
            discard(edges)
            return parents
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
