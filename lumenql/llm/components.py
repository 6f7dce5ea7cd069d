"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, swept


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = swept(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"))).collect()[0]
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node it can reach.

    Alternating large-star and small-star rounds, each a minimum per node (combined before the
    shuffle) and a join that adaptive execution may split where a node has very many edges. Rounds
    are checkpointed, so a lost executor costs one round. No edge list is ever collected. Nulls,
    loops and repeated edges are ignored; no edges give no rows.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = cut(e)
    before = _mark(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = cut(e)
        now = _mark(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
