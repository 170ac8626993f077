"""What the operators of this subpackage share: tables in the shared folder, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, forget, shared_dir

__all__ = ["components", "cut", "forget", "shared_dir"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v: long): (node, component), component the smallest node.

    Alternates large-star and small-star rounds: each node hands its neighbours to the smallest node
    it knows, so a path of n nodes is done in about log n rounds. Every round is a partial aggregate
    and an equi-join and is written to the shared folder; it is done when a round gives the edges it had.
    Self loops and repeated edges are harmless; nodes without edges do not appear.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = known.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        told = known.join(least, "u")
        if large:
            out = told.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def settled(new: DataFrame, old: DataFrame) -> bool:
        sides = new.withColumn("side", F.lit(1)).unionByName(old.withColumn("side", F.lit(-1)))
        return sides.groupBy("u", "v").agg(F.sum("side").alias("side")).filter("side <> 0").isEmpty()

    now, path = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct())
    if not now.isEmpty():
        for _ in range(most_rounds):
            new, new_path = cut(star(star(now, True), False))
            same = settled(new, now)
            forget(spark, path)
            now, path = new, new_path
            if same:
                break
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
