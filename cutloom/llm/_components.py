"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a group-by minimum and a join; no vertex's neighbours are ever collected, so a hub of any
degree is only a skewed join. The minima are a table before they are joined: a join of two plain exchanges is one whose
large partitions Spark splits, which one of an aggregate's own exchange is not. Each round's edges are a table too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm._tables import materialize

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some vertex has two edges down, or one down and one up: if none has, each edge leads straight to its root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    degrees = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return degrees.agg(F.max((F.col("down") > 1) | (F.col("down") == 1) & (F.col("up") == 1))).first()[0] or False


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges(u, v) but the roots, the least vertex of each component. Any orderable type; no nulls."""
    tidy = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(tidy, "edges")
    for _ in range(MOST_ROUNDS):
        if not _unsettled(now):
            return now.withColumnRenamed("v", "root")
        now = materialize(_small_star(materialize(_large_star(now), "edges")), "edges")
    raise RuntimeError("components didn't settle")
