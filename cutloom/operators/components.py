"""Connected components of an edge table, by pointer jumping on least neighbours.

Every vertex points to the least vertex it knows of. A round lets each edge pull both ends' pointers together, then
halves the way to the root by following the pointer's pointer. Both are group-bys and joins: no vertex's neighbours are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.tables import materialize

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges(u, v), root being the least vertex of its component. Any orderable type; no nulls."""
    tidy = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    both = tidy.unionByName(tidy.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = materialize(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        near = both.join(now.withColumnRenamed("v", "x").hint("merge"), F.col("v") == F.col("x")).groupBy(F.col("u").alias("x")).agg(F.min("root").alias("m"))
        pulled = now.join(materialize(near, "nearest").hint("merge"), F.col("v") == F.col("x")).select("v", "root", F.least("root", "m").alias("m"))
        hooks = pulled.groupBy(F.col("root").alias("x")).agg(F.min("m").alias("hook"))  # what any vertex of a tree has seen, its root follows
        hooked = now.join(materialize(hooks, "hooks").hint("merge"), F.col("root") == F.col("x")).select("v", F.col("root").alias("was"), F.least("root", "hook").alias("root"))
        hooked = materialize(hooked, "hooked")
        onward = hooked.select(F.col("v").alias("x"), F.col("root").alias("next"))
        jumped = materialize(hooked.join(onward.hint("merge"), F.col("root") == F.col("x"), "left").select("v", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        if jumped.filter("root <> was").limit(1).count() == 0:
            return jumped.select("v", "root")
        now = jumped.select("v", "root")
    raise RuntimeError("components didn't settle")
