"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is an aggregation with partial sums and an equi-join, so a vertex with very many edges
is split by adaptive execution; each round's edges are a table in the shared folder. The steps end
when every component is a star, which one aggregation tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import shared


def _stars(edges: DataFrame) -> bool:
    """Whether no vertex has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n")), F.struct(F.col("v").alias("x"), F.lit(0).alias("n")))).alias("end"))
    seen = ends.groupBy("end.x").agg(F.sum("end.n").alias("smaller"), F.min("end.n").alias("least"))
    return seen.where("smaller > 1 OR (smaller = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least vertex of u's component, for each vertex that is not the least itself. edges: columns u, v."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = shared.written(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Vertices with no smaller neighbour got nothing above; their links are those of the larger side.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = shared.written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        shared.forget(e)
        e = e2
    return e
