"""Ranks in one global order without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the order key; what the driver holds is one row for each.
RANGES = 256


def global_rank(rows: DataFrame, key: str, name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """rows with their place from 1 in the order of a unique numeric key.

    Approximate quantiles cut the key to ranges; exact counts by range are summed to offsets, and
    rows are numbered within their range."""
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:
        # Quantiles of numeric keys: the range is the number of cuts at or below the key.
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key)))
    ranged = rows.withColumn("_range", place)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    inner = F.row_number().over(W.partitionBy("_range").orderBy(key))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + inner).cast("long")).drop("_range", "_before")
