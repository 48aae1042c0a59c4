"""Corpus statistics: token counts, histogram, quantiles, tails, metadata sizes and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
TAIL = 10_000


def quantiles(rows: DataFrame, value: Column, at=QUANTILES) -> DataFrame:
    """(q, value): exact, with linear interpolation. Counts by value come first, so what is merged is distinct values."""
    counts = rows.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.expr(f"percentile(v, array({', '.join(map(str, at))}), n)").alias("p"))
    return all_.select(F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in at]).alias("q"), F.col("p").alias("value"))))


def histogram(rows: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """(bin, n) of equal-width bins from the least to the greatest value; the last includes the greatest."""
    values = rows.select(value.cast("double").alias("v"))
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return rows.sparkSession.createDataFrame([], "bin long, n long")
    width = (hi - lo) or 1.0
    place = F.least(F.floor((F.col("v") - F.lit(lo)) * F.lit(float(bins)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def tail(rows: DataFrame, value: Column, above: int = TAIL) -> DataFrame:
    return rows.where(value > above)


def json_string(value: Column) -> Column:
    """A string as Python's json.dumps shows it where it is plain text: quotes and backslashes escaped."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(escaped, "\n", r"\\n"), "\t", r"\\t"), F.lit('"'))


def serialized(columns: dict[str, Column], numbers: set[str] = frozenset()) -> Column:
    """{"key": value, ...} with a space after commas and colons."""
    parts = []
    for i, (name, value) in enumerate(columns.items()):
        parts.append(F.lit((", " if i else "{") + f'"{name}": '))
        parts.append(value.cast("string") if name in numbers else json_string(value))
    return F.concat(*parts, F.lit("}"))


def changed_values(raw: DataFrame, clean: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, before, after) of the values that differ between two versions of the same rows."""

    def entries(df: DataFrame, as_: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias(as_)) for c in columns])
        return df.select(key, F.inline(pairs))

    return entries(raw, "before").join(entries(clean, "after"), [key, "name"]).where(~F.col("before").eqNullSafe(F.col("after")))
