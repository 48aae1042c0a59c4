"""Sharding by sampled splitters: shards of near equal bytes, as ranges of a key. DataFrame functions only.

The key is (hash of the text, hash of the row), so equal texts lie side by side. A sample of keys,
drawn in proportion to size, gives quantile boundaries of many fine ranges. A range begins at the
first row of a text, so a group of equal texts is in one range; only a group over TOLERANCE of a
shard, which can't be kept whole if sizes are to be near equal, is cut at sampled rows of its own.
A range that proves overfull is subdivided by a further sample of its keys. Exact sizes by range,
a table with a row for each, then give every row its place among all bytes: the shard is the one
that the middle of the row's group (of the row, in a group that is cut) lies in.

Ranges are searched in the JVM, by halving a literal array of splitters: no Python worker runs.
Their number goes with the rows, ROWS_A_RANGE in each, so no task's range grows with the input.

Defined cases: a null text has no bytes (size 1); rows may repeat, and tie, in every column; two
texts with one 64-bit hash count as one group, which moves some bytes at most; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm import shared

#: Keys drawn for each range; least ranges a shard; rows a range holds, about; most ranges, which bounds the driver's sample.
DRAWN, FINE, ROWS_A_RANGE, MOST_RANGES = 32, 32, 250_000, 1 << 16
#: A group of equal texts above this share of a shard is cut; no other is, so a shard's size may be off by as much.
TOLERANCE = 0.02

Split = tuple[int, int]
_FIRST = -(1 << 63)


def _range_of(rows: DataFrame, splits: list[Split], name: str) -> DataFrame:
    """rows with the number of splitters at or below their (_key, _tie): a search by halves, one projection a step."""
    if not splits:
        return rows.withColumn(name, F.lit(0))
    # Two literal arrays of longs: as text they are folded to one constant each.
    keys, ties = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*splits, strict=True))
    step = 1 << (len(splits).bit_length() - 1)
    rows = rows.withColumn(name, F.lit(0))
    while step:
        to = F.col(name) + step
        at = F.least(to, F.lit(len(splits)))
        key, tie = F.element_at(keys, at), F.element_at(ties, at)
        below = (key < F.col("_key")) | ((key == F.col("_key")) & (tie <= F.col("_tie")))
        rows = rows.withColumn(name, F.when((to <= len(splits)) & below, to).otherwise(F.col(name)))
        step >>= 1
    return rows


def _splitters(keyed: DataFrame, total: int, parts: int, seed: int, hot: list[int]) -> set[Split]:
    """parts - 1 quantiles by size, from a sample that draws each row in proportion to its size; a text's first row, unless it is hot."""
    n = DRAWN * max(parts, 1)
    drawn = F.pmod(F.xxhash64("_key", "_tie", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("size") * F.lit(n / max(total, 1))
    weight = F.greatest(F.lit(total / n), F.col("size").cast("double"))
    # About n rows, whatever the table's size.
    got = sorted((r._key, r._tie, r.w) for r in keyed.where(drawn).select("_key", "_tie", weight.alias("w")).collect())
    whole, upto, k, found, cut = sum(w for _, _, w in got), 0.0, 1, set(), set(hot)
    for key, tie, w in got:
        upto += w
        while k < parts and upto >= whole * k / parts:
            found.add((key, tie if key in cut else _FIRST))
            k += 1
    return found


def assign(rows: DataFrame, shards: int, size: str, key: str, tie: str) -> DataFrame:
    """rows with `shard` and `slot`. size, key, tie: long columns; rows of equal key stay together unless they are many; tie orders those."""
    spark = rows.sparkSession
    keyed = rows.withColumns({"_key": F.col(key), "_tie": F.col(tie), "size": F.col(size)})
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = keyed.groupBy("_key").agg(F.sum("size").alias("b"))
    # At most shards / TOLERANCE groups are that large.
    hot = [r._key for r in groups.where(F.col("b") > F.lit(TOLERANCE * total / shards)).select("_key").collect()]
    ranges = min(MOST_RANGES, max(shards * FINE, n // ROWS_A_RANGE))
    splits = _splitters(keyed, total, ranges, 1, hot)
    # One row for each range.
    most, turn = 3 * total / ranges, 1
    while True:
        # Stored: a filter or join on a range that is still an expression would be pushed through all the steps of the search.
        ranged = shared.written(_range_of(keyed, sorted(splits), "_range"), "ranges")
        sizes = ranged.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("top"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).orderBy("_range").collect()
        # One row, or a group that stays whole, can't be divided.
        full = [r for r in sizes if r.b - r.top > most and (r.lo != r.hi or r.lo in hot)]
        if not full:
            break
        turn += 1
        heavy = sum(r.b for r in full)
        grown = splits | _splitters(ranged.where(F.col("_range").isin([r._range for r in full])).drop("_range"), heavy, max(2, int(2 * heavy / most) + 1), turn, hot)
        if grown == splits:
            break
        shared.forget(ranged)
        splits = grown
    b0 = n0 = 0
    before = []
    for r in sizes:
        before.append((r._range, b0, n0))
        b0, n0 = b0 + r.b, n0 + r.n
    table = spark.createDataFrame(before, "_range int, _b0 long, _n0 long")
    inner = W.partitionBy("_range").orderBy("_key", "_tie")
    upto = inner.rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy("_range", "_key")
    placed = ranged.join(F.broadcast(table), "_range")
    placed = placed.withColumns({"_n": F.col("_n0") + F.row_number().over(inner) - 1, "_b": F.col("_b0") + F.sum("size").over(upto) - F.col("size")})
    placed = placed.withColumns({"_gb": F.sum("size").over(group), "_g0": F.min("_b").over(group)})
    cut = F.col("_key").isin(hot) if hot else F.lit(False)
    middle = F.when(cut, F.col("_b") + F.col("size") / 2).otherwise(F.col("_g0") + F.col("_gb") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(total, 1)))).cast("int")
    placed = shared.written(placed.withColumn("shard", shard).drop("_key", "_tie", "_range", "_b0", "_n0", "_b", "_gb", "_g0"), "sharded")
    shared.forget(ranged)
    # Shards are runs of the global order, so a row's slot is its rank less the shard's first.
    firsts = placed.groupBy("shard").agg(F.min("_n").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_n") - F.col("_first")).drop("_n", "_first")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the text is read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        # Rows without a doc_id are told apart by their place, so that they can be dealt out too.
        F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), F.lit(11)).alias("_row"),
    )
    keys = shared.written(base, "keys")
    out = assign(keys, shards, "size", "_text", "_row")
    shared.forget(keys)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(shared.read_table(spark, sf_dir, "documents"))
