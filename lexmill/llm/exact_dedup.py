"""Exact dedup by a persistent digest index, bucketed and sorted by hash. DataFrame functions only.

Texts are equal when identical after deleting ASCII white space. The index is a table with one
row per distinct text, bucketed and sorted by digest: new data is reduced to one row per digest
(map-side partial aggregation first, so a hot text costs each task one row), anti-joined to the
index by a sort-merge join that reads the index without a shuffle, and appended. Texts that the index
has already are appended to a second table of the same buckets, the sightings; a text's group is
what both tables say, which is a merge by bucket. The number of buckets is stored beside the index, and an
index is only opened with its own.

A set of documents is dealt to the index in batches, as a corpus arrives: each batch meets what those
before it have left.

Defined cases: a null text counts as empty; empty texts are equal to one another; of equal texts
the one with the most code points stays, then the smallest doc_id (a null doc_id comes last);
repeated rows count each in group_size; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import shared

#: ASCII white space: tab to carriage return, and space.
WHITE_SPACE = "\t\n\x0b\x0c\r "
#: A digest that holds over 1/HOT_SHARE of all rows is joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Batches that a set of documents is dealt to the index in.
BATCHES = 2
#: Texts a bucket of a new index, at about 90 bytes each.
BUCKET_ROWS = 2_000_000


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, chars, digest): code points of the original text, SHA-256 of the normalised one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(whole, WHITE_SPACE, "")
    return docs.select(F.col(key).alias("doc_id"), F.length(whole).cast("long").alias("chars"), F.sha2(bare.cast("binary"), 256).alias("digest"))


class DigestIndex:
    """One row per distinct text: digest, keep_id, chars, group_size; kept at `path`, bucketed and sorted by digest."""

    COLUMNS = "digest STRING, keep_id BIGINT, chars BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """buckets: fixed for the index's life, and stored with it; choose them for about BUCKET_ROWS texts each (8 if not given)."""
        self.spark = spark
        self.path = path or shared.new_path(spark, "digest-index")
        self.exists = bool(path) and self._stored("layout")
        if self.exists:
            stored = spark.read.parquet(f"{self.path}/layout").first().buckets
            if buckets not in (None, stored):
                raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
            buckets = stored
        elif path and self._stored("texts"):
            raise ValueError(f"the index at {self.path} has no layout: its first batch was cut short; remove it")
        self.buckets = buckets or 8
        name = uuid.uuid4().hex
        self.tables = {kind: f"digest_{kind}_{name}" for kind in ("texts", "seen")}
        for kind, table in self.tables.items():
            # A later session mounts what an earlier one wrote; the layout is declared again.
            spark.sql(
                f"CREATE TABLE {table} ({self.COLUMNS}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'"
            )

    def _stored(self, part: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def rows(self) -> DataFrame:
        """One row for each text, as it was first met."""
        return self.spark.table(self.tables["texts"])

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all that was ever added; both tables are bucketed, so nothing is shuffled."""
        seen = _merged(self.spark.table(self.tables["seen"]), F.sum("group_size")).select("digest", _order().alias("again"), F.col("group_size").alias("more"))
        every = self.rows().withColumn("first", _order()).hint("merge").join(seen, "digest", "left")
        # least() passes over what is null: a text that was never met again.
        return every.select("digest", F.least("first", "again")["id"].alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def _append(self, rows: DataFrame, kind: str) -> None:
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
        out.mode("append").saveAsTable(self.tables[kind])

    def add(self, found: DataFrame) -> DataFrame:
        """Append the texts of `found` (from digests()) that the index lacks, which are returned, and the sightings of those it has."""
        groups = shared.written(_merged(found.withColumn("keep_id", F.col("doc_id")), F.count("*")), "digest-groups")
        known = self.rows().select("digest")
        # New rows are counted against the index as it was, so they are settled before the append.
        new = shared.written(groups.hint("merge").join(known, "digest", "left_anti") if self.exists else groups, "new-digests")
        if self.exists:
            self._append(groups.hint("merge").join(known, "digest", "left_semi"), "seen")
        self._append(new, "texts")
        if not self.exists:
            layout = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"))
            layout.write.parquet(f"{self.path}/layout")
            self.exists = True
        shared.forget(groups)
        return new


def _order() -> F.Column:
    """Most code points first, then the smallest id, null last."""
    return F.struct((-F.col("chars")).alias("less"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"))


def _merged(rows: DataFrame, size: F.Column) -> DataFrame:
    """digest, keep_id, chars, group_size of rows with digest, keep_id and chars."""
    groups = rows.groupBy("digest").agg(F.min(_order()).alias("best"), size.alias("group_size"))
    return groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("chars"), "group_size")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """A row per document with the row that stays for its text, among these and what the index had."""
    spark = docs.sparkSession
    found = digests(docs, text, key)
    # All rows, dealt to batches by doc_id.
    found = shared.written(found.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "digests")
    n = found.count()
    index = index or DigestIndex(spark, buckets=max(8, n // BUCKET_ROWS))
    for batch in range(batches):
        index.add(found.where(F.col("batch") == batch))
    kept = shared.written(index.groups(), "digest-state")
    hot_from = max(2, -(-n // HOT_SHARE))
    # The rows of an older index count too, so the hot ones are taken by rank: HOT_SHARE at most, whatever the input.
    hot = kept.where(F.col("group_size") >= hot_from).orderBy(F.desc("group_size"), "digest").limit(HOT_SHARE)
    names = [r.digest for r in hot.select("digest").collect()]
    is_hot = F.col("digest").isin(names) if names else F.lit(False)
    parts = found.where(~is_hot).hint("merge").join(kept.where(~is_hot), "digest")
    if names:
        parts = parts.unionByName(found.where(is_hot).join(F.broadcast(kept.where(is_hot)), "digest"))
    return parts.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(shared.read_table(spark, sf_dir, "documents"))


SQL_OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY digest) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM g
"""
