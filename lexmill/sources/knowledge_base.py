"""Sources and sinks: the knowledge base, article files, the vector table, whitelists, PDF texts, databases."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import PAGE_END
from lexmill.operators import ingest

METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "published_date", "title", "author", "summary", "description")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "start_page", "end_page")]
)
DOCUMENT = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", METADATA)])


#: Bytes of a file that doc_ord leaves room for: a terabyte.
_FILE_BITS = 40


def _documents(raw: DataFrame) -> DataFrame:
    """Rows with doc_key and doc_ord: places in the order of file name, then of the file's rows, however Spark deals out the files.

    A file's place is its name's rank; a row's is where its split begins plus its number in its task, which is less
    than the bytes of a split that another one follows (such a split is a task of its own). No shuffle is needed."""
    rows = raw.select("page_content", "metadata.*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    names = sorted(r._file for r in raw.select(F.col("_metadata.file_path").alias("_file")).distinct().collect())
    # One row for each file that has any.
    ranks = raw.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_file string, _rank long")
    place = F.shiftleft("_rank", _FILE_BITS) + F.col("_block") + F.col("_row").bitwiseAND((1 << 33) - 1)
    keyed = rows.join(F.broadcast(ranks), "_file").withColumn("doc_key", ingest.doc_key(F.col("source"), F.col("title")))
    return keyed.withColumn("doc_ord", place).drop("_file", "_block", "_row", "_rank")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a line; a malformed line fails the read, a blank one is skipped."""
    return _documents(spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path))


def read_articles(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One JSON document a file."""
    return _documents(spark.read.schema(DOCUMENT).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", pattern).json(folder))


def as_records(docs: DataFrame) -> DataFrame:
    """Rows shaped as the files are: page_content and a metadata struct."""
    return docs.select("page_content", F.struct(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]).alias("metadata"))


def write_jsonl(docs: DataFrame, path: str) -> None:
    """Overwrite."""
    as_records(docs).write.mode("overwrite").json(path, ignoreNullFields=False)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _moved(store, source, target) -> None:
    if not store.rename(source, target):
        raise OSError(f"could not rename {source.toString()} to {target.toString()}")


def recover(spark: SparkSession, path: str) -> None:
    """Put the old version back if an upsert was cut short between its two renames, when nothing is at path."""
    store, at = _store(spark, path)
    if not store.exists(at) and (left := store.globStatus(at.suffix(".old-*"))):
        _moved(store, left[0].getPath(), at)


def upsert_jsonl(docs: DataFrame, path: str) -> None:
    """Merge by key into the file set at path. The result is written beside it whole and then put in its place: a failure
    leaves the old or the new version, there or (between two renames) beside it, from where recover() takes it."""
    spark = docs.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    store, at = _store(spark, path)
    had = store.exists(at)
    # Metadata that the rows don't have is null, as in the files.
    docs = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in METADATA if f.name not in docs.columns})
    old = read_jsonl(spark, path) if had else docs.limit(0)
    merged = ingest.upsert(old, docs.select(*old.columns))
    fresh, aside = at.suffix(f".new-{uuid.uuid4().hex}"), at.suffix(f".old-{uuid.uuid4().hex}")
    as_records(merged.sort("doc_ord")).write.json(fresh.toString(), ignoreNullFields=False)
    if had:
        _moved(store, at, aside)
    try:
        _moved(store, fresh, at)
    except Exception:
        if had:
            _moved(store, aside, at)
        raise
    if had:
        store.delete(aside, True)


class VectorTable:
    """Vectors at a path, all of one dimension and meant for one metric: made where absent, only new ids are added."""

    SCHEMA = "doc_key string, embedding array<float>, metadata map<string,string>"

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, metric: str = "dot"):
        """dimension, metric: kept with the table; another value than the table's is an error. None: any, until a table is made with one."""
        self.spark, self.path = spark, path
        store, at = _store(spark, path)
        layout = f"{path}/_layout"
        if not store.exists(at):
            spark.createDataFrame([], self.SCHEMA).write.parquet(path)
            spark.createDataFrame([(dimension, metric)], "dimension int, metric string").write.json(layout)
        elif store.exists(_store(spark, layout)[1]):
            kept = spark.read.schema("dimension int, metric string").json(layout).first()
            if (dimension is not None and kept.dimension not in (None, dimension)) or kept.metric != metric:
                raise ValueError(f"the table at {path} has dimension {kept.dimension} and metric {kept.metric}")
            dimension = kept.dimension if kept.dimension is not None else dimension
        self.dimension, self.metric = dimension, metric

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def ids(self) -> DataFrame:
        return self.rows().select("doc_key")

    def fetch(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids.select("doc_key").distinct(), "doc_key", "left_semi")

    def add(self, new: DataFrame) -> None:
        if self.dimension is not None:
            fits = F.size("embedding") == self.dimension
            wrong = F.raise_error(F.concat(F.lit(f"not {self.dimension} numbers: "), F.coalesce("doc_key", F.lit("null"))))
            new = new.withColumn("embedding", F.when(F.coalesce(fits, F.lit(False)), F.col("embedding")).otherwise(wrong.cast("array<float>")))
        ingest.insert_only(self.ids(), new.select("doc_key", "embedding", "metadata")).write.mode("append").parquet(self.path)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a comma-separated file; spaces go, line ends stay part of their entry."""
    return whitelist_entries(spark.read.option("wholetext", True).text(path), "value")


def whitelist_entries(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(F.split(F.replace(F.col(column), F.lit(" "), F.lit("")), ",")).alias("entry"))


def read_pdf_texts(spark: SparkSession, folder: str, extract, pattern: str = "*.pdf") -> DataFrame:
    """path and text of the files, by extract(bytes) -> list of page texts; a file that fails has an error instead."""
    @F.pandas_udf("text string, error string")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for raw in content:
            try:
                out.append((PAGE_END.join(extract(bytes(raw))), None))
            except Exception as e:  # one bad file fails no other
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", run("content").alias("r")).select("path", "r.*").withColumn("text", ingest.clean_text(F.col("text")))


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; give partitionColumn, lowerBound, upperBound and numPartitions for a large one."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_bm25(corpus: DataFrame, path: str) -> None:
    """The statistics a BM25 encoder needs: document frequencies, and count and mean length."""
    from lexmill.operators import bm25

    bm25.document_frequencies(corpus).write.mode("overwrite").parquet(f"{path}/df")
    bm25.lengths(corpus).write.mode("overwrite").parquet(f"{path}/lengths")


def read_bm25(spark: SparkSession, path: str) -> tuple[int, float, DataFrame]:
    """What write_bm25() wrote, as bm25.top_k() takes it."""
    n, avgdl = spark.read.parquet(f"{path}/lengths").first()
    return n, avgdl, spark.read.parquet(f"{path}/df")


def renamed(paths: DataFrame, name: Column, path: str = "path") -> DataFrame:
    """paths with new_path: a mapping for copies or renames; nothing is moved."""
    return paths.select("*", F.concat(F.regexp_replace(path, "[^/]*$", ""), name).alias("new_path"))


def corpus_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The test tables' documents in the shape of a corpus."""
    return docs.select(F.col(key).alias("doc_ord"), F.concat(F.lit("doc-"), F.col(key).cast("string")).alias("title"), "source", F.col(text).alias("page_content"))
