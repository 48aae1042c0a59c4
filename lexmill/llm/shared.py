"""What every operator here needs: shared storage, table reading, bounded chunks of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python, which holds 10,000 rows of any size by default.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, unless it has a size of its own: memory outside the heap doesn't go with row size."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; set only where unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        _drop_at_exit(spark, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_pending: list[tuple[SparkSession, str]] = []


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _pending:
        atexit.register(_drop_all)
    _pending.append((spark, path))


def _drop_all() -> None:
    for spark, path in _pending:
        if spark.sparkContext._jsc is None or not spark.sparkContext._gateway:
            return
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and a lost executor costs no recount."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_at)


#: Bits for each row of the filter in likely_among, and its most bits in all (a table of 32 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27


def likely_among(rows: DataFrame, key: str, among: DataFrame, n_rows: int) -> DataFrame:
    """The rows whose long key is in `among` (column key), and a few others: wide rows that a join would drop need not be shuffled.

    A bit table of bounded size is broadcast; where it fills up, all rows pass and the join does the work."""
    size = min(MOST_BITS, 1 << max(10, (n_rows * FILTER_BITS - 1).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(size))
    word = F.shiftright(bit, 6)
    flag = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {size}L) % 64 as int))")
    table = among.select(word.alias("_word"), flag.alias("_flag")).groupBy("_word").agg(F.bit_or("_flag").alias("_bits"))
    table = written(table, "filter")
    hit = rows.withColumns({"_word": word, "_flag": flag}).join(F.broadcast(table), "_word")
    return hit.where(F.col("_bits").bitwiseAND(F.col("_flag")) != 0).select(*rows.columns)


#: Most keys, of two longs, whose table is broadcast: some tens of MB.
FEW_KEYS = 1 << 20


def without(rows: DataFrame, gone: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows whose keys are not among the n of gone: a broadcast if there are few, so that wide rows stay where they are; else a join that deals them out."""
    return rows.join(F.broadcast(gone) if n <= FEW_KEYS else gone.hint("merge"), keys, "left_anti")


def spare(columns: list[str], name: str) -> str:
    """name, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Slices of whole rows holding about most_bytes of the column each (a longer row comes alone)."""
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offs, offs[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
