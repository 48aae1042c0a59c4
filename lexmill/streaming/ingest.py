"""Streaming ingestion: new article files are merged into the knowledge base as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import ingest
from lexmill.sources import knowledge_base as kb


def watch_articles(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of article files (one JSON document a line) is upserted by key; a batch that is run again changes nothing."""
    stream = spark.readStream.schema(kb.DOCUMENT).json(folder)
    rows = stream.select("page_content", "metadata.*")

    def merge(batch: DataFrame, _: int) -> None:
        keyed = batch.withColumn("doc_key", ingest.doc_key(F.col("source"), F.col("title"))).withColumn("doc_ord", F.monotonically_increasing_id())
        kb.upsert_jsonl(ingest.short_enough(keyed), target)

    out = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()
