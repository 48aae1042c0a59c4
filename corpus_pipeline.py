"""The corpus pipeline: documents in, a sharded training mix out.

Toxic documents go; of each class of near copies one document stays; contaminated documents go;
sources are mixed to their target weights, a document appearing as often as the mix takes it; what
is left is dealt to shards. Each stage sees what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontamination, minhash, mixing, shared, sharding, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. A null or wordless text has no toxic word and stays."""
    return toxicity.drop_toxic(docs, shared.read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id; null texts and rows without a doc_id stay."""
    return minhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words under one in twenty are in windows of the benchmark."""
    return decontamination.decontaminate(docs, shared.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words is never taken, a null source is a source."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in 16 shards of near equal bytes."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages use similarity hashes, suffix arrays and nearest neighbours: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; other columns pass through to the last. An empty table gives an empty result."""
    docs = shared.read_table(spark, sf_dir, "documents")
    stored = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, f"stage-{name}")
            if stored is not None:
                shared.forget(stored)
            stored = docs
    return docs
