"""Hybrid retrieval: result lists of several retrievers one after the other, and order-keeping dedup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concatenate(legs: list[DataFrame]) -> DataFrame:
    """qid, doc_ord, leg, rank, place: each query's hits, leg after leg in their own rank; no scores are fused."""
    rows = reduce(DataFrame.unionByName, [leg.select("qid", "doc_ord", "rank", F.lit(i).alias("leg")) for i, leg in enumerate(legs)])
    return rows.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("leg", "rank", "doc_ord")))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys (null equals null), the first by order; the partial minimum keeps a frequent key small."""
    first = F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("first")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(first).select("first.*").select(*rows.columns)


def deduplicate_hits(hits: DataFrame, corpus: DataFrame, by: str = "content") -> DataFrame:
    """All queries' hits as one list, duplicates left out. by: "content" (text and metadata) or "doc_id"."""
    joined = hits.join(corpus, "doc_ord")
    if by == "doc_id":
        key = ["doc_id"]
    else:
        meta = [c for c in corpus.columns if c not in ("doc_ord", "doc_id", "page_content")]
        joined = joined.withColumn("_key", F.sha2(F.to_json(F.struct("page_content", *meta), {"ignoreNullFields": "false"}), 256))
        key = ["_key"]
    return first_of_each(joined, key, ["qid", "place"]).drop("_key")
