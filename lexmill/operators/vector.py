"""Exact vector retrieval: dot product and cosine top-k, and maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query, k: int = 20, metric: str = "dot", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector: a scan and a top-k, no shuffle of vectors."""
    measure = cosine if metric == "cosine" else dot
    scored = vectors.select(key, measure(F.col(embedding), literal(query)).alias("similarity"), embedding)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def nearest_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 20, metric: str = "dot", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """qid, key, similarity, rank: the k nearest for each of a batch of query vectors, in one scan.

    The batch travels with the plan; each row is scored against it as a matrix, and a row's scores
    are cut to the top k by partition before the shuffle."""
    ids = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], np.float64)
    if metric == "cosine":
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(frames):
        best: dict[int, pd.DataFrame] = {}
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in pdf[embedding]])
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            sims = x @ matrix.T
            for j, q in enumerate(ids):
                new = pd.DataFrame({"qid": q, "key": pdf[key].to_numpy(), "similarity": sims[:, j]})
                held = pd.concat([best[q], new]) if q in best else new
                best[q] = held.sort_values(["similarity", "key"], ascending=[False, True]).head(k)
        yield from best.values()

    found = vectors.select(key, embedding).mapInPandas(run, "qid long, key long, similarity double")
    order = W.partitionBy("qid").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def mmr(candidates: list[tuple[int, list[float]]], query, k: int = 5, weight: float = 0.5) -> list[int]:
    """Keys of k candidates, each the best of weight * likeness to the query - (1 - weight) * likeness to those taken."""
    if not candidates:
        return []
    x = np.array([v for _, v in candidates], np.float64)
    q = np.asarray(query, np.float64)
    size = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    unit = x / size[:, None]
    like = unit @ (q / max(np.linalg.norm(q), 1e-300))
    taken: list[int] = []
    nearest_taken = np.full(len(x), -np.inf)
    while len(taken) < min(k, len(x)):
        score = like if not taken else weight * like - (1 - weight) * nearest_taken
        score = score.copy()
        score[taken] = -np.inf
        best = int(np.argmax(score))
        taken.append(best)
        nearest_taken = np.maximum(nearest_taken, unit @ unit[best])
    return [candidates[i][0] for i in taken]


def mmr_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 5, fetch_k: int = 20, weight: float = 0.5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """qid, key, rank: for each query vector the k re-ranked among its fetch_k nearest, which are all that is gathered."""
    asked = dict(queries)
    near = nearest_batch(vectors, queries, fetch_k, key=key, embedding=embedding).select("qid", key, F.col("rank").alias("near"))
    rows = vectors.select(key, embedding).join(F.broadcast(near), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("near")
        qid = int(pdf["qid"].iloc[0])
        picked = mmr(list(zip(pdf[key].tolist(), pdf[embedding].tolist(), strict=True)), asked[qid], k, weight)
        return pd.DataFrame({"qid": qid, key: picked, "rank": range(1, len(picked) + 1)})

    return rows.groupBy("qid").applyInPandas(run, f"qid long, {key} long, rank int")


def mmr_search(vectors: DataFrame, query, k: int = 5, fetch_k: int = 20, weight: float = 0.5, key: str = "vec_id") -> DataFrame:
    """rank and key of the k re-ranked among the fetch_k nearest: only those reach the driver."""
    near = nearest(vectors, query, fetch_k, key=key).collect()
    picked = mmr([(r[key], r["embedding"]) for r in near], query, k, weight)
    return vectors.sparkSession.createDataFrame(list(enumerate(picked, 1)), f"rank int, {key} long")
