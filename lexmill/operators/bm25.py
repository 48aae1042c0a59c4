"""BM25 over white-space tokens: corpus statistics, and top-k for queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import raw_words, words

K1, B, EPSILON = 1.5, 0.75, 0.25


def term_counts(corpus: DataFrame, lower: bool = False) -> DataFrame:
    """(doc_ord, token, tf)."""
    cut = words if lower else raw_words
    return corpus.select("doc_ord", F.explode(cut(F.col("page_content"))).alias("token")).groupBy("doc_ord", "token").agg(F.count("*").alias("tf"))


def document_frequencies(corpus: DataFrame, lower: bool = False) -> DataFrame:
    """(token, df); tokens are made distinct within their row, so nothing but df counts is shuffled."""
    cut = words if lower else raw_words
    return corpus.select(F.explode(F.array_distinct(cut(F.col("page_content")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def lengths(corpus: DataFrame, lower: bool = False) -> DataFrame:
    cut = words if lower else raw_words
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(cut(F.col("page_content")))).alias("avgdl"))


def _times(tokens: str, token: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(token))).cast("double")


def top_k(corpus: DataFrame, queries: list[tuple[int, str]], k: int = 4, variant: str = "okapi", lower: bool = False, stored: tuple[int, float, DataFrame] | None = None) -> DataFrame:
    """qid, doc_ord, score, rank. variant: "okapi" (negative idfs become EPSILON times the mean idf) or "lucene" (ln(1 + ...)).

    The corpus is scanned once for statistics and once for scores ("okapi" also counts all tokens, for the mean
    idf); with stored statistics (count, mean length, (token, df) rows of the same corpus) it is scanned once in
    all. Term frequencies of the query's tokens are taken within the row, so no posting is shuffled."""
    cut = words if lower else raw_words
    asked = {i: (q.lower() if lower else q).split() for i, q in queries}
    tokens = sorted({t for ts in asked.values() for t in ts})
    none = corpus.sparkSession.createDataFrame([], "qid long, doc_ord long, score double, rank int")
    if not tokens:
        return none
    if stored is not None:
        n, avgdl, df = stored
        found = {r.token: r.df for r in df.where(F.col("token").isin(tokens)).collect()}
    else:
        df = document_frequencies(corpus, lower)
        own = corpus.select(cut(F.col("page_content")).alias("ws"))
        n, avgdl, *times = own.agg(F.count("*"), F.avg(F.size("ws")), *[F.count_if(F.array_contains("ws", t)) for t in tokens]).first()
        found = {t: x for t, x in zip(tokens, times, strict=True) if x}
    if not n:
        return none
    if variant == "okapi":
        raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean, = df.agg(F.avg(raw)).first()
        plain = {t: math.log((n - x + 0.5) / (x + 0.5)) for t, x in found.items()}
        known = {t: EPSILON * mean if x < 0 else x for t, x in plain.items()}
    else:
        known = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in found.items()}
    all_ = corpus.select("doc_ord", cut(F.col("page_content")).alias("ws"))
    size = F.size("ws")
    parts = []
    for i, ts in asked.items():
        score = F.lit(0.0)
        found = F.lit(False)
        for t in ts:
            if t in known:
                tf = _times("ws", t)
                score = score + F.lit(known[t]) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(avgdl))))
                found = found | (tf > 0)
        parts.append(F.struct(F.lit(i).cast("long").alias("qid"), score.alias("score"), found.alias("found")))
    scored = all_.select("doc_ord", F.inline(F.array(*parts))).where("found")
    best = W.partitionBy("qid").orderBy(F.desc("score"), "doc_ord")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "doc_ord", "score", "rank")
