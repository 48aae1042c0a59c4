"""Fuzzy and phonetic ranked retrieval.

One pass over the corpus scores every document for all queries of a batch (the batch is a few
strings; the corpus is never collected), keeps what passes the threshold, and a per-query window,
which Spark limits before its shuffle, takes the top k."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import phonetic, similarity

#: Metadata that takes part in matching.
FIELDS = ("title", "summary", "description")
_SCORES = "qid long, doc_ord long, ratio double, token_overlap double, phonetic_score double, content_ratio double, metadata_ratio double"


@dataclass(frozen=True)
class FuzzyRetriever:
    k: int = 5
    content_weight: float = 0.9
    metadata_weight: float = 0.1
    threshold: float = 30.0

    def scores(self, queries: list[tuple[int, str]], corpus: DataFrame) -> DataFrame:
        """Scores of every document that passes the threshold, for each (qid, query). A query without words finds nothing."""
        fields = [f for f in FIELDS if f in corpus.columns]
        asked = [(i, q.lower(), set(q.lower().split()), phonetic.codes(set(q.lower().split()))) for i, q in queries if q.split()]
        me = self

        def run(frames):
            for pdf in frames:
                texts = [(t or "").lower() for t in pdf["page_content"]]
                tokens = [set(t.split()) for t in texts]
                # Each distinct word is coded once a worker; a text's codes are a set from the start.
                sounds = [phonetic.codes(t) for t in tokens]
                meta = [[("none" if v is None else str(v).lower()) for v in row] for row in pdf[fields].itertuples(index=False, name=None)] if fields else [[] for _ in texts]
                for qid, q, words, code in asked:
                    partial = similarity.partial_ratios(q, texts)
                    rows = []
                    for ord_, part, have, sound, values in zip(pdf["doc_ord"], partial, tokens, sounds, meta, strict=True):
                        overlap = 100.0 * len(words & have) / len(words)
                        about = max((s for v in values for s in (similarity.ratio(q, v), similarity.token_sets_ratio(code, phonetic.codes(set(v.split()))))), default=0.0)
                        if not me.content_weight * (part + overlap + 100) / 3 + me.metadata_weight * about > me.threshold:
                            continue
                        # Below this the row can't pass, so the exact number isn't needed.
                        least = (me.threshold - me.metadata_weight * about) * 3 / me.content_weight - part - overlap - 1e-6 if me.content_weight else 0.0
                        heard = similarity.token_sets_ratio(code, sound, least)
                        total = me.content_weight * (part + overlap + heard) / 3 + me.metadata_weight * about
                        if total > me.threshold:
                            rows.append((qid, ord_, total, overlap, heard, part, about))
                    yield pd.DataFrame(rows, columns=["qid", "doc_ord", "ratio", "token_overlap", "phonetic_score", "content_ratio", "metadata_ratio"])

        return corpus.select("doc_ord", "page_content", *fields).mapInPandas(run, _SCORES)

    def search(self, queries: list[tuple[int, str]], corpus: DataFrame) -> DataFrame:
        """The k best by (phonetic, overlap, ratio), then corpus order, with their rank from 1."""
        best = W.partitionBy("qid").orderBy(F.desc("phonetic_score"), F.desc("token_overlap"), F.desc("ratio"), "doc_ord")
        return self.scores(queries, corpus).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)
