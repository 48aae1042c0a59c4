"""Toxicity by nearest labelled examples: TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of 4, 5 and 6 bytes (stems, for inflected forms). From about
TRAIN_ROWS labelled rows, drawn by a hash of doc_id, the terms that go with the label are kept (a
z-score of their rates of LEAST_Z or more); their document frequencies are counted over all documents. Rows
that have any of them are the examples (at most EXAMPLES). A document's K nearest examples by exact cosine are found by taking blocks of postings
in the order of their upper bounds, until no block left can hold a nearer one. They vote by their
cosine; the vote is turned into a rate by isotonic regression on the examples' own leave-one-out
votes. A document with no kept term scores the rate of the labelled rows that have none.

Labels are looked up by doc_id for training only; no score has label, language, source or doc_id
as an input.

Defined cases: a null doc_id is dealt to a fold as the text "null"; null and wordless texts have no term; rows whose label is null don't train, and
labels that differ for one doc_id are averaged; without labelled rows every score is 0; rows may
repeat; an empty table gives an empty result; other columns pass through unread (names beginning
with _tox_ must be free: a clash is an error before any work).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import shared, tokens

TRAIN_ROWS = 20_000
EXAMPLES = 4096
K = 15
BLOCK = 64
#: Least z-score, and least labelled rows with the term, for a term to be kept.
LEAST_Z, LEAST_ROWS = 6.0, 4
STEMS = (4, 5, 6)
CHUNK_BYTES = (1 << 20) - 4096


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and stem."""
    w = tokens.words(data, offs, tokens.WORDS)
    docs, hashes = [w.doc], [w.hash]
    long = [np.flatnonzero(w.end - w.start > k) for k in STEMS]
    begin = [w.start[x] for x in long]
    sums = tokens.prefix_at(tokens.WORDS[data], *begin, *[a + k for a, k in zip(begin, STEMS, strict=True)])
    for i, k in enumerate(STEMS):
        docs.append(w.doc[long[i]])
        stem = (sums[len(STEMS) + i] - sums[i]) * tokens.power(begin[i], True)
        hashes.append(tokens.mix(stem ^ np.uint64(0x5851F42D4C957F2D * k & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(docs), np.concatenate(hashes)


def _tally(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, n, y = (np.concatenate(x) for x in zip(*rows, strict=True))
    names, which = np.unique(h, return_inverse=True)
    return names, np.bincount(which, n, len(names)), np.bincount(which, y, len(names))


def _count(batches):
    """By term: labelled rows with it, and their labels' sum."""
    rows: list = []
    size = 0
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            doc, h = terms(*shared.text_buffers(part.column(1)))
            label = part.column(0).to_numpy()
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, bool)
            rows.append((h[fresh], np.ones(int(fresh.sum())), label[doc[fresh]]))
            size += int(fresh.sum())
            if size > 2_000_000:
                rows = [_tally(rows)]
                size = 0
    if rows:
        names, n, y = _tally(rows)
        for a in range(0, len(names), 50_000):
            s = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[s].view(np.int64)), pa.array(n[s]), pa.array(y[s])], names=["term", "n", "y"])


class Vocabulary:
    """Kept terms, sorted by hash, with their idf."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def vectors(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of unit TF-IDF vectors over the kept terms, in the order of document and term."""
        doc, h = terms(data, offs)
        maybe = np.flatnonzero(self.known[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), max(len(self.hashes) - 1, 0))
        ok = self.hashes[at] == h[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
        code, times = np.unique(doc[maybe[ok]] * max(len(self.hashes), 1) + at[ok], return_counts=True)
        doc, term = code // max(len(self.hashes), 1), code % max(len(self.hashes), 1)
        weight = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, weight * weight, len(offs) - 1))
        return doc, term, weight / norm[doc] if len(doc) else weight


class Index:
    """Postings by term, in blocks of BLOCK examples, with each term's largest weight in each block."""

    def __init__(self, n_terms: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray, label: np.ndarray):
        self.label = label
        self.blocks = max(1, -(-len(label) // BLOCK))
        order = np.lexsort((example, term))
        self.example, term, self.weight = example[order], term[order], weight[order]
        cell = term * self.blocks + self.example // BLOCK
        #: Postings of a term in a block are start[cell] to start[cell + 1].
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (above 0), nearest first, ties to the first example."""
        bound = weight @ self.most[term]
        best, ids = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) >= k and best[k - 1] > bound[b] + 1e-9):
                break
            score = np.zeros(BLOCK)
            for t, w in zip(term.tolist(), weight.tolist(), strict=True):
                c = t * self.blocks + b
                s = slice(self.start[c], self.start[c + 1])
                score[self.example[s] - b * BLOCK] += w * self.weight[s]
            has = np.flatnonzero(score > 0)
            has = has[has + b * BLOCK != skip]
            best, ids = np.concatenate((best, score[has])), np.concatenate((ids, has + b * BLOCK))
            top = np.lexsort((ids, -best))[:k]
            best, ids = best[top], ids[top]
        return ids, best


def vote(index: Index, ids: np.ndarray, cosine: np.ndarray) -> float:
    """Distance-weighted share of label 1 among the neighbours."""
    weight = 1 / (1.02 - np.minimum(cosine, 1))
    return float(weight @ index.label[ids] / weight.sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best rising fit (pool adjacent violators), each shrunk by one pseudo-row a half."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b
            pools[-1][2] += 1
        else:
            pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, b2, n2 = pools.pop()
            pools[-1][1] += b2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    def __init__(self, vocabulary: Vocabulary, index: Index, names: np.ndarray, steps: tuple[np.ndarray, np.ndarray], base: float):
        self.vocabulary, self.index, self.names, self.steps, self.base = vocabulary, index, names, steps, base

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        n = len(offs) - 1
        out, evidence = np.full(n, self.base), [[] for _ in range(n)]
        doc, term, weight = self.vocabulary.vectors(data, offs)
        edge = np.searchsorted(doc, np.arange(n + 1))
        for d in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[d], edge[d + 1])
            ids, cosine = self.index.nearest(term[s], weight[s], K)
            if len(ids):
                v = vote(self.index, ids, cosine)
                out[d] = self.steps[1][max(0, int(np.searchsorted(self.steps[0], v, side="right")) - 1)]
                evidence[d] = [int(x) for x in self.names[ids]]
        return out, evidence


def _idf(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each term over all documents: one row a task and term is handed on."""
    plain = Vocabulary(hashes, np.ones(len(hashes)))

    def count(batches):
        n, times = 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            for part in shared.chunks(batch, "text", CHUNK_BYTES):
                _, term, _ = plain.vectors(*shared.text_buffers(part.column(0)))
                times += np.bincount(term, minlength=len(hashes))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(hashes))), pa.array(np.concatenate(([n], times)))], names=["term", "n"])

    got = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in got}
    # The vocabulary is sorted by hash; what is returned has the order given.
    rank = np.argsort(np.argsort(hashes))
    return np.array([math.log((1 + n.get(-1, 0)) / (1 + n.get(int(k), 0))) + 1 for k in rank])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """The model from labelled documents that are not held out; None without any."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label)) >= 0.5).cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < F.lit(int(min(1.0, TRAIN_ROWS / max(n, 1)) * (1 << 40)))
    # About TRAIN_ROWS pairs of an id and a label: a bounded broadcast.
    sample = F.broadcast(known.where(share))
    train = shared.written(docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "y", "text").repartition(spark.sparkContext.defaultParallelism), "labelled")
    rows, toxic = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not rows:
        return None
    found = train.select("y", "text").mapInArrow(_count, "term long, n double, y double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    rate = toxic / rows
    # Rate of the label among rows with the term against its rate overall, in standard errors.
    z = (F.col("y") - F.col("n") * F.lit(rate)) / F.sqrt(F.col("n") * F.lit(max(rate * (1 - rate), 1e-9)) * (1 - F.col("n") / F.lit(rows + 1)))
    kept = found.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("y") >= LEAST_ROWS)).select("term").toPandas()
    hashes = kept["term"].to_numpy(np.int64).view(np.uint64)
    vocabulary = Vocabulary(hashes, _idf(docs, hashes))

    def examples(batches):
        for batch in batches:
            for part in shared.chunks(batch, "text", CHUNK_BYTES):
                doc, term, weight = vocabulary.vectors(*shared.text_buffers(part.column(2)))
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x)) for x in (term, weight)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "y", "term", "weight"])

    vectors = shared.written(train.select("doc_id", "y", "text").mapInArrow(examples, "doc_id long, y double, term array<long>, weight array<double>"), "examples")
    none, none_toxic = vectors.where(F.size("term") == 0).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    got = vectors.where(F.size("term") > 0).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(EXAMPLES).collect()
    shared.forget(train, vectors)
    # Examples with like leading terms stand in one block, which keeps the bounds tight.
    got.sort(key=lambda r: (r.term[int(np.argmax(r.weight))], r.doc_id))
    label_ = np.array([r.y for r in got])
    example = np.repeat(np.arange(len(got)), [len(r.term) for r in got]) if got else np.zeros(0, np.int64)
    flat = [np.concatenate([np.asarray(r[k]) for r in got]) if got else np.zeros(0) for k in (2, 3)]
    index = Index(len(vocabulary.hashes), example, flat[0].astype(np.int64), flat[1].astype(float), label_)
    own = []
    for i, r in enumerate(got):
        ids, cosine = index.nearest(np.asarray(r.term), np.asarray(r.weight), K, skip=i)
        own.append(vote(index, ids, cosine) if len(ids) else math.nan)
    votes = np.array(own)
    ok = ~np.isnan(votes)
    steps = isotonic(votes[ok], label_[ok]) if ok.any() else (np.zeros(1), np.array([rate]))
    return Model(vocabulary, index, np.array([r.doc_id for r in got], np.int64), steps, (none_toxic + rate) / (none + 1))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with _tox_score, and _tox_evidence: the doc_ids of the nearest examples, nearest first."""
    if clash := [n for n in docs.columns if n.lower() in ("_tox_score", "_tox_evidence")]:
        raise ValueError(f"columns {clash} are taken")
    if model is None:
        return docs.withColumns({"_tox_score": F.lit(0.0), "_tox_evidence": F.array().cast("array<long>")})
    at = docs.columns.index(text)
    names = [*docs.columns, "_tox_score", "_tox_evidence"]
    # Bounded by the terms of TRAIN_ROWS texts and by EXAMPLES.
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in shared.chunks(batch, text, CHUNK_BYTES):
                s, e = m.score(*shared.text_buffers(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(e, pa.list_(pa.int64()))], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField("_tox_score", T.DoubleType()), T.StructField("_tox_evidence", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under one half, as they were."""
    return score(docs, fit(docs, labels)).where("_tox_score < 0.5").select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, shared.read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_tox_score").alias("score"),
        (F.col("_tox_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_tox_evidence").alias("evidence"),
    )
