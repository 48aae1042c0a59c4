"""The registered queries: every operator of the library over the driver's tables, whole."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import phonetic, similarity, snippets
from lexmill.functions import text as tx
from lexmill.operators import answer, bm25, chatstore, fuzzy, hybrid, ingest, search, stats, vector
from lexmill.plans import boolean
from lexmill.plans.ranking import global_rank
from lexmill.plans.stored import scratch
from lexmill.sources import knowledge_base as kb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "(the OR elle) AND ment"
#: Queries of the ranked retrievers, by id.
ASKED = [(1, "the thing of other"), (2, "elle ment une"), (3, "the")]
KEYWORDS = [(1, "the of and"), (2, "elle de la"), (3, "thing that")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.corpus_of(table(spark, sf_dir, "documents"))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ids(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("doc_ord").alias("doc_id"), "source")


def _boolean(name: str, text: str, exact: bool = False) -> None:
    QUERIES[name] = lambda spark, d: _ids(search.find(corpus(spark, d), text, exact))


#: name -> (query, exact)
BOOLEAN = {
    "bool_term": ("the", False),
    "bool_and": ("elle AND ment", False),
    "bool_or": ("elle OR ment", False),
    "bool_nested": (FLAGSHIP, False),
    "bool_deep": ("((the AND of) OR (elle AND une)) AND ((ment OR thing) OR der)", False),
    "bool_leftassoc": ("elle OR the AND thing", False),
    "bool_adjacent": ("elle the", False),
    "bool_dangling": ("AND elle ment", False),
    "bool_unbalanced": ("elle) AND the", False),
    "bool_empty": ("elle AND ()", False),
    "bool_wildcards": ("100% OR _", False),
    "exact_term": ("the", True),
    "exact_and_or": ("(the AND of) OR elle", True),
}
for _name, _args in BOOLEAN.items():
    _boolean(_name, *_args)


@query
def exact_vs_substring(spark, d):
    c, text = corpus(spark, d), F.col("page_content")
    return c.agg(*[F.count_if(search.search_filter("thing", text, e)).alias(n) for n, e in (("n_substring", False), ("n_exact", True))])


@query
def exact_by_postings(spark, d):
    return search.find_by_postings(search.postings(corpus(spark, d)), "(the AND of) OR elle").select(F.col("doc_ord").alias("doc_id"))


@query
def search_count(spark, d):
    return search.find(corpus(spark, d), FLAGSHIP).agg(F.count("*").alias("n"))


@query
def search_results(spark, d):
    return search.search(corpus(spark, d), FLAGSHIP).select(F.col("rank").cast("long").alias("rank"), "title", "source", "snippet")


@query
def snippet_first(spark, d):
    c = search.find(corpus(spark, d), "elle")
    return c.select(F.col("doc_ord").alias("doc_id"), snippets.first_hit(F.col("page_content"), "elle").alias("snippet"))


@query
def snippet_multi(spark, d):
    c = search.find(corpus(spark, d), FLAGSHIP)
    return c.select(F.col("doc_ord").alias("doc_id"), snippets.snippets(F.col("page_content"), boolean.terms(boolean.parse(FLAGSHIP))).alias("snippet"))


@query
def snippet_fallback(spark, d):
    return corpus(spark, d).select(F.col("doc_ord").alias("doc_id"), snippets.fallback(F.col("page_content")).alias("snippet"))


@query
def doc_key(spark, d):
    return corpus(spark, d).select(F.col("doc_ord").alias("doc_id"), ingest.doc_key(F.col("source"), F.col("title")).alias("doc_key"))


@query
def clean_metadata(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")
    return ingest.clean_metadata(rows, ["source", "quality", "toxic"])


@query
def metadata_diff(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")
    return stats.changed_values(rows, ingest.clean_metadata(rows, ["source", "quality", "toxic"]), "doc_id", ["source", "quality", "toxic"])


@query
def kb_upsert(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(ingest.doc_key(F.col("source"), F.col("lang")).alias("doc_key"), F.col("doc_id").alias("doc_ord"), F.col("n_chars"))
    merged = ingest.upsert(rows.where("doc_ord % 2 = 0"), rows.where("doc_ord % 2 = 1"))
    return merged.select("doc_key", F.col("doc_ord").alias("position"), "n_chars")


@query
def kb_stored(spark, d):
    """The knowledge base written in two merges of several files each, and read again."""
    rows = kb.corpus_of(table(spark, d, "documents"))
    rows = rows.withColumn("title", F.concat(F.lit("t"), (F.col("doc_ord") % 700).cast("string"))).withColumn("doc_key", ingest.doc_key(F.col("source"), F.col("title")))
    path = scratch(spark)
    for k in range(2):
        kb.upsert_jsonl(rows.where(F.col("doc_ord") % 2 == k).repartition(3), path)
    found = kb.read_jsonl(spark, path)
    return global_rank(found, "doc_ord", "place").select("place", "source", "title", F.sha2("page_content", 256).alias("content"))


@query
def vector_insert_only(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_key"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "source")
    return ingest.insert_only(vectors, docs).select("doc_key", "source")


@query
def dedup_first(spark, d):
    return hybrid.first_of_each(table(spark, d, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


@query
def filter_existing(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    known = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("?page=2&ref=x")).alias("source"))
    return ingest.unprocessed(paths, known).select("page_id", "path")


@query
def line_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.number_lines(F.col("text")).alias("text"))


@query
def article_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slice_lines(F.col("text"), F.lit(1), F.lit(3)).alias("text"))


@query
def page_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit(tx.PAGE_END)).alias("text"))
    return docs.select("doc_id", F.posexplode(tx.pages(F.col("text"))).alias("page", "body")).withColumn("page", F.col("page").cast("long"))


@query
def articles_of_pages(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.replace(F.col("text"), F.lit("\n"), F.lit(tx.PAGE_END)).alias("text"))
    found = ingest.articles(ingest.page_boundaries(docs))
    return found.select("source", "title", F.col("start_page").cast("long").alias("start_page"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "page_content")


@query
def collapse_blank(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n \t\n")).alias("text"))
    return docs.select("doc_id", tx.collapse_blank_lines(F.col("text")).alias("text"))


@query
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.to_ascii(F.col("text")).alias("text"))


@query
def token_filter(spark, d):
    c = corpus(spark, d)
    return ingest.short_enough(c, most=200).select(F.col("doc_ord").alias("doc_id"), ingest.token_count(F.col("page_content")).alias("n_tokens"))


@query
def filename_canonical(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/sunbeam "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit(" "), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit(".pdf")).alias("path"))
    return kb.renamed(base, tx.canonical_filename(F.col("path"), "Issue")).select("doc_id", "path", "new_path")


@query
def filename_date(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Issue "), F.date_format(F.make_date(F.lit(2000), (F.col("doc_id") % 12 + 1).cast("int"), F.lit(1)), "MMMM"), F.lit(", "), (1990 + F.col("doc_id") % 30).cast("string")).alias("name"))
    return base.select("doc_id", tx.month_and_year(F.col("name")).alias("m")).select("doc_id", "m.month", "m.year")


@query
def token_overlap(spark, d):
    q = ["the", "thing", "of", "other"]
    words = F.array_distinct(tx.words(F.col("text")))
    share = F.size(F.array_intersect(words, F.array(*map(F.lit, q)))) / F.lit(float(len(q))) * 100
    return table(spark, d, "documents").select("doc_id", share.alias("overlap"))


@query
def content_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(tx.words(F.col("text")))).cast("long").alias("n_distinct"))


def _per_text(name: str, score) -> None:
    def run(spark, d):
        @F.pandas_udf("double")
        def f(texts: pd.Series) -> pd.Series:
            return pd.Series(score([(t or "").lower() for t in texts])).round(6)

        return table(spark, d, "documents").select("doc_id", f("text").alias("score"))

    QUERIES[name] = run


_Q = ASKED[0][1]
_per_text("fuzzy_ratio", lambda ts: [similarity.ratio(_Q, t) for t in ts])
_per_text("fuzzy_partial", lambda ts: similarity.partial_ratios(_Q, ts))
_per_text("fuzzy_token_set", lambda ts: [similarity.token_set_ratio(phonetic.phrase(_Q), phonetic.phrase(t)) for t in ts])


@query
def metaphone_codes(spark, d):
    """Codes of the distinct words: each word is coded once."""
    @F.pandas_udf("string")
    def code(words: pd.Series) -> pd.Series:
        return words.map(phonetic.metaphone)

    words = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word")).distinct()
    return words.select("word", code("word").alias("code"))


@query
def fuzzy_topk(spark, d):
    found = fuzzy.FuzzyRetriever().search(ASKED, corpus(spark, d))
    return found.select("qid", F.col("doc_ord").alias("doc_id"), F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in ("phonetic_score", "token_overlap", "ratio")])


def _vector(spark, d, vec_id: int) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


def _between(spark, d, vec_id: int) -> list[float]:
    """A query vector that is no row's own: re-ranking by a row of the table has ties after the first."""
    return [a + 0.5 * b for a, b in zip(_vector(spark, d, vec_id), _vector(spark, d, vec_id + 1), strict=True)]


@query
def knn_dot(spark, d):
    return vector.nearest(table(spark, d, "embeddings"), _vector(spark, d, 0)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def knn_cosine(spark, d):
    return vector.nearest(table(spark, d, "embeddings"), _vector(spark, d, 0), metric="cosine").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def knn_batch(spark, d):
    v = table(spark, d, "embeddings")
    asked = [(r.vec_id, r.embedding) for r in v.where("vec_id < 8").collect()]
    return vector.nearest_batch(v, asked, 5).select("qid", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def mmr(spark, d):
    return vector.mmr_search(table(spark, d, "embeddings"), _between(spark, d, 0)).select(F.col("rank").cast("long").alias("rank"), "vec_id")


def _bm25(variant: str, lower: bool):
    def run(spark, d):
        found = bm25.top_k(corpus(spark, d), KEYWORDS, variant=variant, lower=lower)
        return found.select("qid", F.col("doc_ord").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))

    return run


QUERIES["bm25_topk"] = _bm25("okapi", False)
QUERIES["bm25_lucene"] = _bm25("lucene", True)


@query
def bm25_stats(spark, d):
    return bm25.document_frequencies(corpus(spark, d))


@query
def bm25_lengths(spark, d):
    return bm25.lengths(corpus(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _legs(spark, d):
    c = corpus(spark, d)
    near = vector.mmr_batch(table(spark, d, "embeddings"), [(q, _between(spark, d, q)) for q, _ in ASKED])
    return [fuzzy.FuzzyRetriever().search(ASKED, c), near.withColumnRenamed("vec_id", "doc_ord")]


def _places(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.col("doc_ord").alias("doc_id"), F.col("leg").cast("long").alias("leg"), F.col("place").cast("long").alias("place"))


@query
def hybrid_search(spark, d):
    return _places(hybrid.concatenate(_legs(spark, d)))


@query
def hybrid_three_way(spark, d):
    return _places(hybrid.concatenate([bm25.top_k(corpus(spark, d), ASKED), *_legs(spark, d)]))


@query
def hybrid_union(spark, d):
    """The legs that SQL can restate: exact search, then nearest vectors."""
    hits = search.find(corpus(spark, d), "the AND thing", True).select(F.lit(0).cast("long").alias("qid"), "doc_ord")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("doc_ord")))
    near = vector.nearest_batch(table(spark, d, "embeddings"), [(0, _vector(spark, d, 0))], 5).withColumnRenamed("vec_id", "doc_ord")
    return _places(hybrid.concatenate([hits, near]))


@query
def multi_query_topk(spark, d):
    hits = hybrid.concatenate([bm25.top_k(corpus(spark, d), KEYWORDS, variant="lucene", lower=True)])
    found = hybrid.deduplicate_hits(hits.select("qid", "doc_ord", "place"), corpus(spark, d))
    return found.select(F.col("doc_ord").alias("doc_id"), "qid")


@query
def format_docs(spark, d):
    hits = search.find(corpus(spark, d), "elle AND une", True).orderBy("doc_ord").limit(5)
    return answer.formatted(hits)


@query
def compressed_docs(spark, d):
    return answer.compress(corpus(spark, d), "thing other").select(F.col("doc_ord").alias("doc_id"), "page_content")


@query
def answer_context(spark, d):
    c = corpus(spark, d)
    return answer.answer_context(c, "the thing of other", lambda qs: fuzzy.FuzzyRetriever().search(qs, c))


@query
def final_answer(spark, d):
    c = table(spark, d, "conversations")
    tagged = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("so <final_answer>"), F.col("text"), F.lit("\nend</final_answer> x"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", answer.final_answer(tagged).alias("answer"))


@query
def citations(spark, d):
    return answer.citations(search.find(corpus(spark, d), "elle AND une", True)).select(F.col("n").cast("long").alias("n"), "title", "source")


@query
def chat_resume(spark, d):
    return answer.resume(table(spark, d, "conversations"), "You answer from the archive.")


@query
def whitelist_semi(spark, d):
    entries = kb.whitelist_entries(spark.range(1).select(F.lit("src1, src3,src 5,nobody").alias("v")), "v")
    return answer.allowed(table(spark, d, "documents").select("doc_id", F.col("source").alias("identifier")), entries).select("doc_id", "identifier")


def _tokens():
    return ingest.token_count(F.col("text"))


@query
def corpus_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.max(_tokens()).alias("most_tokens"))


@query
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", _tokens().alias("n_tokens"))


@query
def token_quantiles(spark, d):
    return stats.quantiles(table(spark, d, "documents"), _tokens()).select("q", F.round("value", 6).alias("value"))


@query
def token_histogram(spark, d):
    return stats.histogram(table(spark, d, "documents"), _tokens())


@query
def long_docs(spark, d):
    return stats.tail(table(spark, d, "documents"), _tokens(), 1000).select("doc_id", _tokens().alias("n_tokens"))


@query
def metadata_maxlen(spark, d):
    rows = ingest.clean_metadata(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"])
    text = stats.serialized({"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}, {"n_chars"})
    return rows.agg(F.max(F.length(text)).cast("long").alias("most"))


@query
def llm_cost(spark, d):
    usage = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("chars"))
    usage = usage.select(F.when(F.col("role") != "assistant", F.col("chars")).otherwise(0).alias("prompt_tokens"), F.when(F.col("role") == "assistant", F.col("chars")).otherwise(0).alias("completion_tokens"))
    return ingest.model_cost(usage).select(F.round("cost", 9).alias("cost"))


@query
def fetch_by_ids(spark, d):
    v = table(spark, d, "embeddings")
    return v.join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


def _steps(spark, d):
    """The events as steps: event n hangs on event n // 3, users are threads."""
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3).cast("string")).alias("parentId"), F.col("user_id").alias("threadId"), F.col("event_type").alias("type"), F.col("ts").alias("startTime"), "value")


@query
def step_tree(spark, d):
    return chatstore.step_depths(_steps(spark, d)).groupBy("root", "depth").agg(F.count("*").alias("n")).withColumn("depth", F.col("depth").cast("long"))


@query
def thread_timeline(spark, d):
    s = chatstore.timeline(_steps(spark, d), end="id")
    place = F.row_number().over(W.partitionBy("threadId").orderBy("startTime", F.col("id").cast("long")))
    return s.select("threadId", F.col("id").cast("long").alias("id"), place.cast("long").alias("place"))


@query
def step_counts(spark, d):
    return chatstore.counts(_steps(spark, d))


@query
def feedback_agg(spark, d):
    return chatstore.feedback_summary(_steps(spark, d), "type")


@query
def soft_deleted(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("ts")).alias("deletedAt"))
    return chatstore.live(e).select("event_id")


@query
def tagged_threads(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return chatstore.tagged(chatstore.thread_defaults(t), "click").select("user_id")


@query
def cascade_delete(spark, d):
    s = _steps(spark, d).select("id", "parentId", F.col("threadId").cast("string").alias("threadId"))
    store = {"Thread": s.select(F.col("threadId").alias("id")).distinct(), "Step": s, "Element": s.select(F.concat(F.lit("e"), "id").alias("id"), "threadId", F.col("id").alias("stepId")), "Feedback": s.select(F.concat(F.lit("f"), "id").alias("id"), F.col("id").alias("stepId"))}
    left = chatstore.delete_threads(store, store["Thread"].where("CAST(id AS BIGINT) % 10 = 0"))
    rows = [left[k].agg(F.lit(k).alias("name"), F.count("*").alias("n"), (F.count(F.col("stepId")) if k == "Feedback" else F.count("*")).alias("n_linked")) for k in ("Thread", "Step", "Element", "Feedback")]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    c = search.find(corpus(spark, d), FLAGSHIP)
    return c.select(F.col("doc_ord").alias("doc_id"), "source", snippets.first_hit(F.col("page_content"), "ment").alias("snippet"))


QUERIES["flagship"] = flagship
