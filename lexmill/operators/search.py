"""Boolean search over a corpus: filter, count, ranked results with snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.snippets import snippets
from lexmill.plans import boolean
from lexmill.plans.ranking import global_rank


def search_filter(query: str, text: Column, exact: bool = False) -> Column:
    return boolean.condition(boolean.parse(query), text, exact)


def find(corpus: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """Rows of the corpus (doc_ord, page_content, ...) that match."""
    return corpus.where(search_filter(query, F.col("page_content"), exact))


def search(corpus: DataFrame, query: str, exact: bool = False, strict_cap: bool = False, many_hits: bool = True) -> DataFrame:
    """rank (from 1, in corpus order), title, source and snippet of every hit.

    The ranks are places in one global order, found by ranges of it, at the price of two more scans;
    with many_hits=False one task numbers the hits, which is quicker where they are few."""
    hits = find(corpus, query, exact).select("doc_ord", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("source", F.lit("Unknown")).alias("source"), snippets(F.col("page_content"), boolean.terms(boolean.parse(query)), strict=strict_cap).alias("snippet"))
    ranked = global_rank(hits, "doc_ord") if many_hits else hits.withColumn("rank", F.row_number().over(W.orderBy("doc_ord")))
    return ranked.select("doc_ord", "rank", "title", "source", "snippet")


def rendered(results: DataFrame) -> str:
    """The results as one text, in order."""
    rows = results.orderBy("rank").toLocalIterator()
    return "".join(f"\n{r['rank']}. {r['title']} (Source: {r['source']})\nSnippet: {r['snippet']}\n\n" for r in rows)


def postings(corpus: DataFrame) -> DataFrame:
    """(token, doc_ord): an inverted index for exact search; write it bucketed by token."""
    from lexmill.functions.text import words

    return corpus.select("doc_ord", F.explode(F.array_distinct(words(F.col("page_content")))).alias("token"))


def find_by_postings(index: DataFrame, query: str) -> DataFrame:
    """doc_ord of exact matches, by semi-joins (AND) and unions (OR) of posting lists."""

    def build(tree: boolean.Tree) -> DataFrame:
        if isinstance(tree, boolean.Term):
            return index.where(F.col("token") == tree.text.lower()).select("doc_ord")
        left, right = build(tree.left), build(tree.right)
        return left.join(right, "doc_ord", "left_semi") if tree.op == "AND" else left.union(right).distinct()

    tree = boolean.simplify(boolean.parse(query))
    return index.select("doc_ord").where(F.lit(False)) if tree is None else build(tree)
