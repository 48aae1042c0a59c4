"""The answer pipeline's data steps: query expansion, compression, formatting, final answers, history."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import sentences_with
from lexmill.plans.ranking import global_rank

#: Fixed value: what stands before the passages.
PASSAGES = "Here are the relevant passages from this document: "
RULE = "-" * 100
_FINAL = r"(?s)<final_answer>(.*?)</final_answer>"
#: Words too common to search for by themselves.
COMMON = frozenset("a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split())


def expand(question: str, model: Callable[[str], list[str]] | None = None) -> list[str]:
    """Search queries for a question: the model's, or offline the question and its rarer words."""
    if model is not None:
        return model(question)
    rare = [w for w in re.findall(r"\w+", question) if w.lower() not in COMMON and len(w) > 2]
    return list(dict.fromkeys([question, *([" ".join(rare)] if rare and " ".join(rare) != question else [])]))


def compress(docs: DataFrame, question: str, text: str = "page_content", passages: Callable[[Column], Column] | None = None) -> DataFrame:
    """Documents cut to their passages on the question; those without any go. Offline, sentences that share a word with it."""
    words = [w for w in re.findall(r"\w+", question.lower()) if w not in COMMON]
    found = passages(F.col(text)) if passages else sentences_with(F.col(text), words)
    return docs.withColumn("_p", found).where(F.size("_p") > 0).withColumn(text, F.concat(F.lit(PASSAGES), F.array_join("_p", "\n"))).drop("_p")


def formatted(docs: DataFrame, order: str = "doc_ord", text: str = "page_content") -> DataFrame:
    """One row, `formatted`: the documents as numbered texts (from 0) with their metadata as JSON. docs: a result list."""
    meta = [c for c in docs.columns if c not in (order, text)]
    numbered = docs.withColumn("_n", F.row_number().over(W.orderBy(order)) - 1)
    entry = F.concat(
        F.col("_n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("None")), F.lit("\n Metadata:\n"), F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}),
        F.lit("\nContent:\n"), F.coalesce(text, F.lit("")), F.lit("\n" + RULE),
    )
    rows = numbered.select("_n", entry.alias("e"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "e"))), lambda x: x["e"]), "\n").alias("formatted"))


def final_answer(message: Column) -> Column:
    """What stands in the first final_answer tags; a message without them as it is."""
    return F.when(message.rlike(_FINAL), F.regexp_extract(message, _FINAL, 1)).otherwise(message)


def citations(docs: DataFrame, order: str = "doc_ord") -> DataFrame:
    """Numbered sources (from 1) in order."""
    return global_rank(docs, order, "n").select("n", "title", "source", *[c for c in ("start_page", "end_page") if c in docs.columns])


def resume(messages: DataFrame, prompt: str, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's user and assistant messages in order, after a system message with the prompt."""
    talk = messages.where(F.col("role").isin("user", "assistant")).select(conversation, turn, "role", "text")
    first = messages.select(conversation).distinct().select(conversation, F.lit(-1).cast("long").alias(turn), F.lit("system").alias("role"), F.lit(prompt).alias("text"))
    return first.unionByName(talk)


def allowed(users: DataFrame, whitelist: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Users whose identifier is on the list."""
    return users.join(whitelist.select(F.col("entry").alias(identifier)).distinct(), identifier, "left_semi")


def answer_context(corpus: DataFrame, question: str, retrieve: Callable[[list[tuple[int, str]]], DataFrame], model: Callable[[str], list[str]] | None = None) -> DataFrame:
    """The knowledge-base tool: expand, retrieve for all queries, deduplicate, compress, format."""
    from lexmill.operators.hybrid import deduplicate_hits

    hits = retrieve(list(enumerate(expand(question, model))))
    if "place" not in hits.columns:
        hits = hits.withColumn("place", F.col("rank"))
    docs = deduplicate_hits(hits.select("qid", "doc_ord", "place"), corpus)
    order = F.row_number().over(W.orderBy("qid", "place"))
    return formatted(compress(docs.withColumn("doc_ord", order).drop("qid", "place"), question))


def respond(messages: list[dict], model: Callable[[list[dict]], dict], search: Callable[[str], str]) -> str:
    """The tool loop: until the model asks for no search, each search's text is added to the messages."""
    messages = [*messages, model(messages)]
    while messages[-1].get("search"):
        messages += [{"role": "tool", "text": search(messages[-1]["search"])}]
        messages += [model(messages)]
    found = re.search(_FINAL, messages[-1]["text"])
    return found[1] if found else messages[-1]["text"]
