"""Ingestion: keys, metadata clean-up, article slicing, filters, upsert and insert-only load."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as tx

MOST_TOKENS = 9000
PROMPT_PRICE, ANSWER_PRICE = 3e-6, 15e-6


def doc_key(source: Column, title: Column) -> Column:
    """"source-title"; a null shows as None."""
    return F.concat(F.coalesce(source, F.lit("None")), F.lit("-"), F.coalesce(title, F.lit("None")))


def clean_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become Unknown, scalars stay (as text where they share a column with Unknown), nested values become JSON."""
    done = {}
    for c in columns:
        kind = rows.schema[c].dataType
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        done[c] = F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit("Unknown"))
    return rows.withColumns(done)


def upsert(existing: DataFrame, new: DataFrame, key: str = "doc_key", order: str = "doc_ord") -> DataFrame:
    """New rows over existing ones by key: the last writer's values, the first writer's position.

    One shuffle by key; partial aggregation keeps a key that comes often small."""
    rest = [c for c in existing.columns if c != key]
    rows = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last = F.max(F.struct("_batch", order, *[c for c in rest if c != order])).alias("last")
    first = F.min(F.struct("_batch", order)).alias("first")
    merged = rows.groupBy(key).agg(last, first)
    columns = [F.col(f"last.{c}").alias(c) for c in rest if c != order]
    placed = merged.select(key, F.col("first._batch").alias("_b"), F.col(f"first.{order}").alias("_o"), *columns)
    # Existing positions stay; new ones follow the last of them in their order, as numbers, so the result can be merged again.
    last_old, first_new = existing.agg(F.max(order)).first()[0], new.agg(F.min(order)).first()[0]
    shift = 0 if last_old is None or first_new is None else last_old + 1 - first_new
    at = F.when(F.col("_b") == 0, F.col("_o")).otherwise(F.col("_o") + F.lit(shift)).cast(existing.schema[order].dataType)
    return placed.withColumn(order, at).drop("_b", "_o").select(*existing.columns)


def insert_only(existing: DataFrame, new: DataFrame, key: str = "doc_key") -> DataFrame:
    """The rows of new whose key is not there yet; rows that are there are left as they are."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def unprocessed(paths: DataFrame, known: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """Paths whose base name is not among the known sources."""
    return paths.withColumn("_name", tx.basename(F.col(path))).join(known.select(F.col(source).alias("_name")).distinct(), "_name", "left_anti").drop("_name")


def token_count(text: Column) -> Column:
    """White-space tokens: what stands for a tokenizer's count where none is given."""
    return F.size(tx.raw_words(text)).cast("long")


def bpe_token_count(text: Column, ranks_path: str, pattern: str = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+") -> Column:
    """Tokens by a byte-pair vocabulary file (lines of base64 and rank), loaded once a worker."""
    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        import tiktoken

        found = _ENCODINGS.get(ranks_path)
        if found is None:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            found = _ENCODINGS[ranks_path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return values.map(lambda v: 0 if v is None else len(found.encode_ordinary(v)))

    return count(text)


_ENCODINGS: dict = {}


def short_enough(rows: DataFrame, text: str = "page_content", most: int = MOST_TOKENS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    return rows.where(count(F.col(text)) < most)


#: Where an article stands in its file, and its metadata.
BOUNDARY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "author", "summary", "published_date")] + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "start_page", "end_page")]
)


def page_boundaries(files: DataFrame, text: str = "text") -> DataFrame:
    """An offline rule in place of a model: each page is an article, named by its first line that is not blank."""
    bodies = tx.pages(F.col(text))
    # Ends are counted within the row, so rows of one path don't meet; the delimiter adds a line of its own between pages.
    ends = F.aggregate(bodies, F.array().cast("array<int>"), lambda done, body: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0)) + F.size(F.split(body, "\n"))))
    pages = files.select("*", F.posexplode(F.arrays_zip(bodies.alias("_body"), ends.alias("_end"))).alias("_page", "_at"))
    pages = pages.withColumns({"_body": F.col("_at._body"), "_end": F.col("_at._end")}).withColumn("_lines", F.size(F.split("_body", "\n")))
    # F.trim itself would take the index that transform passes for the characters to trim.
    title = F.coalesce(F.try_element_at(F.filter(F.transform(F.split("_body", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit("Untitled"))
    made = F.struct(
        title.alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("published_date"),
        (F.col("_end") - F.col("_lines")).alias("start_line"), F.col("_end").alias("end_line"), (F.col("_page") + 1).alias("start_page"), (F.col("_page") + 1).alias("end_page"),
    )
    return pages.select(*files.columns, made.alias("boundary"))


def articles(rows: DataFrame, text: str = "text", path: str = "path", one_based: bool = False) -> DataFrame:
    """A document per boundary: its lines of the file, and its metadata. Lines are numbered from 0 unless one_based."""
    b = "boundary"
    return rows.select(
        tx.basename(F.col(path)).alias("source"),
        *[F.col(f"{b}.{c}") for c in ("published_date", "title", "author", "summary", "start_line", "end_line", "start_page", "end_page")],
        tx.slice_lines(F.col(text), F.col(f"{b}.start_line"), F.col(f"{b}.end_line"), one_based).alias("page_content"),
    )


def clean_text(text: Column) -> Column:
    """Blank lines collapsed, then ASCII."""
    return tx.to_ascii(tx.collapse_blank_lines(text))


def model_cost(usage: DataFrame, prompt: str = "prompt_tokens", answer: str = "completion_tokens") -> DataFrame:
    return usage.agg((F.sum(prompt) * F.lit(PROMPT_PRICE) + F.sum(answer) * F.lit(ANSWER_PRICE)).alias("cost"))


def tried(rows: DataFrame, column: str, work: Callable[[str], str]) -> DataFrame:
    """Work done row by row that may fail: result and error columns, so that one bad row fails no batch."""
    @F.pandas_udf("result string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((work(v), None))
            except Exception as e:  # the error is the row's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"])

    return rows.withColumn("_tried", run(F.col(column))).select("*", "_tried.*").drop("_tried")
