"""Snippets: the surroundings of the terms that a text was found by."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT, MOST, FALLBACK = 50, 3, 200


def snippet(text: str, terms: list[str], context: int = CONTEXT, most: int = MOST, strict: bool = False) -> str:
    """Windows around hits, in the order of terms and then of places, joined by " | ".

    A hit that begins or ends in an earlier window, bounds included, is passed over. `most` ends the
    search for a term once reached, so each later term may still add a window; strict ends it for all."""
    low, n = text.lower(), len(text)
    windows: list[tuple[int, int]] = []
    for term in map(str.lower, terms):
        if not term or (strict and len(windows) >= most):
            continue
        at = low.find(term)
        while at >= 0:
            end = at + len(term)
            if not any(a <= p <= z for a, z in windows for p in (at, end)):
                windows.append((max(at - context, 0), min(end + context, n)))
                if len(windows) >= most:
                    break
            at = low.find(term, end)
    if not windows:
        return text if n <= FALLBACK else text[:FALLBACK] + "..."
    return " | ".join(("..." if a else "") + text[a:z] + ("..." if z < n else "") for a, z in windows)


def snippets(text: Column, terms: list[str], context: int = CONTEXT, most: int = MOST, strict: bool = False) -> Column:
    """snippet() by Arrow batches; apply it to rows that are already filtered."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else snippet(v, terms, context, most, strict))

    return cut(text)


def first_hit(text: Column, term: str, context: int = CONTEXT) -> Column:
    """The first window of one term, in built-in functions only."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(at - context, F.lit(1))
    end = F.least(at + len(term) + context, F.length(text) + 1)
    inner = F.concat(F.when(begin > 1, "...").otherwise(""), text.substr(begin, end - begin), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, inner).otherwise(fallback(text))


def fallback(text: Column) -> Column:
    return F.when(F.length(text) > FALLBACK, F.concat(F.substring(text, 1, FALLBACK), F.lit("..."))).otherwise(text)
