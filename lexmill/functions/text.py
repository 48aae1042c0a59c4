"""Text functions as Column expressions: tokens, lines, pages, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it, for the JVM's and RE2's regular expressions alike.
WHITE_SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
PAGE_END = "\n------- PAGE END -------\n"
SENTENCE_END = r"(?<=[.!?])\s+"


def words(text: Column) -> Column:
    """Lower-cased white-space tokens, in order; punctuation stays attached."""
    return F.filter(F.split(F.lower(text), WHITE_SPACE), lambda x: x != "")


def raw_words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_SPACE), lambda x: x != "")


def number_lines(text: Column) -> Column:
    """Each line with its number, from 1."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def slice_lines(text: Column, start: Column, end: Column, one_based: bool = False) -> Column:
    """Lines start (inclusive) to end (exclusive) counted from 0; with one_based, both inclusive and counted from 1."""
    lines = F.split(text, "\n")
    first = start - 1 if one_based else start
    return F.array_join(F.slice(lines, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int")), "\n")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n" + WHITE_SPACE[:-1] + r"*\n", "\n\n")


def pages(text: Column) -> Column:
    return F.split(text, PAGE_END)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def canonical_filename(path: Column, prefix: str) -> Column:
    """"<name> <yyyy> <mm>.pdf" to "<prefix>-<yyyy>-<Month>.pdf"; null for names of another shape."""
    parts = F.split(F.regexp_replace(basename(path), r"\.pdf$", ""), " ")
    month = F.try_element_at(parts, F.lit(3)).try_cast("int")
    made = F.concat(F.lit(prefix + "-"), F.try_element_at(parts, F.lit(2)), F.lit("-"), F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM"), F.lit(".pdf"))
    return F.when((F.size(parts) == 3) & month.between(1, 12), made)


def month_and_year(name: Column) -> Column:
    """(month, year) read from a free-form name such as "Magazine March, 2020"."""
    pattern = r"([A-Za-z]+),? *(\d{4})"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("month"), F.regexp_extract(name, pattern, 2).alias("year"))


#: Letters without a canonical decomposition, and their ASCII spellings.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def to_ascii(text: Column) -> Column:
    """Accents stripped and common letters and quotes spelled out; what has no ASCII form is left out."""
    table = str.maketrans(SPELLED)

    @F.pandas_udf("string")
    def strip(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v.translate(table)).encode("ascii", "ignore").decode())

    return strip(text)


def sentences_with(text: Column, terms: list[str]) -> Column:
    """Sentences that hold any of the terms, ignoring case."""
    low = [t.lower() for t in terms]

    def any_term(s: Column) -> Column:
        found = F.lit(False)
        for t in low:
            found = found | F.contains(F.lower(s), F.lit(t))
        return found

    return F.filter(F.split(text, SENTENCE_END), any_term)
