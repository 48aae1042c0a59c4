from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.snippets import snippet
from lexmill.operators import search
from lexmill.plans import boolean as b

SAMPLE = "The Vishweshwara temple in Benares is a famous Hindu mandir."


def shown(tree) -> str:
    if tree is None:
        return "-"
    return tree.text if isinstance(tree, b.Term) else f"{tree.op}({shown(tree.left)},{shown(tree.right)})"


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("temple", "temple"),
        ("temple AND mandir", "AND(temple,mandir)"),
        ("(temple OR mandir) AND (vishweshwara OR viswesvara)", "AND(OR(temple,mandir),OR(vishweshwara,viswesvara))"),
        ("((swami AND anandashram) OR (swami AND parijnanashram))", "OR(AND(swami,anandashram),AND(swami,parijnanashram))"),
        ("a OR b AND c", "AND(OR(a,b),c)"),
        ("a AND b OR c", "OR(AND(a,b),c)"),
        ("a b", "a"),
        ("a and b", "a"),
        ("a (b)", "a"),
        ("a AND b c", "AND(a,b)"),
        ("a AND", "a"),
        ("AND a", "a"),
        ("AND a b", "AND(a,b)"),
        ("a AND OR b", "OR(a,b)"),
        ("a AND (b", "AND(a,b)"),
        ("a) AND b", "a"),
        ("", "-"),
        ("()", "-"),
        ("AND", "-"),
        ("a AND ()", "AND(a,-)"),
        ("a OR ()", "OR(a,-)"),
        ('"foo bar"', '"foo'),
        ("NOT a", "NOT"),
    ],
)
def test_parse(query, expected):
    assert shown(b.parse(query)) == expected


def test_tokens_and_terms():
    assert b.tokenize("(temple OR mandir) AND (vishweshwara OR viswesvara)") == ["(", "temple", "OR", "mandir", ")", "AND", "(", "vishweshwara", "OR", "viswesvara", ")"]
    tree = b.parse("((swami AND anandashram) OR (swami AND parijnanashram)) AND (teachings OR discourse)")
    assert b.terms(tree) == ["swami", "anandashram", "swami", "parijnanashram", "teachings", "discourse"]


@pytest.mark.parametrize(
    ("query", "substring", "exact"),
    [("temple", True, True), ("mosque", False, False), ("mandir", True, False), ("temple AND mandir", True, False), ("temple AND mosque", False, False), ("temple OR mosque", True, True), ("(temple OR mandir) AND (Vishweshwara OR Viswesvara)", True, True)],
)
def test_sample(spark, query, substring, exact):
    df = spark.createDataFrame([(0, "t", "s", SAMPLE)], "doc_ord long, title string, source string, page_content string")
    assert bool(search.find(df, query).count()) is substring is b.matches(b.parse(query), SAMPLE)
    assert bool(search.find(df, query, True).count()) is exact is b.matches(b.parse(query), SAMPLE, True)


def test_random_queries_agree_with_python(spark):
    rng = random.Random(3)
    words = ["a", "b.", "C", "dd", "é", "%", "_"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(60)] + ["", "x a dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, page_content string")
    asked = [b.random_query(rng, [w.lower() for w in words]) for _ in range(25)]
    flags = df.select("i", *[b.condition(b.parse(q), F.col("page_content"), e).alias(f"c{k}_{int(e)}") for k, q in enumerate(asked) for e in (False, True)]).collect()
    for row in flags:
        for k, q in enumerate(asked):
            for e in (False, True):
                assert row[f"c{k}_{int(e)}"] == b.matches(b.parse(q), texts[row.i], e), (q, texts[row.i], e)


def test_empty_null_and_postings(spark):
    df = spark.createDataFrame([(0, "t", None, "a b"), (1, None, "s", None), (2, "u", "s", "b c a")], "doc_ord long, title string, source string, page_content string")
    assert search.find(df, "").count() == 0
    got = search.search(df, "a").orderBy("rank").collect()
    assert [(r.rank, r.title, r.source) for r in got] == [(1, "t", "Unknown"), (2, "u", "s")]
    many = spark.range(1000).selectExpr("id * 7 AS doc_ord", "'t' AS title", "'s' AS source", "concat('a ', id % 3) AS page_content")
    a, b_ = (sorted(tuple(r)[:2] for r in search.search(many, "1", many_hits=m).collect()) for m in (False, True))
    assert a == b_ and len(a) == 333
    assert search.rendered(search.search(df, "c")) == "\n1. u (Source: s)\nSnippet: b c a\n\n"
    found = search.find_by_postings(search.postings(df), "(a AND c) OR zz")
    assert [r.doc_ord for r in found.collect()] == [2]


def test_snippets():
    assert snippet("x" * 100 + "foo" + "y" * 100, ["foo"]) == "..." + "x" * 50 + "foo" + "y" * 50 + "..."
    assert snippet("a foo b", ["foo"]) == "a foo b"
    near = "foo" + "-" * 50 + "foo" + "-" * 200
    assert snippet("foo" + "-" * 47 + "foo" + "-" * 200, ["foo"]).count("|") == 0
    assert snippet(near, ["foo"]).count("|") == 0
    assert snippet("foo" + "-" * 51 + "foo" + "-" * 200, ["foo"]).count("|") == 1
    far = ("foo" + "-" * 300) * 4 + "bar" + "-" * 300
    assert snippet(far, ["foo", "bar"]).count(" | ") == 3
    assert snippet(far, ["foo", "bar"], strict=True).count(" | ") == 2
    assert snippet(far, ["foo", "foo"]).count(" | ") == 3
    assert snippet("z" * 300, []) == "z" * 200 + "..."
    assert snippet("z" * 200, []) == "z" * 200
