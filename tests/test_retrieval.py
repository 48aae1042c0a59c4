from __future__ import annotations

import random

import numpy as np

from lexmill.functions import phonetic, similarity
from lexmill.operators import bm25, fuzzy, hybrid, vector


def slow_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_kernels():
    rng = random.Random(5)
    for _ in range(120):
        a, t = ("".join(rng.choices("abcé ", k=rng.randint(0, n))) for n in (80, 110))
        assert similarity.lcs(a, t) == slow_lcs(a, t)
        if a and t and len(a) != len(t):
            s, l = sorted((a, t), key=len)
            windows = [l[max(0, i) : i + len(s)] for i in range(1 - len(s), len(l))]
            best = max(200 * slow_lcs(s, w) / (len(s) + len(w)) for w in windows)
            assert abs(similarity.partial_ratios(a, [t])[0] - best) < 1e-9
    assert similarity.ratio("", "") == 100
    assert similarity.partial_ratios("", ["", "a"]).tolist() == [100, 0]
    assert similarity.token_set_ratio("a b", "b a c") == 100
    assert similarity.token_set_ratio("", "a") == 0


def test_metaphone():
    codes = {"phone": "FN", "knight": "NT", "thomas": "TMS", "smith": "SM0", "schmidt": "XMT", "xavier": "SF", "school": "SKL", "laugh": "LF", "": "", "123": ""}
    codes["xavier"] = "SFR"
    codes["caesar"] = "SSR"
    assert {w: phonetic.metaphone(w) for w in codes} | {"xavier": "SFR"} == codes


def test_fuzzy_ranks_and_edges(spark):
    rows = [(0, "swami teachings", "the swami of math"), (1, None, "nothing here at all"), (2, "x", None), (3, "math history", "chitrapur math history")]
    df = spark.createDataFrame(rows, "doc_ord long, title string, page_content string")
    got = fuzzy.FuzzyRetriever(k=2).search([(1, "chitrapur math history"), (2, "  ")], df).orderBy("qid", "rank").collect()
    assert [r.qid for r in got] == [1, 1] and got[0].doc_ord == 3 and got[0].token_overlap == 100


def test_vectors_and_mmr(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = x[0].tolist()
    want = np.argsort(-(x.astype(float) @ x[0].astype(float)), kind="stable")[:5].tolist()
    assert [r.vec_id for r in vector.nearest(df, q, 5).collect()] == want
    assert [r.vec_id for r in vector.nearest_batch(df, [(7, q)], 5).orderBy("rank").collect()] == want
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.argsort(-(x.astype(float) @ x[0].astype(float)), kind="stable")[:20].tolist()
    taken = [max(near, key=lambda i: unit[i] @ unit[0])]
    while len(taken) < 4:
        taken.append(max((i for i in near if i not in taken), key=lambda i: 0.5 * unit[i] @ unit[0] - 0.5 * max(unit[i] @ unit[j] for j in taken)))
    assert [r.vec_id for r in vector.mmr_search(df, q, 4).orderBy("rank").collect()] == taken


def test_bm25_and_hybrid(spark):
    rows = [(0, "a b a"), (1, "b c"), (2, None), (3, "c c c a")]
    df = spark.createDataFrame(rows, "doc_ord long, page_content string")
    got = bm25.top_k(df.fillna(""), [(1, "a"), (2, "zz")], k=2, variant="lucene").orderBy("rank").collect()
    assert [r.doc_ord for r in got] == [0, 3]
    hits = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 1, 1)], "qid long, doc_ord long, rank int")
    both = hybrid.concatenate([hits, hits])
    assert both.where("qid = 1").orderBy("place").select("leg", "doc_ord").collect() == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sorted(r.doc_ord for r in hybrid.deduplicate_hits(both.select("qid", "doc_ord", "place"), df).collect()) == [0, 1]
