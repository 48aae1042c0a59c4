from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lexmill.llm import exact_dedup, mixing, sharding


def test_exact_dedup(spark, docs, rows, none):
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    for bare, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        name = hashlib.sha256(bare.encode()).hexdigest()
        mine = [g for g in got if g.text_sha256 == name]
        assert len(mine) == len(members) and {(g.keep_id, g.group_size) for g in mine} == {(best[0], len(members))}
        assert all(g.kept == (g.doc_id == best[0]) for g in mine)
    assert exact_dedup.deduplicate(none).count() == 0


def test_index_persists_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    a = spark.createDataFrame([(1, "x y"), (2, "xy"), (3, "z")], "doc_id long, text string")
    assert index.add(exact_dedup.digests(a)).count() == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    again = exact_dedup.DigestIndex(spark, path)
    b = spark.createDataFrame([(4, "x\ty "), (5, "w"), (6, None)], "doc_id long, text string")
    new = again.add(exact_dedup.digests(b))
    assert sorted(r.keep_id for r in new.collect()) == [5, 6]
    assert again.buckets == 4 and again.rows().count() == 4
    groups = {r.keep_id: r.group_size for r in again.groups().collect()}
    assert groups == {4: 3, 3: 1, 5: 1, 6: 1}
    plan = exact_dedup.digests(b).hint("merge").join(again.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    assert "Exchange" not in again.groups()._jdf.queryExecution().executedPlan().toString()


def test_batches_meet_what_the_index_has(spark, monkeypatch):
    joins = []
    real = exact_dedup.DigestIndex.add

    def add(self, found):
        joins.append(self.exists)
        return real(self, found)

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", add)
    df = spark.range(60).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    got = exact_dedup.deduplicate(df, batches=3).collect()
    assert joins == [False, True, True]
    assert all(g.keep_id == g.doc_id % 7 and g.group_size == len(range(g.keep_id, 60, 7)) for g in got)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        open_ -= over
    return target


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((g.doc_id, g["size"]) for g in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    taken: Counter = Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - want[g.source]) < 1e-6
        assert g.taken == g.copies * g["size"] <= 3 * g["size"]
        taken[g.source] += g.taken
    for s in sizes:
        longest = max(size(r[1]) for r in rows if r[3] == s)
        assert 0 <= want[s] - taken[s] + 1e-6 and want[s] - taken[s] < longest + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0
    assert mixing.sample(docs).columns == docs.columns
    sampled = Counter(mixing.sample(docs).collect())
    each = {(g.doc_id, g["size"], g.source): g.copies for g in got}
    assert sampled == Counter({x: n * each[x.doc_id, size(x.text), x.source] for x, n in Counter(docs.collect()).items()}) + Counter()


def test_mixing_passes_equal_one_walk(spark, monkeypatch, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "FEW_ROWS", 3)
    monkeypatch.setattr(mixing, "BINS", 4)
    assert sorted(mixing.mix(df).collect()) == want
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(mixing.mix(df).collect()) == want


def test_pareto_chances(spark):
    """Longer documents have better odds of their own: copies go with the bits of the word count."""
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a b' ELSE 'a b c d e f g h' END AS text", "CASE WHEN id < 2000 THEN 'p' ELSE 'q' END AS source")
    got = mixing.mix(df).groupBy("source", "size").agg({"copies": "avg", "taken": "sum"}).collect()
    mean = {(r.source, r["size"]): r["avg(copies)"] for r in got}
    # 20,000 words at 5 to 2, from 10,000 each. Classes 2 and 4 (two words, eight words): rate * (2 * 2000 + 4 * 8000) words.
    for source, target in (("p", 20000 * 5 / 7), ("q", 20000 * 2 / 7)):
        rate = target / (2 * 2000 + 4 * 8000)
        assert abs(mean[source, 2] - 2 * rate) < 0.05 and abs(mean[source, 8] - 4 * rate) < 0.02
        assert abs(sum(r["sum(taken)"] for r in got if r.source == source) - target) <= 0.001 * target + 8


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((g.doc_id, g["size"], g.text_crc32) for g in got) == Counter((r[0], len((r[1] or "").encode()) + 1, crc(r[1])) for r in rows)
    slots = defaultdict(list)
    for g in got:
        assert g.law == "bytes" and 0 <= g.shard < 16 and g.grown_shard is None
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0


def test_shards_balance_with_a_hot_text(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text' ELSE concat('text ', id) END AS text")
    got = sharding.shard_documents(df).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    sums = [r["sum(size)"] for r in got]
    assert len(got) == 16 and max(sums) - min(sums) < 0.05 * max(sums)
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in got)


def test_groups_under_the_tolerance_stay_whole(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('a text that is shared ', repeat(cast(id % 1000 as string), 20)) AS text")
    got = sharding.shard_documents(df)
    assert got.groupBy("text_crc32").agg({"shard": "min"}).count() == got.select("text_crc32", "shard").distinct().count()
    sums = [r[1] for r in got.groupBy("shard").agg({"size": "sum"}).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.05 * max(sums)


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op3_mixing", "op2_decontamination"])
def test_against_sql(spark, sf_dir, name):
    from lexmill.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    a, b = (sorted(map(repr, x[columns].itertuples(index=False, name=None))) for x in (got, want))
    assert a == b
