from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import answer, chatstore, hybrid, ingest, stats
from lexmill.sources import knowledge_base as kb
from lexmill.streaming import ingest as streaming


def doc(source, title, content, **meta):
    return json.dumps({"page_content": content, "metadata": {"source": source, "title": title, **meta}})


def test_jsonl_upsert_keeps_positions(spark, tmp_path):
    path = str(tmp_path / "kb")
    first = tmp_path / "a.jsonl"
    first.write_text("\n".join([doc("s", "1", "one"), doc("s", "2", "two", author=None), ""]) + "\n")
    kb.upsert_jsonl(kb.read_jsonl(spark, str(first)), path)
    second = tmp_path / "b.jsonl"
    second.write_text("\n".join([doc("s", "3", "three"), doc("s", "1", "ONE"), doc("s", "3", "THREE")]))
    kb.upsert_jsonl(kb.read_jsonl(spark, str(second)), path)
    got = kb.read_jsonl(spark, path).orderBy("doc_ord").select("doc_key", "page_content").collect()
    assert got == [("s-1", "ONE"), ("s-2", "two"), ("s-3", "THREE")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"page_content": "x"\n')
    with pytest.raises(Exception):
        kb.read_jsonl(spark, str(bad)).collect()
    with pytest.raises(Exception):
        kb.read_jsonl(spark, str(tmp_path / "none")).collect()


def test_vector_table_inserts_only(spark, tmp_path):
    store = kb.VectorTable(spark, str(tmp_path / "v"))
    schema = "doc_key string, embedding array<float>, metadata map<string,string>"
    store.add(spark.createDataFrame([("a", [1.0], {"v": "1"})], schema))
    store.add(spark.createDataFrame([("a", [2.0], {"v": "2"}), ("b", [3.0], {})], schema))
    assert sorted((r.doc_key, r.embedding[0]) for r in store.rows().collect()) == [("a", 1.0), ("b", 3.0)]
    assert store.fetch(spark.createDataFrame([("b",), ("b",)], "doc_key string")).count() == 1


def test_text_operators(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",), ("",), (None,)], "text string")
    got = df.select(tx.number_lines(F.col("text")).alias("n"), tx.slice_lines(F.col("text"), F.lit(1), F.lit(3)).alias("s"), tx.slice_lines(F.col("text"), F.lit(1), F.lit(3), True).alias("o")).collect()
    assert got[0] == ("1. a\n2. b\n3. c\n4. d", "b\nc", "a\nb\nc")
    assert got[1].n == "1. " and got[2].n is None
    one = spark.createDataFrame([("x\n \t\n\ny  Straße “é”",)], "t string").select(ingest.clean_text(F.col("t")).alias("t")).first()
    assert one.t == 'x\n\ny  Strasse "e"'
    names = spark.createDataFrame([("/a/sun 2020 03.pdf",), ("b 2020.pdf",), ("s 2020 13.pdf",)], "p string").select(tx.canonical_filename(F.col("p"), "Issue").alias("n")).collect()
    assert [r.n for r in names] == ["Issue-2020-March.pdf", None, None]


def test_articles_and_filters(spark):
    files = spark.createDataFrame([("/in/f.txt", "T1\nbody" + tx.PAGE_END + "\nT2\nmore")], "path string, text string")
    got = ingest.articles(ingest.page_boundaries(files)).orderBy("start_page").collect()
    assert [(r.title, r.page_content, r.start_line, r.source) for r in got] == [("T1", "T1\nbody", 0, "f.txt"), ("T2", "\nT2\nmore", 3, "f.txt")]
    paths = spark.createDataFrame([("/x/a.txt",), ("/x/b.txt",)], "path string")
    assert [r.path for r in ingest.unprocessed(paths, spark.createDataFrame([("a.txt",)], "source string")).collect()] == ["/x/b.txt"]
    tried = ingest.tried(paths, "path", lambda p: p if "a" in p else 1 / 0).orderBy("path").collect()
    assert tried[0].result == "/x/a.txt" and "ZeroDivisionError" in tried[1].error
    import public_tokenizers

    n = paths.select(ingest.bpe_token_count(F.col("path"), public_tokenizers.path("byte_bpe_50k.tiktoken")).alias("n")).first().n
    assert n > 1


def test_page_titles_lose_spaces_only(spark):
    texts = ["  calls 830 ", "007\nlast", " \n0" + tx.PAGE_END + "  " + tx.PAGE_END + "500", "", None]
    files = spark.createDataFrame([("/in/f.txt", t) for t in texts], "path string, text string")
    got = ingest.articles(ingest.page_boundaries(files)).collect()
    assert sorted((r.title, r.start_page, r.start_line, r.end_line, r.page_content) for r in got) == sorted(
        [("calls 830", 1, 0, 1, "  calls 830 "), ("007", 1, 0, 2, "007\nlast"), ("0", 1, 0, 2, " \n0"), ("Untitled", 2, 3, 4, "  "), ("500", 3, 5, 6, "500"), ("Untitled", 1, 0, 1, "")]
    )


def test_clean_metadata_and_diff(spark):
    raw = spark.createDataFrame([(1, None, [1]), (2, "x", None)], "id long, a string, b array<int>")
    clean = ingest.clean_metadata(raw, ["a", "b"])
    assert [tuple(r) for r in clean.orderBy("id").collect()] == [(1, "Unknown", "[1]"), (2, "x", "Unknown")]
    assert {(r.id, r.name) for r in stats.changed_values(raw, clean, "id", ["a"]).collect()} == {(1, "a")}


def test_answers(spark):
    m = spark.createDataFrame([("a <final_answer>x\ny</final_answer> <final_answer>z</final_answer>",), ("plain",)], "t string")
    assert [r.a for r in m.select(answer.final_answer(F.col("t")).alias("a")).collect()] == ["x\ny", "plain"]
    docs = spark.createDataFrame([(5, "T", "s", "One thing. No. Other things!"), (6, "U", None, "None.")], "doc_ord long, title string, source string, page_content string")
    kept = answer.compress(docs, "the thing")
    assert [r.page_content for r in kept.collect()] == [answer.PASSAGES + "One thing.\nOther things!"]
    text = answer.formatted(docs).first().formatted
    assert text.startswith('0. T\n Metadata:\n{"title":"T","source":"s"}\nContent:\nOne thing.') and '\n1. U\n' in text
    assert answer.expand("What is the math history") == ["What is the math history", "math history"]
    said = iter([{"role": "ai", "text": "", "search": "q"}, {"role": "ai", "text": "<final_answer>ok</final_answer>"}])
    assert answer.respond([], lambda _: next(said), lambda q: f"found {q}") == "ok"


def test_chat_store(spark):
    steps = spark.createDataFrame([("1", None, "t"), ("2", "1", "t"), ("3", "2", "u"), ("4", None, "u")], "id string, parentId string, threadId string")
    assert {(r.id, r.depth) for r in chatstore.step_depths(steps).collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 0)}
    store = {
        "Thread": spark.createDataFrame([("t",), ("u",)], "id string"),
        "Step": steps,
        "Element": spark.createDataFrame([("e", "u", "3"), ("f", "u", "4")], "id string, threadId string, stepId string"),
        "Feedback": spark.createDataFrame([("x", "2"), ("y", "4"), ("z", None)], "id string, stepId string"),
    }
    left = chatstore.delete_threads(store, spark.createDataFrame([("t",)], "id string"))
    assert [r.id for r in left["Step"].collect()] == ["4"]
    assert [r.id for r in left["Element"].collect()] == ["f"]
    assert {(r.id, r.stepId) for r in left["Feedback"].collect()} == {("x", None), ("y", "4"), ("z", None)}


def test_first_of_each_handles_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i long, k string")
    assert sorted(r.i for r in hybrid.first_of_each(df, ["k"], ["i"]).collect()) == [1, 3]


def test_streaming_upsert(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    target, checkpoint = str(tmp_path / "kb"), str(tmp_path / "cp")
    for k, content in enumerate(("one", "two")):
        (folder / f"{k}.json").write_text(doc("s", "1", content) + "\n" + doc("s", f"n{k}", "x") + "\n")
        streaming.watch_articles(spark, str(folder), target, checkpoint).awaitTermination()
    got = {r.doc_key: r.page_content for r in kb.read_jsonl(spark, target).collect()}
    assert got == {"s-1": "two", "s-n0": "x", "s-n1": "x"}


def test_order_of_several_files_and_a_second_merge(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    sizes = [1, 40, 3, 25]
    n = 0
    for k, size in enumerate(sizes):
        with open(folder / f"part-{k}.json", "w") as out:
            for _ in range(size):
                out.write(json.dumps({"page_content": f"text {n} " + "x" * (n % 7) * 50, "metadata": {"source": "s", "title": str(n)}}) + "\n")
                n += 1
    got = kb.read_jsonl(spark, str(folder)).orderBy("doc_ord").collect()
    assert [r.title for r in got] == [str(i) for i in range(n)] and isinstance(got[0].doc_ord, int)
    path = str(tmp_path / "base")
    kb.upsert_jsonl(kb.read_jsonl(spark, str(folder)), path)
    new = spark.createDataFrame([("s-3", 0, "changed", "s", "3"), ("s-new", 1, "more", "s", "new")], "doc_key string, doc_ord long, page_content string, source string, title string")
    old = kb.read_jsonl(spark, path)
    more = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    merged = ingest.upsert(ingest.upsert(old, more), more.withColumn("page_content", F.lit("again")))
    rows = merged.orderBy("doc_ord").collect()
    assert [r.title for r in rows] == [*[str(i) for i in range(n)], "new"] and rows[3].page_content == rows[-1].page_content == "again"


def test_a_merge_that_was_cut_short_is_taken_back(spark, tmp_path):
    path = str(tmp_path / "base")
    docs = spark.createDataFrame([("s-a", 0, "one", "s", "a")], "doc_key string, doc_ord long, page_content string, source string, title string")
    kb.upsert_jsonl(docs, path)
    os.rename(path, path + ".old-1")
    kb.recover(spark, path)
    assert kb.read_jsonl(spark, path).count() == 1


def test_step_depths_of_long_chains_and_cycles(spark):
    rows = [(str(i), str(i - 1) if i else None) for i in range(300)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.id: (r.root, r.depth) for r in chatstore.step_depths(spark.createDataFrame(rows, "id string, parentId string")).collect()}
    assert got == {str(i): ("0", i) for i in range(300)}


def test_vector_table_keeps_its_layout(spark, tmp_path):
    path = str(tmp_path / "vectors")
    kb.VectorTable(spark, path, 2, "cosine").add(spark.createDataFrame([("a", [1.0, 2.0], {})], kb.VectorTable.SCHEMA))
    again = kb.VectorTable(spark, path, metric="cosine")
    assert again.dimension == 2 and again.rows().count() == 1
    for args in ((3, "cosine"), (2, "dot")):
        with pytest.raises(ValueError):
            kb.VectorTable(spark, path, *args)
    with pytest.raises(Exception, match="not 2 numbers"):
        again.add(spark.createDataFrame([("b", [1.0], {})], kb.VectorTable.SCHEMA))
