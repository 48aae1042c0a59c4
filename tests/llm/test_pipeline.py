from __future__ import annotations

import corpus_pipeline
from lexmill.llm import decontamination, minhash, shared, toxicity


def test_stages(spark, sf_dir):
    docs = first = shared.read_table(spark, sf_dir, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"test-{name}")
        kept.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and 0 < len(ids[0]) <= first.count()
    labels, bench = (shared.read_table(spark, sf_dir, t) for t in ("labels", "benchmark"))
    scores = toxicity.score(first, toxicity.fit(first, labels))
    assert ids[0] == {r.doc_id for r in scores.where("_tox_score < 0.5").collect()}
    assert ids[1] == {r.doc_id for r in minhash.classes(kept[0]).where("kept").collect()}
    assert ids[2] == {r.doc_id for r in decontamination.scan(kept[1], bench).where(~decontamination.contaminated()).collect()}
    assert kept[4].count() == kept[3].count()
