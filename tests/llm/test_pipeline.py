"""The pipeline's stages, one after the other, on the smallest documents, on hard rows and on nothing."""

from collections import Counter

import corpus_pipeline
from marlstone.llm.common import Scratch

SF = "/root/testdata/sf0.001"
MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_stages_take_effect(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, {"start": docs.count()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, SF))
        counts[name] = docs.count()
        assert docs.columns == (columns if name != "shard" else [*columns, *MADE])
        if name == "toxicity":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert all(i in kept for i, t in labels.items() if not t)
        if name == "decontaminate":
            assert docs.select("doc_id").distinct().count() == counts[name]
        if name == "shard":  # every text is there, once for each copy
            assert Counter(tuple(r) for r in docs.select(*columns).collect()) == Counter(tuple(r) for r in before.collect())
    assert counts["start"] >= counts["toxicity"] > counts["near_dedup"] >= counts["decontaminate"]
    slots = Counter()
    for r in docs.collect():
        slots[r.shard] += 1
    assert len(slots) == 8 and all(sorted(r.slot for r in docs.filter(f"shard = {s}").collect()) == list(range(n)) for s, n in slots.items())


def test_hard_rows_and_empty_tables_go_through(spark):
    """Nulls in every column, empty texts, repeated rows and columns with names that operators use themselves."""
    scratch = Scratch(spark, "test")
    rows = [(1, None, "a", 7, 1, "x"), (1, None, "a", 7, 1, "x"), (None, "some words here", None, None, None, None), (2, "", "a", 1, 2, "y"), (3, "three words more", "b", 2, 3, "z"), (3, "three words more", "b", 2, 3, "z"), (None, None, None, None, None, None)]
    docs = scratch.keep(spark.createDataFrame(rows, "doc_id long, text string, source string, row_number long, copy int, uid string").coalesce(1))
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF))
        assert docs.columns == (columns if name != "shard" else [*columns, *MADE])
        left[name] = Counter((r.doc_id, r.text) for r in docs.collect())
    once = Counter(r[:2] for r in rows) - Counter([(3, "three words more")])
    assert left["toxicity"] == Counter(r[:2] for r in rows) and left["near_dedup"] == left["decontaminate"] == once
    assert left["mix"] == left["shard"] and set(left["mix"]) <= set(once)
    nothing = scratch.keep(spark.createDataFrame([], docs.select(*columns).schema))
    for _, stage in corpus_pipeline.STAGES:
        nothing = scratch.keep(stage(spark, nothing, SF))
        assert nothing.count() == 0


def test_run_on_all_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(found.columns)
