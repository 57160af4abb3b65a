"""Pipeline stages against brute force on the whole smallest table, the recall of scattered benchmark items, and very long values."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, site_lines, url_reputation
from marlstone.llm.common import Scratch

from test_llm import brute_components, brute_contained, frame

SF = "/root/testdata/sf0.001"


def test_duplicate_and_leak_stages_match_brute_force(spark):
    """One document of each near-duplicate group stays, the one with the smallest id; then those without a benchmark item."""
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sizes, components = brute_components(rows, 5)
    kept = scratch.keep(stages["near_dedup"](spark, docs, SF))
    first = {}
    for (doc, _), size, component in zip(rows, sizes, components, strict=True):
        first.setdefault(component if size else ("alone", doc), doc)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted((r.doc_id, r.text) for r in kept.collect())
    leaked = {d for d, *_ in brute_contained(left, items)}
    assert leaked and sorted(r.doc_id for r in stages["decontaminate"](spark, kept, SF).collect()) == [d for d, _ in left if d not in leaked]


def test_scattered_items_are_found(spark):
    """Items whose five-word runs stand 60 words apart, nine of ten of them: what is found of all that are contained."""
    rng = np.random.default_rng(11)
    say = lambda n: [f"v{k}" for k in rng.integers(0, 5000, n)]
    items, docs = [], []
    for i, n in enumerate(rng.integers(12, 150, 80)):
        words = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        runs = [words[k : k + 5] for k in range(n - 4)]
        held = [r for r in runs if rng.random() < 0.9]
        docs.append((1000 + i, " ".join(w for run in held for w in [*say(60), *run])))
    want = {(d, i) for d, i, *_ in brute_contained(docs, items)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.97 * len(want), (len(got), len(want))


def test_very_long_urls_and_lines(spark):
    host = "a" * 100_000 + ".example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/" + "x" * 200_000 + "?q"), (2, "http://example.org/en/1" + "y" * 300_000)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1)], "page_id long, good int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, outcomes, [("block", "example.org/es/"), ("allow", "org/")]).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == (host, "/es/" + "x" * 200_000, "example.org/es/") and got[2].rule == "org/"
    line = "z" * 400_000
    docs = Scratch(spark, "test").keep(spark.createDataFrame([(i, f"{line}\nown {i}", "h", "old", 7) for i in range(8)], "doc_id long, text string, source string, clean_text string, n_lines int"))
    found = site_lines.drop_boilerplate(docs, docs["source"], docs["text"], 0.5, 5)
    assert Counter(found.columns) == Counter(["doc_id", "text", "source", "clean_text", "n_lines", "n_dropped"])
    assert {(r.clean_text, r.n_lines, r.n_dropped) for r in found.collect()} == {(f"own {i}", 2, 1) for i in range(8)}
    assert found.select(F.max(F.length("text"))).first()[0] > 400_000
