"""Steps whose cost has to stay near that of their input."""

import hashlib
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marlstone.functions import codecs, text
from marlstone.functions.analysis import Analyzer
from marlstone.functions.terms import Cutter
from marlstone.functions.vectors import rounded
from marlstone.operators import expressions, fulltext, ranked_index, retrieval, store, vector_index
from marlstone.plans.catalog import ORACLES, QUERIES


def test_addresses_of_many_keys_at_once():
    """20,000 keys there and back; one at a time they took more than 20 s."""
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    start = time.time()
    coded = codecs._addresses(keys, "mm")
    back = codecs._read_addresses(coded)
    assert time.time() - start < 5
    assert len(set(coded)) == len(keys) and all(b[:2] == ("mm", 1) and b[3] is None for b in back)
    assert [b[2] for b in back[:20]] == [codecs.blake3_block(k)[:20] for k in keys[:20]]
    for address, error in ((coded[0][3:], "missing prefix"), (coded[0] + "11", "wrong length"), ("mm:" + "1" * 40, "wrong length"), ("mm:10", "not in base 58: '0'"), (None, "missing prefix")):
        assert codecs._read_addresses([address]) == [(None, None, None, error)]
    assert [codecs.base58_decode(c[3:])[1:21] for c in coded[:20]] == [b[2] for b in back[:20]]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_where_pages_are_read(spark):
    pages = spark.createDataFrame([("a", "one two one"), ("b", "two"), ("c", None), ("d", "")], "slug string, content string")
    made = fulltext.positional_postings(pages, Analyzer())
    assert "Exchange" not in plan(made)
    assert sorted(tuple(r) for r in made.collect()) == [("a", "one", 2, 3, [0, 2]), ("a", "two", 1, 3, [1]), ("b", "two", 1, 1, [0])]


def test_expressions_are_judged_where_postings_are_dealt_by_page(spark):
    """Matches of each expression and page aren't moved again."""
    a = Analyzer()
    index = fulltext.positional_postings(spark.createDataFrame([("a", "x y z"), ("b", "y x"), ("c", "x y w")], "slug string, content string"), a)
    asked = spark.createDataFrame([(0, '"x y"'), (1, "x -w"), (2, '"x y"'), (3, "y OR q z*")], "qid int, query string")
    found = fulltext.search(index, spark.createDataFrame([(3, 8 / 3)], "n long, avg_len double"), asked, a).drop("rank")
    assert not [line for line in plan(found).splitlines() if "hashpartitioning(qid" in line and "slug" in line]
    assert sorted((r.qid, r.slug) for r in found.collect()) == [(0, "a"), (0, "c"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a")]


def test_asked_postings_move_as_a_row_of_each_page(spark, monkeypatch):
    """A row for each posting took four times the room; runs end anywhere, so a page may become two rows."""
    texts = [("a", "x y x z"), ("b", "y y"), ("c", "z x")]
    index = fulltext.positional_postings(spark.createDataFrame(texts, "slug string, content string").coalesce(1), Analyzer())
    asked = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "term string, ask long")
    numbered = index.join(F.broadcast(asked), "term")
    assert sorted(r.slug for r in fulltext.packed_by_page(numbered).collect()) == ["a", "b", "c"]
    split = fulltext.packed_by_page(numbered.repartitionByRange(3, "term")).collect()
    assert len(split) > 3
    assert sorted((r.slug, r.doc_len, a, r.places[e - n : e]) for r in split for a, n, e in zip(r.asks, r.counts, r.ends, strict=True)) == sorted((r.slug, r.doc_len, r.ask, r.positions) for r in numbered.collect())
    monkeypatch.setattr(fulltext, "PART", 1)
    queries = spark.createDataFrame([(0, '"x y"'), (1, "z*")], "qid int, query string")
    hits = fulltext.atom_hits(index, fulltext.parsed_atoms(queries, Analyzer()))
    lines = plan(hits).splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(slug" in line]
    assert dealt and all("MapInArrow" in "".join(lines[i + 1 : i + 4]) for i in dealt)
    assert sorted((r.qid, r.slug, r.starts) for r in hits.collect()) == [(0, "a", [0]), (1, "a", [3]), (1, "c", [0])]


def test_windows_are_found_where_packed_pages_are_dealt(spark):
    """Pages of fitting expressions aren't moved again for their windows."""
    a = Analyzer()
    index = fulltext.positional_postings(spark.createDataFrame([("a", "x y z x y"), ("b", "y x")], "slug string, content string"), a)
    atoms = fulltext.parsed_atoms(spark.createDataFrame([(0, '"x y"'), (1, "y -z")], "qid int, query string"), a)
    found = fulltext.best_windows(fulltext.fitting(fulltext.atom_hits(index, atoms), atoms), 3, places=False)
    shown = plan(found)
    assert "asks" in shown and not [line for line in shown.splitlines() if "hashpartitioning(qid" in line and "slug" in line]
    assert sorted((r.qid, r.slug, r.first, r.window_score) for r in found.collect()) == [(0, "a", 0, 1000), (1, "b", 0, 1000)]


def bytes_moved(spark) -> int:
    """Bytes shuffled in this session so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().executorList(False)))


def test_postings_of_many_prefixes_move_once(spark):
    """A posting was moved for its term and for each prefix it fits, so what was moved grew with the prefixes that were asked; and a filter by several hundred prefixes was too deep."""
    word = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 6)
    index = fulltext.positional_postings(spark.range(500).select(F.col("id").cast("string").alias("slug"), word.alias("content")), Analyzer())
    one, digits = "0123456789abcdef", "012345"
    asked = [*one, *[a + b for a in one for b in one], *[a + b + c for a in one for b in digits for c in digits]]
    rows = spark.createDataFrame([(x, True, i) for i, x in enumerate(asked)], "term string, prefix boolean, ask long")
    keyed = fulltext._keyed(index, rows)
    assert keyed.count() == 500 and {r.n for r in keyed.select(F.size("positions").alias("n")).collect()} == {1}
    hits = fulltext.atom_hits(index, fulltext.parsed_atoms(spark.createDataFrame([(i, f"{x}*") for i, x in enumerate(asked)], "qid int, query string"), Analyzer()))
    found = {(r.qid, r.slug) for r in hits.collect()}
    assert found == {(i, r.slug) for r in index.collect() for i, x in enumerate(asked) if r.term.startswith(x)}


def test_terms_that_are_asked_for_in_several_ways(spark, monkeypatch):
    """As a word, as a prefix and by shorter prefixes; the same of many terms as of those that are pushed to the scan, and where tables of them aren't broadcast."""
    texts = [("a", "tea team te t teams " + "x " * 70_000 + "team"), ("b", "te tex"), ("c", "team")]
    index = fulltext.positional_postings(spark.createDataFrame(texts, "slug string, content string"), Analyzer())
    asked = ["te", "te*", "team", "tea*", "t*", "tea* -team", '"te te*"', "teams*", "teamster*", '"x team"']
    atoms = fulltext.parsed_atoms(spark.createDataFrame(list(enumerate(asked)), "qid int, query string"), Analyzer())
    far = 70_005
    want = [(0, "a", [2]), (0, "b", [0]), (1, "a", [0, 1, 2, 4, far]), (1, "b", [0, 1]), (1, "c", [0]), (2, "a", [1, far]), (2, "c", [0]), (3, "a", [0, 1, 4, far]), (3, "c", [0]), (4, "a", [0, 1, 2, 3, 4, far]), (4, "b", [0, 1]), (4, "c", [0])]
    want += [(5, "a", [0, 1, 4, far]), (5, "a", [1, far]), (5, "c", [0]), (5, "c", [0]), (6, "b", [0]), (7, "a", [4]), (9, "a", [far - 1])]
    for name, most in ((None, None), ("PUSHED", 0), ("BROADCAST_ROWS", 0)):
        if name:
            monkeypatch.setattr(fulltext, name, most)
        assert sorted((r.qid, r.slug, r.starts) for r in fulltext.atom_hits(index, atoms).collect()) == sorted(want)


def test_windows_of_many_expressions_at_once(monkeypatch):
    """A few matches at a time against brute force; windows don't reach into another expression's matches."""
    rng = np.random.default_rng(5)
    rows = [(q, int(rng.integers(1, 4)), sorted(rng.choice(90, int(rng.integers(1, 25)), replace=False).tolist())) for q in range(40) for _ in range(int(rng.integers(1, 5)))]
    order = rng.permutation(len(rows))
    page = pa.table({"slug": ["p"] * len(rows), "qid": [rows[i][0] for i in order], "size": pa.array([rows[i][1] for i in order], pa.int32()), "starts": pa.array([rows[i][2] for i in order], pa.list_(pa.int32()))})
    for run in (fulltext.RUN, 30):
        monkeypatch.setattr(fulltext, "RUN", run)
        made = [r for b in fulltext._page_windows(page, 7, True) for r in b.to_pylist()]
        assert sorted(r["qid"] for r in made) == list(range(40))
        for r in made:
            atoms = [(size, starts) for q, size, starts in rows if q == r["qid"]]
            near = lambda at: [[p for p in starts if at <= p < at + 7] for _, starts in atoms]  # noqa: E731, B023
            score, back = max((sum(1000 + len(x) - 1 for x in near(p) if x), -p) for _, starts in atoms for p in starts)
            places = sorted({p + i for (size, _), x in zip(atoms, near(-back), strict=True) for p in x for i in range(size)})
            assert (r["window_score"], r["first"], r["places"]) == (score, -back, places)


def test_compaction_moves_no_postings(spark, tmp_path):
    """Pages are moved to be sorted by slug; their postings, several times the bytes, are sorted in runs where they are read."""
    s = store.open_store(spark, str(tmp_path / "s"))
    word = F.substring(F.sha2(F.concat_ws(" ", "id", "k"), 256), 1, 6)
    pages = spark.range(600).select("id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("k")).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("content")).select(F.col("id").cast("string").alias("slug"), "content")
    for k in (0, 1):
        s.upsert_pages(pages.filter(F.col("slug").cast("long") % 2 == k))
    rows, before = s.index().count(), bytes_moved(spark)
    s.compact()
    assert bytes_moved(spark) - before < 600_000
    assert s.index().count() == rows


def test_ranked_postings_are_not_moved(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").cast("string").alias("slug"), F.concat_ws(" ", F.lit("for"), F.sha2(F.col("id").cast("string"), 256), F.sha2((-F.col("id")).cast("string"), 256)).alias("content"))
    index = fulltext.positional_postings(pages, Analyzer(), positions=False)
    figures = spark.createDataFrame([(3000, 3.0)], "n long, avg_len double")
    before = bytes_moved(spark)
    made = ranked_index.RankedIndex(spark, str(tmp_path / "r")).build(index, figures)
    assert bytes_moved(spark) - before < 10_000
    found = made.top(["for"], 4)
    assert [r.slug for r in found.pages.collect()] == ["0", "1", "10", "100"] and found.total == 3000


def test_slugs_of_latin_letters_and_scripts_meet_python_little(spark):
    """Only texts with a character that stands for several go to Python; scripts are counted in one pass."""
    rows = [("Crème brûlée & Ｆｕｌｌ ①",), ("ﬁne ½ cup",), ("plain",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.s for r in df.select(text.slugify_all(F.array("t"))[0].alias("s")).collect()] == ["creme-brulee-and-full-1", "fine-1-2-cup", "plain", None]
    assert df.filter(text._stands_for_more(F.col("t"))).count() == 1
    assert "regexp_count" not in plan(df.select(text.detect_script(F.col("t"))))
    many = spark.createDataFrame([("aé東🚀я!⁉",)], "t string").select(text._script_counts(F.col("t")).alias("c")).first().c
    assert many == [2, 1, 2, 1, 0, 0, 0, 0, 1]


def test_terms_of_texts_are_cut_once(spark):
    """Postings need no shuffle, and the figures come from them."""
    pages = spark.createDataFrame([("a", "one two one"), ("b", None)], "slug string, content string")
    made = retrieval.postings(pages)
    assert "Exchange" not in plan(made) and made.columns == ["slug", "term", "tf", "doc_len"]
    assert tuple(retrieval.figures_of_postings(made, 2).first()) == tuple(retrieval.corpus_figures(pages).first()) == (2, 1.5)


def test_queries_go_out_to_many_cells_in_small_batches(spark, tmp_path, monkeypatch):
    """All cells for each query, in batches of one query."""
    monkeypatch.setattr(vector_index, "PROBED_BYTES", 1)
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)] + [1.0]) for i in range(60)]
    every = spark.createDataFrame(rows, "slug long, embedding array<double>")
    asked = every.filter("slug < 9").withColumnRenamed("slug", "qid")
    found = vector_index.VectorIndex(spark, str(tmp_path / "v")).build(every, cells=5).search(asked, 3, 5)
    exact = vector_index.search_in_blocks(every, asked, 3)
    assert sorted((r.qid, r.slug) for r in found.collect()) == sorted((r.qid, r.slug) for r in exact.collect())


def against_sql(spark, name, folder, table):
    """Rows of a query and of its SQL over one table; floats as they are written, so that the sign of zero counts."""
    pq.write_table(table[1], f"{folder}/{table[0]}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table[0]} AS SELECT * FROM read_parquet('{folder}/{table[0]}.parquet')")
    want = con.sql(ORACLES[name])
    return [sorted(repr(tuple(r)) for r in rows) for rows in (QUERIES[name](spark, str(folder)).select(*want.columns).collect(), want.fetchall())]


def test_numbers_rounded_to_zero_keep_their_sign(spark, tmp_path):
    """Of 51,282 vectors of check_l one had such a number."""
    vectors = [[-1e-7, 1.0] * 16, [0.5, -0.0] * 16, [0.0] * 32, [0.0] * 16 + [1.0] * 16, [3.0] * 4, [], None, [1e30, -1e-30] * 8]
    table = pa.table({"vec_id": range(len(vectors)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * len(vectors)})
    got, want = against_sql(spark, "mrl_vectors", tmp_path, ("embeddings", table))
    assert got == want and "-0.0" in got[0]
    pairs = pa.table({"vec_id": [0, 1], "embedding": pa.array([[1.0, 0.0], [-1e-10, 1.0]], pa.list_(pa.float32())), "label": [0, 0]})
    got, want = against_sql(spark, "neighbour_cosine", tmp_path, ("embeddings", pairs))
    assert got == want == ["(0, 1, -0.0)"]


def test_numbers_are_rounded_as_in_sql(spark):
    numbers = [0.5, -0.5, 1.5, 2.5, -2.5, 1234.5, 0.49999999999999994, 1e308, float("inf"), float("-inf"), 0.0, -0.0, -0.2, 123456.5e-6]
    for places in (0, 6):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(rounded(F.col("x"), places)).collect()]
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?)", [x, places]).fetchone()[0] for x in numbers]
        assert list(map(repr, got)) == list(map(repr, want))


def test_estimated_tokens_of_odd_texts_are_those_of_sql(spark, tmp_path):
    texts = [None, "", " ", "\n\t", "a", "abcde fg", "a\x0bb", "\x0b", "a\x0cb\rc", "東京タワー", "🚀🚀🚀🚀🚀", "ab🚀cd 𝒜𝒷", "\u00a0a", "é" * 5, "a\x1cb\x85c"]
    table = pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
    got, want = against_sql(spark, "token_estimate", tmp_path, ("documents", table))
    assert got == want


def test_texts_are_cut_in_batches_as_one_by_one(spark, monkeypatch):
    """Postings and lengths of written pages against the terms of what is asked, in runs that end anywhere; and a long text within a few seconds."""
    rng = np.random.default_rng(4)
    pool = list("ab c東京タ🚀🔥☀ÉéİΣσßﬁ½№❶・\u0301ÅǅǄ한국\x01\x02\n\x00-_Ⅷⅷ𝒜𐐀ёЁḀẞ゙A")
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 25)))) for _ in range(600)] + ["", None, "ΑΣ ΣΑΣ"]
    pages = spark.createDataFrame(list(enumerate(texts)), "slug long, content string").coalesce(2)
    monkeypatch.setattr("marlstone.functions.terms.RUN_BYTES", 97)
    for a in (Analyzer(), Analyzer(fold=False), Analyzer(pairs=False, triples=False), Analyzer(pairs=False), Analyzer(triples=False)):
        rows = pages.select("slug", a.terms(F.col("content")).alias("words"), Cutter(a).count(F.col("content")).alias("n")).collect()
        want = {(r.slug, p): w for r in rows for p, w in enumerate(r.words or [])}
        made = fulltext.positional_postings(pages, a).collect()
        assert {(r.slug, p): r.term for r in made for p in r.positions} == want
        assert [r.n for r in rows] == [len(r.words or []) for r in rows] and {r.slug: r.doc_len for r in made} == {r.slug: r.n for r in rows if r.n}
    monkeypatch.undo()
    long = pa.array(["Ærø é 東京 🚀 word " * 200_000])
    cutter, start = Cutter(Analyzer()), time.time()
    assert sum(t.sizes.sum() for _, _, t in cutter.runs(long)) == 200_000 * 5
    assert time.time() - start < 5


def test_many_expressions_are_judged_by_the_block(spark, monkeypatch):
    """A row for each match of each expression and page was made and grouped; now a block's pages are judged at once. The same by matches, and where a page's postings are in several runs."""
    rng = np.random.default_rng(8)
    words = ["red", "reed", "fox", "fog", "a", "b", "🚀", "🚀x", "東京都", "x"]
    pages = [(f"p{i}", " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(50)] + [("far", "fox " + "y " * 70_000 + "red fox")]
    asked = ["red fox", '"red fox"', "re* -fox", "fo* OR red", '"a b a"', "🚀 -東京", "red red", "r* re* red", '"red f*" OR x', "-red", "nothing", "", None, "fox -y", '"a 🚀"']
    a = Analyzer()
    index = fulltext.positional_postings(spark.createDataFrame(pages, "slug string, content string"), a).repartitionByRange(3, "term")
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    figures = spark.createDataFrame([(len(pages), 31.5)], "n long, avg_len double")
    atoms = fulltext.parsed_atoms(queries, a)
    hits = fulltext.atom_hits(index, atoms).persist()
    scored = lambda rows: sorted((r.qid, r.slug, round(r.score, 9), r["rank"]) for r in rows.collect())
    placed = lambda rows: sorted((r.qid, r.slug, r.first, r.window_score) for r in rows.collect())
    want = scored(fulltext.search(index, figures, queries, a, hits=hits)), placed(fulltext.best_windows(fulltext.fitting(hits, atoms), 4))
    assert len(want[0]) == len(want[1]) > 200 and {r[1] for r in want[0]} > {"far"}
    for block, places in ((8192, 1 << 20), (7, 1 << 20), (8192, 30)):
        monkeypatch.setattr(expressions, "BLOCK", block)
        monkeypatch.setattr(expressions, "BLOCK_PLACES", places)
        judged = fulltext.search(index, figures, queries, a)
        assert "Aggregate" not in plan(judged) and "Exchange" not in plan(fulltext.fitting_windows(index, queries, a, 4))
        assert (scored(judged), placed(fulltext.fitting_windows(index, queries, a, 4))) == want
    assert len(fulltext.whole_pages(index, fulltext._asked(atoms)).select("slug").distinct().collect()) == fulltext.whole_pages(index, fulltext._asked(atoms)).count()


def test_a_query_goes_once_to_a_place_however_many_cells_it_looks_at(spark, tmp_path, monkeypatch):
    """Queries went out once for each cell, and each block of codes sent on their first ones, which grows with the square root of the vectors on top of their number."""
    monkeypatch.setattr(vector_index, "BLOCK", 2)  # cells in several parts
    monkeypatch.setattr(vector_index, "ASKED", 7)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    every = spark.createDataFrame(rows, "slug long, embedding array<double>")
    asked = every.filter("slug < 30").withColumnRenamed("slug", "qid")
    index = vector_index.VectorIndex(spark, str(tmp_path / "v")).build(every, cells=60)
    centres, _, _, spread = index._centres()
    assert len(centres) == 60 and spread == 3
    own = pa.table({"id": [r[0] for r in rows[:30]], "embedding": pa.array([r[1] for r in rows[:30]])}).to_batches()[0]
    for probes in (1, 5, 60):
        routed = vector_index._routed(own, centres, spread, probes, 16)
        assert len(routed) == len({(r["id"], r["place"]) for r in routed.to_pylist()}) <= 30 * 16
    cells = {r.id: r.key for r in index._read("entries").select("id", "key").collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for probes in (1, 4, 60):
        found = {(r.qid, r["rank"]): r.slug for r in index.search(asked, 3, probes).collect()}
        for q, v in rows[:30]:
            near = set(np.argsort(-(centres @ unit(v)), kind="stable")[:probes].tolist())
            want = sorted((-float(unit(v) @ unit(w)), i) for i, w in rows if cells[i] in near)[:3]
            assert [found.get((q, r)) for r in range(len(want))] == [i for _, i in want]
