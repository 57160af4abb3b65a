"""The analyzer, search expressions, snippets, and the store's commits, snapshots and data source."""

import math
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlstone.functions.analysis import Analyzer
from marlstone.functions.text import PAIRED, SYMBOLS
from marlstone.operators import fulltext, store
from marlstone.operators.commits import Commits
from marlstone.operators.retrieval import bm25
from marlstone.sources.store_source import StoreSource
from marlstone.streaming import feeds

PAGE = "slug string, content string"
PY = lambda pattern: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
CJK, SYM = re.compile(f"[{PY(PAIRED)}]"), re.compile(PY(SYMBOLS))


def brute_terms(text, a=Analyzer()):
    low = text.replace("İ", "I").lower()
    if a.fold:
        low = "".join(b if (b := unicodedata.normalize("NFD", c)[0]).isascii() and b.isalpha() else c for c in low)
        low = re.sub("[\u0300-\u036f]", "", low)
    out, run = [], ""

    def flush():
        nonlocal run
        if run:
            out.extend([run[i : i + 2] for i in range(len(run) - 1)] if a.pairs and CJK.match(run) and len(run) > 1 else [run])
        run = ""

    for i, c in enumerate(low):
        if a.triples and SYM.match(c):
            flush()
            out.append(low[i : i + 3])
        elif unicodedata.category(c)[0] in "LN" or (a.pairs and CJK.match(c)):
            if run and a.pairs and bool(CJK.match(c)) != bool(CJK.match(run[0])):
                flush()
            run += c
        else:
            flush()
    flush()
    return out


TEXTS = ["José y Ångström", "日本語のテキスト and 漢 x漢字y", "go 🚀🔥 now 🚀", "", "E\u0301a e\u0301", "a1b2 x_y İstanbul", "ﬁ ½ straße ø", "🚀", "...", "한국어 текст ё"]


@pytest.mark.parametrize("analyzer", [Analyzer(), Analyzer(fold=False), Analyzer(pairs=False, triples=False), Analyzer(pairs=False)])
def test_terms_and_pieces(spark, analyzer):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", analyzer.terms(F.col("t")).alias("w"), analyzer.pieces(F.col("t")).alias("p")).collect():
        assert r.w == brute_terms(r.t, analyzer), r.t
        assert len(r.p) == len(r.w) and r.t.startswith("".join(r.p)), r.t
    assert spark.range(1).select(analyzer.terms(F.lit(None).cast("string"))).first()[0] is None


def test_flags_change_the_analyzer():
    assert Analyzer.of_flags({}) == Analyzer()
    assert Analyzer.of_flags({"FTS_SCRIPT_DETECTION": "off"}) == Analyzer(True, False, False)
    assert Analyzer.of_flags({"FTS_MULTILINGUAL_CONFIGS": "0", "FTS_BIGRAM_CJK": "no"}) == Analyzer(False, False, True)
    assert len({a.version for a in (Analyzer(), Analyzer(fold=False), Analyzer(pairs=False), Analyzer(triples=False))}) == 4


QUERIES = ['red fox', '"red fox"', 'red OR blue', 'red -fox', 'fo*', '"quick red f*"', '"a b a"', "-red", "", "...", '"日本" x', "日本語", "🚀", "jose", "José -fox", "x/y", 'blue OR "red fox" OR nothing', "red red", "re* OR fo*", None]


def brute_search(pages, query):
    """{slug: score} by scanning; the expression is read by hand."""
    words = {s: brute_terms(t or "") for s, t in pages}
    tokens = [(p or w, bool(p)) for p, w in re.findall(r'"([^"]+)"|(\S+)', query or "")]
    clauses, i = [], 0
    while i < len(tokens):
        value, phrase = tokens[i]
        if not phrase and i + 1 < len(tokens) and tokens[i + 1] == ("OR", False):
            group = [value]
            while i + 2 < len(tokens) and tokens[i + 1] == ("OR", False):
                group.append(tokens[i + 2][0])
                i += 2
            clauses.append((group, False))
        elif not phrase and value.startswith("-") and len(value) > 1:
            clauses.append(([value[1:]], True))
        else:
            clauses.append(([value], False))
        i += 1

    def starts(w, text):
        terms = brute_terms(text)
        last = text.rstrip().endswith("*")
        fits = lambda have, t, k: have.startswith(t) if SYM.match(t) or (last and k == len(terms) - 1) else have == t
        return [p for p in range(len(w) - len(terms) + 1) if all(fits(w[p + k], t, k) for k, t in enumerate(terms))] if terms else []

    clauses = [([t for t in g if brute_terms(t)], n) for g, n in clauses]
    clauses = [(g, n) for g, n in clauses if g]
    n, avg = len(pages), sum(map(len, words.values())) / len(pages)
    out = {}
    for slug, w in words.items():
        hit = lambda g: any(starts(w, t) for t in g)  # noqa: B023, E731
        if not any(not neg for _, neg in clauses) or not all(hit(g) != neg for g, neg in clauses):
            continue
        score = 0.0
        for g, neg in clauses:
            for t in g:
                df, tf = sum(bool(starts(x, t)) for x in words.values()), len(starts(w, t))
                if tf and not neg:
                    score += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        out[slug] = score
    return out


def random_pages(seed, n):
    pick = random.Random(seed)
    vocabulary = ["red", "fox", "blue", "quick", "a", "b", "José", "日本語", "日本", "🚀", "🚀🔥", "x/y", "x", "reed", "fog", "nothing,", "Red."]
    return [(f"p{i}", " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 14)))) for i in range(n)] + [("none", None)]


def test_expressions_match_brute_force(spark, monkeypatch):
    pages = random_pages(2, 60)
    a = Analyzer()
    df = spark.createDataFrame(pages, PAGE)
    index = fulltext.positional_postings(df, a).persist()
    lengths = [len(brute_terms(t or "")) for _, t in pages]
    figures = spark.createDataFrame([(len(pages), sum(lengths) / len(pages))], "n long, avg_len double")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    want = {(q, s): v for q, text in enumerate(QUERIES) for s, v in brute_search(pages, text).items()}
    assert len({q for q, _ in want}) > 12
    for pushed in (2000, 3):  # terms pushed to the scan, and joined
        monkeypatch.setattr(fulltext, "PUSHED", pushed)
        got = {(r.qid, r.slug): r.score for r in fulltext.search(index, figures, asked, a).collect()}
        assert got == pytest.approx(want)
    index.unpersist()


def test_best_windows_match_brute_force(spark):
    pages = random_pages(9, 40)
    a = Analyzer()
    index = fulltext.positional_postings(spark.createDataFrame(pages, PAGE), a)
    asked = spark.createDataFrame([(0, 'fox OR blue OR "red fox" -nothing')], "qid int, query string")
    got = {r.slug: r for r in fulltext.best_windows(fulltext.atom_hits(index, fulltext.parsed_atoms(asked, a)), 4).collect()}
    for slug, text in pages:
        w = brute_terms(text or "")
        matches = [(i, k) for i in range(len(w)) for k, t in enumerate((["fox"], ["blue"], ["red", "fox"])) if w[i : i + len(t)] == t]
        best = max(((1000 * len(own) + sum(i <= p < i + 4 for p, _ in matches) - len(own), -i) for i, _ in matches for own in [{k for p, k in matches if i <= p < i + 4}]), default=None)
        assert (best is None) == (slug not in got)
        if best:
            assert (got[slug].window_score, -got[slug].first) == best


def test_search_and_excerpts_of_a_store(spark, tmp_path):
    s = store.open_store(spark, str(tmp_path / "s"))
    filler = "lorem " * 50
    s.upsert_pages(spark.createDataFrame([("a", f"fox at first. {filler}The quick RED fox, and José; end"), ("b", "red things and a fox"), ("c", "東京都の天気 is fine 🚀🔥")], PAGE))
    found = {r.slug: r for r in s.search('"red fox"').collect()}
    assert set(found) == {"a"} and "<b>RED</b> <b>fox</b>, and José; end" in found["a"].excerpt and found["a"].excerpt.startswith("...")
    assert [r.slug for r in s.search("jose").collect()] == ["a"]
    assert {r.slug for r in s.search("fox -quick").collect()} == {"b"}
    assert s.search("京都").first().slug == "c" and s.search("京天").count() == 0 and s.search("🔥").first().slug == "c"
    assert {r.slug for r in s.search_all(spark.createDataFrame([(1, "fo*"), (2, "fine")], "qid int, query string")).collect()} == {"a", "b", "c"}


def test_without_expressions_a_string_is_a_list_of_words(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("FTS_WEBSEARCH_TO_TSQUERY", "off")
    s = store.open_store(spark, str(tmp_path / "s"))
    s.upsert_pages(spark.createDataFrame([("a", "red or fox"), ("b", "red")], PAGE))
    assert [r.slug for r in s.search("red OR fox").collect()] == ["a"]


def test_index_is_made_again_for_another_analyzer(spark, tmp_path):
    path = str(tmp_path / "s")
    s = store.open_store(spark, path, analyzer=Analyzer(fold=False, pairs=False))
    s.upsert_pages(spark.createDataFrame([("a", "José 日本語")], PAGE))
    assert s.search("jose").count() == 0 and s.search("日本").count() == 0
    again = store.open_store(spark, path)
    assert again.search("jose").count() == 1 and again.search("日本").count() == 1 and again.figures().first().avg_len == 3


# commits and snapshots


def test_two_writers_of_a_page_and_a_killed_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    one, two = store.open_store(spark, path), store.open_store(spark, path)
    # both find the same last number, and write the same page
    state = one.commits.state()
    monkeypatch.setattr(Commits, "state", lambda self, kept=state: kept)
    numbers = {one.upsert_pages(spark.createDataFrame([("p", "first words here")], PAGE)), two.upsert_pages(spark.createDataFrame([("p", "second")], PAGE))}
    monkeypatch.undo()
    assert numbers == {1, 2} and one.figures().first().n == 1 and one.pages().count() == 1
    assert one.search("second").count() == 1 and one.search("first").count() == 0

    def killed(self, *_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Commits, "add", killed)
    with pytest.raises(KeyboardInterrupt):
        one.upsert_pages(spark.createDataFrame([("p", "third"), ("q", "more")], PAGE))
    monkeypatch.undo()
    assert two.figures().first().n == 1 and two.search("third").count() == 0 and two.pages().count() == 1
    left = [f for f in two.vacuum(0) if f.startswith("data/")]
    assert len(left) == 2 and two.search("second").count() == 1


def test_compaction_keeps_every_view(spark, tmp_path):
    s = store.open_store(spark, str(tmp_path / "s"))
    for k in range(3):
        s.write({"pages": spark.createDataFrame([("a", f"red fox {k}"), (f"b{k}", "blue fox")], PAGE), "edges": spark.createDataFrame([("a", f"b{k}", "t", str(k))], "source string, target string, type string, evidence string")}, ("feed", k))
    s.upsert_facts(spark.createDataFrame([("1", "a", "p", "old", "first", "2024"), ("1", "z", "z", "new", "second", "2025")], "id string, subject string, predicate string, object string, source string, ts string"))
    s.add_tags(spark.createDataFrame([("a", "x"), ("a", "x")], "page string, tag string"))
    s.upsert_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("gone", [1.0])], "slug string, embedding array<double>"))
    s.add_concepts(spark.createDataFrame([("u", "U", ["v"])], "uri string, pref_label string, broader array<string>"))
    store.Settings(s, {}, {}).set({"k": "v"})
    s.delete_page("b1")

    def views():
        asked = spark.createDataFrame([(0, "fox"), (1, "red"), (2, "blue fox")], "qid int, query string")
        frames = [s.pages(), s.edges(), s.facts(), s.page_tags(), s.vectors(), s.concepts(), store.Settings(s, {}, {}).snapshot(), s.figures(), s.index(), s.search_all(asked)]
        return [sorted(map(repr, f.drop("row").select(*sorted(c for c in f.columns if c != "row")).collect())) for f in frames]

    before = views()
    assert s.compact() == 9 and views() == before
    state = s.commits.state()
    assert not state.commits and all(len(state.folders(t)) == 1 for t in ("pages", "edges", "facts", "postings"))
    assert len(s.index().inputFiles()) == len([f for f in os.listdir(f"{s.path}/{state.folders('postings')[0][0]}") if f.endswith(".parquet")])
    s.vacuum(0)
    assert views() == before and len(os.listdir(f"{s.path}/data/pages")) == 1
    assert s.upsert_pages(spark.createDataFrame([("n", "x")], PAGE), ("feed", 2)) is None
    s.upsert_pages(spark.createDataFrame([("a", "green"), ("n", "red fox")], PAGE), ("feed", 3))
    row = s.figures().first()
    assert row.n == 4 and row.avg_len == pytest.approx((1 + 2 + 2 + 2) / 4) and {r.slug for r in s.search("fox").collect()} == {"b0", "b2", "n"}
    after = s.compact()
    assert s.figures().first() == row and after == 10


def test_a_write_compacts_after_so_many_commits(spark, tmp_path):
    s = store.open_store(spark, str(tmp_path / "s"), compact_every=2)
    for k in range(4):
        s.upsert_pages(spark.createDataFrame([("a", f"word{k}")], PAGE))
    assert s.commits.state().upto == 3 and len(s.commits.state().commits) == 1 and s.search("word3").count() == 1


def test_scores_are_those_of_a_scan(spark, tmp_path):
    s = store.open_store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame(random_pages(4, 50), PAGE)
    s.upsert_pages(df)
    got = {r.slug: r.score for r in s.search_all(spark.createDataFrame([(0, "red fox")], "qid int, query string"), 100).collect()}
    assert got == pytest.approx({r.slug: r.score for r in bm25(df, ["red", "fox"]).collect()})


# data source


def test_store_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(StoreSource)
    path = str(tmp_path / "s")
    s = store.open_store(spark, path)
    s.upsert_pages(spark.createDataFrame([("a", "x"), ("b", "y")], PAGE))
    read = lambda t: spark.read.format("marlstone").option("path", path).option("table", t).option("push", "true").load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t")], "source string, target string, type string").repartition(2)
    edges.write.format("marlstone").option("path", path).option("table", "edges").mode("append").save()
    assert s.edges().count() == 2 and {r.batch for r in read("edges").collect()} == {2} and read("pages").filter("batch > 1").count() == 0
    with pytest.raises(Exception, match="division"):
        edges.withColumn("evidence", F.udf(lambda: 1 / 0)()).write.format("marlstone").option("path", path).option("table", "edges").mode("append").save()
    with pytest.raises(Exception, match="writes itself"):
        edges.write.format("marlstone").option("path", path).option("table", "pages").mode("append").save()
    assert s.commits.state().version == 2 and s.edges().count() == 2
    feed = spark.readStream.format("marlstone").option("path", path).option("table", "edges").load()
    run = lambda: feed.select("source", "batch").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    s.upsert_edges(spark.createDataFrame([("c", "a", "t")], "source string, target string, type string"))
    run()
    run()
    assert sorted((r.source, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 2), ("c", 3)]
    s.compact()
    s.vacuum(0)
    s.upsert_edges(spark.createDataFrame([("d", "a", "t")], "source string, target string, type string"))
    run()
    assert sorted(r.source for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.source for r in read("edges").collect()) == ["a", "b", "c", "d"]
    assert feeds.change_feed(spark, s).isStreaming


# ranking that skips postings


def test_pruned_ranking_is_that_of_all_postings(spark):
    import uuid

    from marlstone.operators.ranked_index import RankedIndex
    from marlstone.operators.scratch import shared_folder

    pick = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    pages = [(f"p{i:04}", " ".join(pick.choices(words, [1 / (k + 1) for k in range(40)], k=pick.choice([3, 10, 60, 300])))) for i in range(800)]
    df = spark.createDataFrame(pages, PAGE)
    index = fulltext.positional_postings(df, Analyzer())
    lengths = [len(t.split()) for _, t in pages]
    figures = spark.createDataFrame([(len(pages), sum(lengths) / len(pages))], "n long, avg_len double")
    ranked = RankedIndex(spark, f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}").build(index, figures)
    less = 0
    for terms in (["w20"], ["w5", "w9"], ["w0", "w39"], ["w30", "w31", "w32"], ["w7", "nothing"], []):
        found = ranked.top(terms, 5)
        want = [(r.slug, r.score) for r in bm25(df, terms).orderBy(F.desc("score"), "slug").limit(5).collect()]
        got = [(r.slug, r.score) for r in found.pages.collect()]
        assert [s for s, _ in got] == [s for s, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])
        less += found.read < found.total
    found = ranked.top(["w8"], 3)
    assert less >= 2 and found.read < 0.5 * found.total, (found.read, found.total)
