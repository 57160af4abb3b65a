"""Search expressions, analysis, excerpts, snapshots and the change feed of a store over documents and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.analysis import Analyzer
from marlstone.operators import fulltext
from marlstone.operators import store as S
from marlstone.operators.ranked_index import RankedIndex
from marlstone.operators.scratch import Tables, shared_folder
from marlstone.plans.registry import Registry, table
from marlstone.streaming.feeds import change_feed

HERE = Registry()
PLAIN = Analyzer(fold=False, pairs=False, triples=False)


def fresh_store(spark: SparkSession, **more) -> S.Store:
    return S.open_store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", **more)


def document_store(spark: SparkSession, d: str) -> S.Store:
    """All documents, written in two commits."""
    store, docs = fresh_store(spark), table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("content"), "doc_id")
    for k in (0, 1):
        store.upsert_pages(docs.filter(F.col("doc_id") % 2 == k).drop("doc_id"))
    return store


def expressions(spark: SparkSession, d: str) -> DataFrame:
    """(qid, query) of six kinds, from the words of the documents whose id is divisible by 50."""
    words = table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), PLAIN.terms(F.col("text")).alias("w")).filter("size(w) >= 8")
    w = lambda i: F.element_at("w", i)
    phrase = F.concat(F.lit('"'), w(3), F.lit(" "), w(4), F.lit('"'))
    kind = F.pmod(F.floor(F.col("qid") / 50), F.lit(6))
    kinds = [
        phrase,
        F.concat(w(3), F.lit(" OR "), w(6), F.lit(" "), w(2)),
        F.concat(w(3), F.lit(" -"), w(7)),
        F.concat(F.substring(w(4), 1, 3), F.lit("*")),
        F.concat(w(6), F.lit(" OR "), w(7), F.lit(" "), phrase),
        F.concat(w(2), F.lit(" "), w(3), F.lit(" -"), w(5)),
    ]
    return words.select("qid", F.element_at(F.array(*kinds), (kind + 1).cast("int")).alias("query"))


ATOMS = r"""docs AS (SELECT doc_id AS slug, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT slug AS qid, w, (slug // 50) % 6 AS k FROM docs WHERE slug % 50 = 0 AND len(w) >= 8),
atoms AS (SELECT *, row_number() OVER (PARTITION BY qid) AS atom FROM (
SELECT qid, 0 AS clause, false AS neg, w[3:4] AS t, false AS prefix FROM q WHERE k IN (0, 4) UNION ALL
SELECT qid, 1, false, [x], false FROM (SELECT qid, unnest([w[3], w[6]]) AS x FROM q WHERE k = 1) AS a UNION ALL SELECT qid, 0, false, [w[2]], false FROM q WHERE k = 1 UNION ALL
SELECT qid, 0, false, [w[3]], false FROM q WHERE k = 2 UNION ALL SELECT qid, 1, true, [w[7]], false FROM q WHERE k = 2 UNION ALL
SELECT qid, 0, false, [substr(w[4], 1, 3)], true FROM q WHERE k = 3 UNION ALL
SELECT qid, 1, false, [x], false FROM (SELECT qid, unnest([w[6], w[7]]) AS x FROM q WHERE k = 4) AS a UNION ALL
SELECT qid, 0, false, [w[2]], false FROM q WHERE k = 5 UNION ALL SELECT qid, 1, false, [w[3]], false FROM q WHERE k = 5 UNION ALL SELECT qid, 2, true, [w[5]], false FROM q WHERE k = 5) AS every_atom),
hits AS (SELECT * FROM (SELECT qid, clause, neg, atom, len(t) AS size, slug, len(w) AS len, list_filter(range(1, len(w) + 1), lambda i: CASE WHEN prefix THEN starts_with(w[i], t[1]) WHEN len(t) = 1 THEN w[i] = t[1] ELSE w[i] = t[1] AND w[i + 1] = t[2] END) AS starts FROM docs, atoms) AS each_pair WHERE len(starts) > 0),
df AS (SELECT qid, atom, count(*) AS df FROM hits GROUP BY 1, 2), fig AS (SELECT count(*) AS n, avg(len(w)) AS l FROM docs),
wanted AS (SELECT qid, count(DISTINCT clause) AS wanted FROM atoms WHERE NOT neg GROUP BY 1),
found AS (SELECT qid, slug, sum(CASE WHEN neg THEN 0 ELSE greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * len(starts) * 2.2 / (len(starts) + 1.2 * (0.25 + 0.75 * len / l)) END) AS score, count(DISTINCT clause) FILTER (NOT neg) AS got, bool_or(neg) AS bad FROM hits JOIN df USING (qid, atom), fig GROUP BY 1, 2),
fits AS (SELECT qid, slug, score FROM found JOIN wanted USING (qid) WHERE got = wanted AND NOT bad)"""


@HERE.add(f"WITH {ATOMS} SELECT qid, slug::VARCHAR AS slug, score FROM fits", floats=("score",))
def search_expressions(spark, d):
    """Phrases, alternatives, exclusions and prefixes against the kept index; every page that fits each expression."""
    return document_store(spark, d).search_all(expressions(spark, d), None).drop("rank")


WINDOWS = """
m AS (SELECT qid, slug, atom, size, unnest(starts) - 1 AS pos FROM hits WHERE NOT neg AND (qid, slug) IN (SELECT (qid, slug) FROM fits)),
v AS (SELECT a.qid, a.slug, a.pos, 1000 * count(DISTINCT b.atom) + count(*) - count(DISTINCT b.atom) AS value FROM (SELECT DISTINCT qid, slug, pos FROM m) AS a JOIN m b ON a.qid = b.qid AND a.slug = b.slug AND b.pos BETWEEN a.pos AND a.pos + 31 GROUP BY 1, 2, 3)
SELECT qid, slug::VARCHAR AS slug, max(value) AS window_score, arg_max(pos, value * 1000000 - pos) AS first FROM v GROUP BY 1, 2"""


@HERE.add(f"WITH {ATOMS}, {WINDOWS}")
def snippet_windows(spark, d):
    """Where the excerpt of each page that fits an expression begins, and what its window is worth, from positions alone."""
    store = document_store(spark, d)
    found = fulltext.fitting_windows(store.index(), expressions(spark, d), store.analyzer)
    return found.select("qid", "slug", "window_score", F.col("first").cast("long").alias("first"))


#: Ten characters that are cut into pairs, one for each digit.
DIGITS = "零一二三四五六七八九"


def mixed_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their id in CJK digits, and a symbol by language."""
    docs = table(spark, d, "documents")
    said = F.translate(F.col("doc_id").cast("string"), "0123456789", DIGITS)
    symbol = F.when(F.col("lang") == "en", "🚀🔥").when(F.col("lang") == "de", "🔥").otherwise("☀")
    return docs.select(F.col("doc_id").cast("string").alias("slug"), F.concat("text", F.lit(" №"), said, F.lit(" "), symbol, F.lit("!")).alias("content"))


ACCENTED = rf"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
asked AS (SELECT doc_id AS qid, list_filter(w, lambda x: x <> strip_accents(x))[1] AS x FROM w WHERE doc_id % 50 = 0 AND len(list_filter(w, lambda x: x <> strip_accents(x))) > 0),
n AS (SELECT qid, x, doc_id, list_contains(list_transform(w, lambda y: strip_accents(y)), strip_accents(x)) AS folded, list_contains(w, strip_accents(x)) AS plain FROM asked, w),
pairs(qid, x) AS (VALUES (-1, '12'), (-2, '120'), (-3, '7'))
SELECT qid::BIGINT AS qid, strip_accents(x) AS query, sum(folded::INT)::BIGINT AS folded, sum(plain::INT)::BIGINT AS plain FROM n GROUP BY 1, 2
UNION ALL SELECT qid, translate(x, '0123456789', '{DIGITS}'), sum(contains(doc_id::VARCHAR, x)::INT) FILTER (length(x) > 1 OR length(doc_id::VARCHAR) = 1), sum((doc_id::VARCHAR = x)::INT) FROM pairs, documents GROUP BY 1, 2
UNION ALL SELECT -4, '🔥', sum((lang IN ('en', 'de'))::INT), 0 FROM documents UNION ALL SELECT -5, '🚀🔥', sum((lang = 'en')::INT), 0 FROM documents"""


@HERE.add(f"WITH {ACCENTED}")
def search_scripts(spark, d):
    """How many pages words without their accents, pairs of CJK and symbols find, in an index with all of the analyzer and in one without."""
    words = table(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.filter(PLAIN.terms(F.col("text")), lambda x: Analyzer(pairs=False, triples=False).plain(x) != x).alias("w")).filter("size(w) > 0")
    accented = words.select("qid", Analyzer().plain(F.element_at("w", 1)).alias("query"))
    others = spark.createDataFrame([(-1, "一二"), (-2, "一二零"), (-3, "七"), (-4, "🔥"), (-5, "🚀🔥")], "qid long, query string")
    tables = Tables(spark)
    asked, pages = tables.keep(accented.unionByName(others)), mixed_scripts(spark, d)
    # many documents ask for the same word, which is searched once
    once = tables.keep(asked.groupBy("query").agg(F.min("qid").alias("first")))
    out = once
    for name, analyzer in (("folded", Analyzer()), ("plain", PLAIN)):
        store = fresh_store(spark, analyzer=analyzer)
        store.upsert_pages(pages)
        counts = store.search_all(once.select(F.col("first").alias("qid"), "query"), None).groupBy(F.col("qid").alias("first")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "first", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return asked.join(out.drop("first"), "query").select("qid", "query", "folded", "plain")


RANKED = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'for')) AS a FROM w), f AS (SELECT count(*) AS n, avg(len) AS l, sum((a > 0)::INT) AS da FROM t)
SELECT doc_id::VARCHAR AS slug, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / l)) AS score FROM t, f WHERE a > 0 ORDER BY score DESC, slug LIMIT 10"""


@HERE.add(RANKED, floats=("score",))
def search_pruned(spark, d):
    """The first ten pages by a frequent word, from those levels of its postings that can hold them."""
    store = document_store(spark, d)
    ranked = RankedIndex(spark, f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}").build(store.index(), store.figures())
    return ranked.top(["for"], 10).pages


@HERE.add("SELECT 'brand/' || p_brand AS uri, p_brand AS pref_label, []::VARCHAR[] AS broader, list_sort(list(DISTINCT 'size/' || p_brand || '/' || p_size)) AS narrower, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'size/' || p_brand || '/' || p_size, 'size ' || p_size, ['brand/' || p_brand], []::VARCHAR[], 0 FROM part")
def concept_lists(spark, d):
    """Concepts of a store as listed: brands, and sizes below them, written in two commits and compacted between."""
    p, store = table(spark, d, "part"), fresh_store(spark)
    store.add_concepts(p.select(F.concat(F.lit("brand/"), "p_brand").alias("uri"), F.col("p_brand").alias("pref_label")).distinct())
    store.compact()
    below = p.select(F.concat_ws("/", F.lit("size"), "p_brand", "p_size").alias("uri"), F.concat(F.lit("size "), "p_size").alias("pref_label"), F.array(F.concat(F.lit("brand/"), "p_brand")).alias("broader")).distinct()
    store.add_concepts(below)
    return store.concepts().select("uri", "pref_label", "broader", "narrower", F.size("narrower").cast("long").alias("n"))


SNAPSHOT = r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'late from news' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3),
w AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM d), t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'from')) AS a FROM w), f AS (SELECT count(*) AS n, avg(len) AS l, sum((a > 0)::INT) AS da FROM t)
SELECT doc_id::VARCHAR AS slug, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / l)) AS score, n, l AS avg_len FROM t, f WHERE a > 0"""


@HERE.add(SNAPSHOT, floats=("score", "avg_len"))
def store_snapshot(spark, d):
    """Pages written, deleted, compacted, vacuumed and written again: every page with a word, its score, and the figures."""
    store = document_store(spark, d)
    ids = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("slug"))
    store.upsert_pages(ids.filter("doc_id % 7 = 3").select("slug", F.lit(True).alias("deleted")))
    store.compact()
    store.vacuum(0)
    store.upsert_pages(ids.filter("doc_id % 5 = 1 AND doc_id % 7 <> 3").select("slug", F.lit("late from news").alias("content")))
    asked = spark.createDataFrame([(0, "from")], "qid int, query string")
    figures = store.figures().select("n", "avg_len")
    return store.search_all(asked, None).select("slug", "score").join(F.broadcast(figures))  # one row


FEED = "SELECT 'facts' AS kind, batch, count(*) AS rows, count(DISTINCT key) AS keys FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END::BIGINT AS batch, user_id || '::' || event_type AS key FROM events) AS e GROUP BY 2 UNION ALL SELECT 'edges', 2, count(*), count(DISTINCT user_id || '::' || event_type || '::did') FROM events WHERE event_id % 3 = 1"


@HERE.add(FEED)
def store_changes(spark, d):
    """The change feed as a stream: what each commit of a store brought, by kind."""
    store = fresh_store(spark)
    e = table(spark, d, "events").select("event_id", F.concat_ws("::", "user_id", "event_type").alias("id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.date_format("ts", "yyyy-MM-dd").alias("ts"))
    for k in range(3):
        facts = e.filter(F.col("event_id") % 3 == k)
        edges = {"edges": facts.select(F.col("subject").alias("source"), F.col("predicate").alias("target"), F.lit("did").alias("type"))} if k == 1 else {}
        store.write({"facts": facts.drop("event_id"), **edges})
    root = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    feed = change_feed(spark, store, ["facts", "edges"]).select("kind", "batch", "key")
    feed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("kind", "batch").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"))
