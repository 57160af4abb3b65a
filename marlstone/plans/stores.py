"""The store, filters, memories and settings over events, parts, orders and customers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.temporal import named_range, v7_ceiling, v7_floor
from marlstone.operators import filters as X
from marlstone.operators import store as S
from marlstone.operators.inference import run_loops, select_models, self_refine, tasks
from marlstone.operators.inference import profiles as model_profiles
from marlstone.operators.scratch import shared_folder
from marlstone.plans.registry import Registry, table

HERE = Registry()


def fact_log(spark, d):
    e = table(spark, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(F.col("event_id").alias("seq"), F.concat_ws("::", "user_id", "event_type").alias("id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("object"), F.col("event_id").cast("string").alias("source"), ts.alias("ts"), F.col("value").alias("confidence"))


FACTS = """log AS (SELECT event_id AS seq, user_id || '::' || event_type AS id, user_id::VARCHAR AS subject, event_type AS predicate, props AS object, event_id::VARCHAR AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, value AS confidence FROM events),
facts AS (SELECT id, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate, arg_max(object, seq) AS object, arg_min(source, seq) AS source, arg_max(ts, seq) AS ts, arg_max(confidence, seq) AS confidence FROM log GROUP BY id)"""


@HERE.add(f"WITH {FACTS} SELECT * FROM facts")
def upsert_facts(spark, d):
    return S.latest_facts(fact_log(spark, d))


@HERE.add(f"WITH {FACTS} SELECT * FROM facts WHERE subject = '7' AND ts >= '2024-01-10' ORDER BY ts DESC, id LIMIT 50")
def recall_facts(spark, d):
    return S.recall(S.latest_facts(fact_log(spark, d)), "7", 50, "2024-01-10")


@HERE.add("SELECT user_id || '/' || event_type AS slug, arg_max(props, event_id) AS content, arg_max(value, event_id) AS frontmatter FROM events GROUP BY user_id, event_type")
def latest_page(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws("/", "user_id", "event_type").alias("slug"), F.col("props").alias("content"), F.col("value").alias("frontmatter"))
    return S.latest_pages(log).select("slug", "content", "frontmatter")


@HERE.add("SELECT l_orderkey::VARCHAR AS source, l_suppkey::VARCHAR AS target, l_returnflag AS type, arg_max(l_linestatus, round(l_extendedprice * 100)::BIGINT * 8 + l_linenumber) AS evidence FROM lineitem GROUP BY 1, 2, 3")
def upsert_edges(spark, d):
    log = table(spark, d, "lineitem").select((F.round(F.col("l_extendedprice") * 100).cast("long") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("evidence"))
    return S.latest_edges(log)


def typed_edges(spark, d):
    """region <- nation <- customer, as edges."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    up = n.select(F.concat(F.lit("nation/"), "n_nationkey").alias("source"), F.concat(F.lit("region/"), "n_regionkey").alias("target"), F.lit("in").alias("type"))
    return up.unionByName(c.select(F.concat(F.lit("customer/"), "c_custkey").alias("source"), F.concat(F.lit("nation/"), "c_nationkey").alias("target"), F.lit("lives").alias("type")))


EDGES = "edges AS (SELECT 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target, 'in' AS type FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'lives' FROM customer)"


@HERE.add(f"WITH {EDGES} SELECT * FROM edges WHERE source = 'nation/3' OR target = 'nation/3'")
def edges_for(spark, d):
    return S.edges_for(typed_edges(spark, d), "nation/3")


PAGES = "pages AS (SELECT p_partkey AS slug, '/' || p_brand || '/' || p_size AS collection_path, p_brand AS collection, p_type AS scope FROM part), page_tags AS (SELECT p_partkey AS page, unnest(string_split(p_type, ' ')) AS tag FROM part)"


def part_pages(spark, d):
    p = table(spark, d, "part")
    pages = p.select(F.col("p_partkey").alias("slug"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_size").alias("collection_path"), F.col("p_brand").alias("collection"), F.col("p_type").alias("scope"))
    return pages, p.select(F.col("p_partkey").alias("page"), F.explode(F.split("p_type", " ")).alias("tag"))


@HERE.add(f"WITH {PAGES}, w AS (SELECT list_sort(list(DISTINCT tag)) AS t FROM page_tags) SELECT slug, scope FROM pages, w WHERE EXISTS (SELECT 1 FROM page_tags pt WHERE pt.page = slug AND pt.tag IN (t[1], t[2], t[3])) AND NOT EXISTS (SELECT 1 FROM page_tags pt WHERE pt.page = slug AND pt.tag = t[4])")
def filter_tags(spark, d):
    pages, tags = part_pages(spark, d)
    names = [r.tag for r in tags.select("tag").distinct().orderBy("tag").limit(4).collect()]
    return X.apply_filter(pages, tags, X.StrictFilter(tags_any=names[:3], tags_none=names[3:4])).select("slug", "scope")


@HERE.add(f"WITH {PAGES}, w AS (SELECT string_split(min(scope), ' ') AS t FROM pages) SELECT slug, scope FROM pages, w WHERE list_has_all(string_split(scope, ' '), t)")
def filter_tags_all(spark, d):
    pages, tags = part_pages(spark, d)
    names = pages.agg(F.min("scope")).first()[0].split(" ")
    return X.apply_filter(pages, tags, X.StrictFilter(tags_all=names)).select("slug", "scope")


@HERE.add(f"WITH {PAGES} SELECT slug, collection_path FROM pages WHERE collection_path ILIKE '/brand#1%'")
def filter_collection(spark, d):
    pages, tags = part_pages(spark, d)
    return X.apply_filter(pages, tags, X.StrictFilter(collection="/brand#1")).select("slug", "collection_path")


@HERE.add(f"WITH {PAGES}, w AS (SELECT min(scope) AS a, max(scope) AS b, min(collection) AS c FROM pages) SELECT slug, scope FROM pages, w WHERE scope IN (a, b) AND collection = c")
def filter_scope(spark, d):
    pages, tags = part_pages(spark, d)
    low, high, brand = pages.agg(F.min("scope"), F.max("scope"), F.min("collection")).first()
    return X.apply_filter(pages, tags, X.StrictFilter(scope=[low, high], collection=brand, recursive=False)).select("slug", "scope")


@HERE.add(f"WITH {PAGES}, w AS (SELECT list_sort(list(DISTINCT tag)) AS t FROM page_tags) SELECT slug FROM pages, w WHERE EXISTS (SELECT 1 FROM page_tags pt WHERE pt.page = slug AND pt.tag = t[1]) AND NOT EXISTS (SELECT 1 FROM page_tags pt WHERE pt.page = slug AND pt.tag = t[2]) AND collection_path ILIKE '/brand#%'")
def filter_sql(spark, d):
    pages, tags = part_pages(spark, d)
    names = [r.tag for r in tags.select("tag").distinct().orderBy("tag").limit(2).collect()]
    condition, args = X.compile_sql(X.StrictFilter(tags_all=names[:1], tags_none=names[1:], collection="/brand#"))
    return spark.sql(f"SELECT slug FROM {{pages}} AS pages WHERE {condition}".replace("FROM page_tags t", "FROM {page_tags} t"), args=args, pages=pages, page_tags=tags)


STAMP = "lpad(lower(to_hex(epoch_ms(o_orderdate))), 12, '0')"
V7 = f"o AS (SELECT o_orderkey AS slug, substr({STAMP}, 1, 8) || '-' || substr({STAMP}, 9, 4) || '-7000-8000-000000000000' AS id, substr({STAMP}, 1, 8) || '-' || substr({STAMP}, 9, 4) || '-7fff-bfff-ffffffffffff' AS last FROM orders)"


@HERE.add(f"WITH {V7} SELECT slug, id FROM o WHERE id >= (SELECT min(id) FROM o) AND slug IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31')")
def filter_temporal(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), v7_floor(ms).alias("id"))
    return pages.filter(X.predicate(X.StrictFilter(start="1995-01-01", end="1995-03-31"))).select("slug", "id")


@HERE.add(f"WITH {V7} SELECT slug, id, last FROM o")
def v7_bounds(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), v7_floor(ms).alias("id"), v7_ceiling(ms).alias("last"))


@HERE.add(
    "SELECT event_id, date_trunc('minute', ts - INTERVAL 1 MINUTE) IS NOT NULL AS ok, date_trunc('day', ts)::TIMESTAMP AS today, (date_trunc('day', ts) - to_days(dayofweek(ts)::INT))::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('quarter', ts)::TIMESTAMP AS quarter, date_trunc('year', ts)::TIMESTAMP AS year FROM events"
)
def named_ranges(spark, d):
    ts = F.col("ts").cast("timestamp")
    pick = {"today": "today", "week": "this_week", "month": "this_month", "quarter": "this_quarter", "year": "this_year"}
    return table(spark, d, "events").select("event_id", named_range("last_minute", ts).isNotNull().alias("ok"), *[named_range(n, ts).cast("timestamp_ntz").alias(c) for c, n in pick.items()])


@HERE.add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'default' ELSE 'default' END AS memory FROM customer")
def memory_router(spark, d):
    c = table(spark, d, "customer")
    headers = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("x-memory"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("x-other"), F.lit("nowhere"))).otherwise(F.create_map(F.lit("x-store"), F.lit("unknown")))
    handles = c.select(F.col("c_mktsegment").alias("slug")).distinct().withColumn("data_dir", F.concat(F.lit("/"), "slug"))
    return S.resolve_memory(c.select("c_custkey", headers.alias("headers")), handles, ["x-memory", "x-store"]).select("c_custkey", "memory")


@HERE.add("WITH t(n, task, slug) AS (VALUES (0, 'title-generation', 'ollama:qwen3.5:7b'), (1, 'content-revision', 'ollama:qwen3.5:27b'), (2, 'summarization', 'ollama:qwen3.5:27b'), (3, 'embedding', 'ollama:nomic-embed-text'), (4, 'link-typing', 'ollama:qwen3.5:27b'), (5, 'chat', 'ollama:qwen3.5:27b'), (6, 'structured-extract', 'ollama:qwen3.5:27b'), (7, 'vision-description', 'ollama:qwen3.5:27b'), (8, 'transcription', NULL), (9, 'diarization', NULL)) SELECT o_orderkey, task, slug FROM orders JOIN t ON n = o_custkey % 10")
def model_choice(spark, d):
    """The model for the task of each order; tasks go round by customer."""
    names = ["title-generation", "content-revision", "summarization", "embedding", "link-typing", "chat", "structured-extract", "vision-description", "transcription", "diarization"]
    wanted = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, names)), (F.col("o_custkey") % 10 + 1).cast("int")).alias("task"))
    return wanted.join(F.broadcast(select_models(model_profiles(spark), tasks(spark))), "task").select("o_orderkey", "task", "slug")  # ten tasks


@HERE.add("SELECT r_name AS key, CASE WHEN r_regionkey % 3 = 0 THEN 'o' WHEN r_regionkey % 3 = 1 THEN 'e' ELSE 'd' END AS value, CASE WHEN r_regionkey % 3 = 0 THEN 'db_override' WHEN r_regionkey % 3 = 1 THEN 'env' ELSE 'default' END AS source FROM region")
def runtime_settings(spark, d):
    r = table(spark, d, "region")
    layer = lambda cond, v: r.filter(cond).select(F.col("r_name").alias("key"), F.lit(v).alias("value"))
    return S.settings(layer("r_regionkey % 3 = 0", "o"), layer("r_regionkey % 3 <= 1", "e"), layer("true", "d"))


BREAKERS = """WITH c AS (SELECT user_id AS service, event_id AS seq, epoch_ms(ts) AS ms, value >= 20 AS ok FROM events), r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY service ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c),
f AS (SELECT *, coalesce(sum((NOT ok)::INT) OVER (PARTITION BY service, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM r),
o AS (SELECT *, min(CASE WHEN NOT ok AND fails + 1 >= 2 THEN ms END) OVER (PARTITION BY service, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM f)
SELECT service, seq, CASE WHEN fails < 2 THEN 'closed' WHEN ms - opened >= 3600000 THEN 'half-open' ELSE 'open' END AS state FROM o"""


@HERE.add(BREAKERS)
def breaker_log(spark, d):
    from marlstone.streaming.feeds import breaker_states

    calls = table(spark, d, "events").select(F.col("user_id").alias("service"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("value") >= 20).alias("ok"))
    return breaker_states(calls, 2, 3_600_000)


@HERE.add(BREAKERS)
def breaker_live(spark, d):
    """The log's states as a stream tells them, with the service's breaker as state."""
    from marlstone.streaming.breaker import breaker_stream

    rows, root = table(spark, d, "events"), f"{shared_folder(spark)}/breaker-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    calls = stream.select(F.col("user_id").alias("service"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("value") >= 20).alias("ok"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        breaker_stream(calls, 2, 3_600_000).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out").filter("seq IS NOT NULL").select(F.col("service").cast("long").alias("service"), "seq", "state")


@HERE.add("WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: x = 'from'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'with'))::DOUBLE AS b FROM d WHERE doc_id % 7 <> 3), f AS (SELECT count(*) AS n, avg(len) AS l, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM t), s AS (SELECT doc_id, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / l)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / l)) AS score FROM t, f WHERE a > 0 AND b > 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, 'd/' || doc_id) - 1 AS rank FROM s) SELECT 'd/' || doc_id AS slug, 1 / (60 + rank) AS score, 'keyword' AS source FROM r WHERE rank < 20", floats=("score",))
def store_search(spark, d):
    """A store that was written in three batches (all pages with other texts, all texts, a seventh deleted), searched through its kept index."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("slug"), F.col("text").alias("content"))
    store = S.open_store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.upsert_pages(docs.select("slug", F.lit("from with an earlier text").alias("content")))
    store.upsert_pages(docs.select("slug", "content"))
    store.upsert_pages(docs.filter("doc_id % 7 = 3").select("slug", F.lit(True).alias("deleted"), F.lit("from with").alias("content")))
    return store.search(["from", "with"], 20).select("slug", "score", "source")


@HERE.add("SELECT event_type AS kind, 'all' AS listener, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1 UNION ALL SELECT event_type, event_type, count(*), min(event_id), max(event_id) FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1")
def event_fanout(spark, d):
    """The events table as a stream to a listener of everything and two listeners of one kind; what each got, by kind."""
    from marlstone.streaming.feeds import EventBus

    root = f"{shared_folder(spark)}/fanout-{uuid.uuid4().hex}"
    rows = table(spark, d, "events")
    kinds = [r.event_type for r in rows.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    bus = EventBus()
    for name, kind in [("all", "*"), *((k, k) for k in kinds)]:
        bus.on(kind, lambda df, name=name: df.select(F.lit(name).alias("listener"), F.col("type").alias("kind"), "event_id").write.mode("append").parquet(f"{root}/got"))
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    bus.attach(stream.withColumnRenamed("event_type", "type"), f"{root}/offsets").awaitTermination()
    return spark.read.parquet(f"{root}/got").groupBy("kind", "listener").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


class Clerk:
    """A scripted client: it mends a text twice, and finds fault with it until then."""

    def generate(self, prompt: str) -> str:
        text = prompt.partition("Text:\n")[2].partition("\n\nFaults:")[0]
        return f"{text}!" if text else "too plain"


def mended(client: Clerk, text: str) -> dict:
    out, rounds = self_refine(text, client.generate, 5, lambda said, _: said.endswith("!!"))
    return {"out": out, "rounds": rounds}


@HERE.add("SELECT p_partkey AS id, p_name || '!!' AS out, 2 AS rounds FROM part")
def agent_loops(spark, d):
    """A refining loop per part, spread over tasks."""
    return run_loops(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), Clerk, mended, "out string, rounds int")
