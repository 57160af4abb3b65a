"""Graph maintenance, traversal and concepts over trade between nations and over geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.render import concept_turtle, scheme_turtle
from marlstone.operators import graph as G
from marlstone.plans.registry import Registry, table
from marlstone.plans.stores import EDGES, typed_edges

HERE = Registry()


def trade(spark, d):
    """From a supplier's nation to a customer's: weight is the number of lines, in order of the two names."""
    line, order, cust, supp = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    sold = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    weights = sold.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return weights.filter("source <> target").withColumn("ord", (F.col("source") * 1000 + F.col("target")).cast("long"))


TRADE = """edges AS (SELECT s_nationkey AS source, c_nationkey AS target, count(*)::DOUBLE AS weight, (s_nationkey * 1000 + c_nationkey)::BIGINT AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
norm AS (SELECT source, target, CASE WHEN hi = lo THEN 1.0 ELSE (weight - lo) / (hi - lo) END AS weight, ord FROM edges, (SELECT min(weight) AS lo, max(weight) AS hi FROM edges) AS b)"""
SNN = (
    TRADE
    + """, ends AS (SELECT source AS node, target AS other, weight, ord * 2 AS o FROM norm UNION ALL SELECT target, source, weight, ord * 2 + 1 FROM norm),
top AS (SELECT node, list(DISTINCT other) AS near FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, o) AS n FROM ends) AS r WHERE n <= 10 GROUP BY node),
snn AS (SELECT e.source, e.target, len(list_intersect(a.near, b.near)) / (len(a.near) + len(b.near) - len(list_intersect(a.near, b.near)))::DOUBLE AS weight, e.ord FROM norm e JOIN top a ON a.node = e.source JOIN top b ON b.node = e.target)"""
)


@HERE.add(f"WITH {TRADE} SELECT * FROM norm", floats=("weight",))
def graph_normalize(spark, d):
    return G.normalize_edges(trade(spark, d))


@HERE.add(f"WITH {SNN} SELECT * FROM snn", floats=("weight",))
def graph_snn(spark, d):
    return G.snn_score(G.normalize_edges(trade(spark, d)))


@HERE.add(f"WITH {TRADE} SELECT * FROM norm e WHERE NOT EXISTS (SELECT 1 FROM norm a JOIN norm b ON a.target = b.source WHERE a.source = e.source AND b.target = e.target AND a.target <> e.target AND least(a.weight, b.weight) > e.weight)", floats=("weight",))
def graph_pfnet(spark, d):
    return G.pfnet(G.normalize_edges(trade(spark, d)))


@HERE.add(
    """WITH e AS (SELECT 'nation/' || n_nationkey AS a, 'region/' || n_regionkey AS b, n_regionkey AS ca, n_regionkey AS cb FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, c_custkey % 5, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) AS ends GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS m FROM e)
SELECT (SELECT count(*) FROM e WHERE ca = cb) / any_value(m) - sum(d * d) / (4 * any_value(m) * any_value(m)) AS modularity FROM h, m""", floats=("modularity",))
def graph_modularity(spark, d):
    """Of the geography's edges, with customers put into communities by their number."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("node"), F.col("n_regionkey").cast("long").alias("community"))
    region = table(spark, d, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("node"), F.col("r_regionkey").cast("long").alias("community"))
    customer = table(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("node"), (F.col("c_custkey") % 5).alias("community"))
    return G.modularity(typed_edges(spark, d).withColumn("weight", F.lit(1.0)), nation.unionByName(region).unionByName(customer))


@HERE.add()
def graph_louvain(spark, d):
    return G.graph_maintenance(trade(spark, d))["communities"]


@HERE.add(
    """WITH m AS (SELECT n_regionkey AS r, 'nation/' || n_nationkey AS node FROM nation UNION SELECT n_regionkey, 'region/' || n_regionkey FROM nation UNION SELECT n_regionkey, 'customer/' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM m"""
)
def graph_components(spark, d):
    return G.components(typed_edges(spark, d).select("source", "target"))


@HERE.add(f"WITH {EDGES}, prior AS (SELECT * FROM edges WHERE source < 'customer/5'), nxt AS (SELECT * FROM edges WHERE source > 'customer/2') SELECT 'add' AS change, n.* FROM nxt n ANTI JOIN prior p USING (source, target, type) UNION ALL SELECT 'remove', p.* FROM prior p ANTI JOIN nxt n USING (source, target, type)")
def graph_reconcile(spark, d):
    e = typed_edges(spark, d)
    add, remove = G.reconcile(e.filter("source < 'customer/5'"), e.filter("source > 'customer/2'"))
    return add.select(F.lit("add").alias("change"), "*").unionByName(remove.select(F.lit("remove").alias("change"), "*"))


@HERE.add(f"WITH {EDGES} SELECT 'region/1' AS node, 0 AS depth, ['region/1'] AS path UNION ALL SELECT source, 1, ['region/1', source] FROM edges WHERE target = 'region/1' UNION ALL SELECT b.source, 2, ['region/1', a.source, b.source] FROM edges a JOIN edges b ON b.target = a.source WHERE a.target = 'region/1'")
def traverse_bfs(spark, d):
    return G.traverse(typed_edges(spark, d), "region/1", 3, "in")


def concepts(spark, d):
    """Regions over nations over market segments; a nation names its region, a region its nations."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    none = F.array().cast("array<string>")
    regions = r.join(n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_name"))).alias("narrower")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    top = regions.select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("uri"), F.concat(F.lit('The "'), "r_name", F.lit('"')).alias("pref_label"), F.array(F.lit("WORLD")).alias("broader"), F.coalesce("narrower", none).alias("narrower"))
    low = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 100).cast("long").alias("ord"), F.col("n_name").alias("uri"), F.col("n_name").alias("pref_label"), F.array("r_name").alias("broader"), none.alias("narrower"))
    return top.unionByName(low)


@HERE.add("SELECT n_name AS uri, r_name AS broader FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region")
def concept_links(spark, d):
    return G.concept_links(concepts(spark, d))


@HERE.add("SELECT n_name AS uri, n_name AS pref_label FROM nation UNION ALL SELECT r_name, 'The \"' || r_name || '\"' FROM region UNION ALL SELECT 'WORLD', 'WORLD'")
def concept_stubs(spark, d):
    return G.with_stubs(concepts(spark, d))


@HERE.add("SELECT n_name AS uri FROM nation WHERE n_nationkey = 5 UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 5 UNION SELECT 'WORLD'")
def broader_closure(spark, d):
    start = table(spark, d, "nation").filter("n_nationkey = 5").select("n_name").first()[0]
    return G.closure(G.concept_links(concepts(spark, d)), start)


@HERE.add("SELECT 'WORLD' AS uri UNION SELECT r_name FROM region UNION SELECT n_name FROM nation")
def narrower_closure(spark, d):
    return G.closure(G.concept_links(concepts(spark, d)), "WORLD", up=False)


@HERE.add(
    r"""SELECT r_name AS uri, '<' || r_name || '> a skos:Concept ;' || chr(10) || '    skos:prefLabel "The \"' || r_name || '\""' || ' ;' || chr(10) || '    skos:broader <WORLD>' || coalesce((SELECT string_agg(' ;' || chr(10) || '    skos:narrower <' || n_name || '>', '' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '') || ' .' || chr(10) AS turtle FROM region
UNION ALL SELECT n_name, '<' || n_name || '> a skos:Concept ;' || chr(10) || '    skos:prefLabel "' || n_name || '" ;' || chr(10) || '    skos:broader <' || r_name || '> .' || chr(10) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'scheme', '<scheme> a skos:ConceptScheme ;' || chr(10) || '    skos:prefLabel "Places" ;' || chr(10) || '    skos:hasTopConcept <WORLD> .' || chr(10)"""
)
def turtle(spark, d):
    c = concepts(spark, d)
    block = concept_turtle({k: F.col(k) for k in ("uri", "pref_label", "broader", "narrower")})
    head = spark.range(1).select(F.lit("scheme").alias("uri"), scheme_turtle(F.lit("scheme"), F.lit("Places"), F.array(F.lit("WORLD"))).alias("turtle"))
    return c.select("uri", block.alias("turtle")).unionByName(head)
