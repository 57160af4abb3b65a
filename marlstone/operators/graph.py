"""Graph maintenance, traversal and concept schemes.

Weighted edges are rows of (source, target, weight, ord); ``ord`` is their input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import Checkpoints, Tables, checkpoint


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Weights min-max scaled over all edges; all 1 if they are equal."""
    bounds = edges.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    joined = edges.join(F.broadcast(bounds))  # one row
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("weight") - F.col("low")) / (F.col("high") - F.col("low")))
    return joined.withColumn("weight", scaled).select(*edges.columns)


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(node, near): the set of targets of a node's ``k`` heaviest edges, seen from both ends; ties by input order.

    A window group limit cuts each node to ``k`` rows before its shuffle, so sets are bounded and hubs harmless.
    """
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", (F.col("ord") * 2).alias("ord"))
    both = both.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight", (F.col("ord") * 2 + 1).alias("ord")))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "ord"))
    return both.withColumn("place", place).filter(F.col("place") <= k).groupBy("node").agg(F.collect_set("other").alias("near"))


def snn_score(edges: DataFrame, k: int = 10) -> DataFrame:
    """Each edge's weight becomes the Jaccard similarity of its ends' top-k neighbours."""
    near = top_neighbours(edges, k)
    joined = edges.join(near.select(F.col("node").alias("source"), F.col("near").alias("a")), "source").join(near.select(F.col("node").alias("target"), F.col("near").alias("b")), "target")
    both = F.size(F.array_intersect("a", "b"))
    return joined.withColumn("weight", both / (F.size("a") + F.size("b") - both)).select(*edges.columns)


def pfnet(edges: DataFrame) -> DataFrame:
    """Edges that no path of two edges, each strictly heavier, goes around.

    Parallel edges count as their heaviest, not below 0. The middle of a path is sought from the end of the edge that has
    fewer neighbours, so a hub is walked only for edges between hubs; what is found is checked by an equi-join.
    """
    best = checkpoint(edges.groupBy("source", "target").agg(F.greatest(F.lit(0.0), F.max("weight")).alias("w"), F.min("weight").alias("low")))
    outs = best.groupBy("source").agg(F.count(F.lit(1)).alias("outs"))
    ins = best.groupBy("target").agg(F.count(F.lit(1)).alias("ins"))
    sized = checkpoint(best.select("source", "target", "low").join(outs, "source").join(ins, "target"))
    step = lambda a, b, w: best.select(F.col("source").alias(a), F.col("target").alias(b), F.col("w").alias(w))
    heavier = lambda w: F.col(w) > F.col("low")
    ahead = sized.filter("outs <= ins").join(step("source", "x", "w1"), "source").filter(heavier("w1") & (F.col("x") != F.col("target")))
    ahead = ahead.join(step("x", "target", "w2"), ["x", "target"])
    back = sized.filter("outs > ins").join(step("x", "target", "w2"), "target").filter(heavier("w2") & (F.col("x") != F.col("target")))
    back = back.join(step("source", "x", "w1"), ["source", "x"])
    columns = ["source", "target", "low", "w1", "w2"]
    whole = ahead.select(*columns).unionByName(back.select(*columns)).filter(heavier("w1") & heavier("w2"))
    around = whole.groupBy("source", "target").agg(F.max(F.least("w1", "w2")).alias("path"))
    joined = edges.join(around, ["source", "target"], "left")
    return joined.filter(F.col("path").isNull() | (F.col("path") <= F.col("weight"))).select(*edges.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; a node that only links to itself is its own."""
    found = checkpoint(connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), Checkpoints()))
    loops = edges.filter("source = target").select(F.col("source").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(loops.select("node", F.col("node").alias("component")))


GAIN = 1e-10


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (node, community): the sum over communities of inner / m - (degree / 2m)^2; null without weight."""
    home = lambda c: communities.select(F.col("node").alias(c), F.col("community").alias(f"{c}_home"))
    placed = edges.join(home("source"), "source").join(home("target"), "target")
    inner = F.when(F.col("source_home") == F.col("target_home"), F.col("weight")).otherwise(0.0)
    both = placed.select(F.col("source_home").alias("c"), inner.alias("inner"), "weight").unionByName(placed.select(F.col("target_home").alias("c"), F.lit(0.0).alias("inner"), "weight"))
    each = both.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("weight").alias("degree"))
    m = F.sum("degree") / 2
    return each.agg((F.sum("inner") / m - F.sum(F.col("degree") * F.col("degree")) / (4 * m * m)).alias("modularity"))


def louvain(edges: DataFrame, passes: int = 10) -> DataFrame:
    """(node, community): one level of modularity moves; ids count communities in the order in which edges first name a node of theirs.

    Nodes begin alone. In a round each node looks for the neighbouring community whose gain is best (ties: the first named); of the nodes that want to move, those
    move that come first, by a hash, among their neighbours that want to. If modularity didn't grow by that, the round is undone, and of each community only the best move that
    touches it is made, where that is the best for both communities it touches: these gains add up, so modularity grows. The
    same rule holds at every size, and partitioning doesn't change the result. It ends when no move gains, after 8 rounds a pass at most.
    """
    tables = Tables(edges.sparkSession)
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", (F.col("ord") * 2).alias("at"))
    ends = ends.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight", (F.col("ord") * 2 + 1).alias("at")))
    nodes = ends.groupBy("node").agg(F.sum("weight").alias("degree"), F.min("at").alias("seen"))
    links = tables.keep(ends.filter("node <> other").groupBy("node", "other").agg(F.sum("weight").alias("weight")))
    state = tables.keep(nodes.withColumn("home", F.col("seen")))
    twice = max(2 * total, 1e-9)
    kept, reached, careful = None, float("-inf"), False
    for turn in range(8 * passes):
        homes = state.select(F.col("node").alias("other"), F.col("home").alias("to"))
        pulls = tables.keep(links.join(homes, "other").groupBy("node", "to").agg(F.sum("weight").alias("pull")))
        held = tables.keep(state.groupBy("home").agg(F.sum("degree").alias("held")))
        inner = pulls.join(state.select("node", F.col("home").alias("to")), ["node", "to"]).agg(F.coalesce(F.sum("pull"), F.lit(0.0))).first()[0]
        value = inner / twice - held.agg(F.coalesce(F.sum(F.col("held") * F.col("held")), F.lit(0.0))).first()[0] / twice**2
        if value <= reached + 1e-12:
            if careful:
                state = kept[0]
                break
            (state, pulls, held), careful = kept, True
        else:
            kept, reached, careful = (state, pulls, held), value, False
        moves = _wanted(pulls, state, held, twice)
        if careful:
            moves = _apart(moves)
        else:
            first = F.struct(F.xxhash64("node", F.lit(turn)), "node")
            mine = moves.select("node", first.alias("mine"))
            before = links.join(mine, "node").join(mine.select(F.col("node").alias("other"), F.col("mine").alias("theirs")), "other").filter("theirs < mine").select("node").distinct()
            moves = moves.join(before, "node", "left_anti")
        moves = tables.keep(moves.select("node", "to"))
        if moves.isEmpty():
            break
        state = tables.keep(state.join(moves, "node", "left").select("node", "degree", "seen", F.coalesce("to", "home").alias("home")))
    leads = state.groupBy("home").agg(F.min("seen").alias("lead"))
    return _numbered(tables.keep(state.join(leads, "home").select("node", "lead")))


def _wanted(pulls: DataFrame, state: DataFrame, held: DataFrame, twice: float) -> DataFrame:
    """(node, home, to, gain): each node's best community, where that is better than staying."""
    away = pulls.join(state, "node").join(held.withColumnRenamed("home", "to"), "to")
    stays = F.col("to") == F.col("home")
    rate = F.round(F.col("pull") - F.col("degree") * F.col("held") / F.lit(twice), 10)
    best = away.groupBy("node").agg(F.max(F.when(~stays, F.struct(rate.alias("rate"), (-F.col("to")).alias("back")))).alias("b"), F.max(F.when(stays, F.col("pull"))).alias("own"))
    with_home = state.join(held, "home").join(best.filter("b IS NOT NULL"), "node")
    stay = F.round(F.coalesce("own", F.lit(0.0)) - F.col("degree") * (F.col("held") - F.col("degree")) / F.lit(twice), 10)
    return with_home.select("node", "home", (-F.col("b.back")).alias("to"), (F.col("b.rate") - stay).alias("gain")).filter(F.col("gain") > GAIN)


def _apart(moves: DataFrame) -> DataFrame:
    """Of moves (node, home, to, gain) those that are the best for both communities they touch, so that no two touch the same."""
    best = F.max(F.struct("gain", F.xxhash64("node").alias("turn"), "node"))["node"].alias("best")
    touched = moves.select(F.col("home").alias("c"), "node", "gain").unionByName(moves.select(F.col("to").alias("c"), "node", "gain"))
    bests = touched.groupBy("c").agg(best)
    return moves.join(bests.select(F.col("c").alias("home"), F.col("best").alias("node")), ["home", "node"]).join(bests.select(F.col("c").alias("to"), F.col("best").alias("node")), ["to", "node"])


def _numbered(found: DataFrame) -> DataFrame:
    """(node, community) from (node, lead): leads counted in their order, by ranges, so that no task numbers them all."""
    leads = found.select("lead").distinct().repartitionByRange("lead").withColumn("part", F.spark_partition_id())
    leads = checkpoint(leads.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("lead")) - 1))
    tops = leads.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = tops.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    ids = leads.join(before, "part").select("lead", (F.col("at") + F.col("before")).alias("community"))
    return found.join(ids, "lead").select("node", "community")


def graph_maintenance(edges: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """normalized, snn, sparse, communities: each made from the one before."""
    normalized = normalize_edges(edges)
    snn = checkpoint(snn_score(normalized, k))
    sparse = checkpoint(pfnet(snn))
    return {"normalized": normalized, "snn": snn, "sparse": sparse, "communities": louvain(sparse)}


def reconcile(prior: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(add, remove) by source, target and type; repeated rows stay repeated."""
    key = ["source", "target", "type"]
    return new.join(prior, key, "left_anti"), prior.join(new, key, "left_anti")


def traverse(edges: DataFrame, start: str, depth: int = 3, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node, depth, path): nodes within ``depth`` steps, by a shortest path, the smallest of those.

    Breadth first: a step joins the frontier with the edges and leaves out what was reached before.
    """
    if types:
        edges = edges.filter(F.col("type").isin(types))
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    spark = edges.sparkSession
    reached = front = spark.createDataFrame([(start, 0, [start])], "node string, depth int, path array<string>")
    for d in range(1, depth + 1):
        new = front.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("b")).alias("path"))
        front = checkpoint(new.groupBy("node", "depth").agg(F.min("path").alias("path")).join(reached.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


# Concept schemes: concepts (ord, uri, pref_label, ...), links (uri, broader)


def concept_links(concepts: DataFrame) -> DataFrame:
    """(uri, broader), from the broader and the narrower lists of concepts, each once."""
    up = concepts.select("uri", F.explode("broader").alias("broader"))
    down = concepts.select(F.explode("narrower").alias("uri"), F.col("uri").alias("broader"))
    return up.unionByName(down).distinct()


def with_stubs(concepts: DataFrame) -> DataFrame:
    """(uri, pref_label) of all concepts and of those that are only linked to, which are labelled by their uri."""
    links = concept_links(concepts)
    named = links.select("uri").union(links.select("broader")).distinct()
    stubs = named.join(concepts, "uri", "left_anti").select("uri", F.col("uri").alias("pref_label"))
    return concepts.select("uri", "pref_label").unionByName(stubs)


def closure(links: DataFrame, start: str, up: bool = True) -> DataFrame:
    """(uri) reachable over broader (or narrower) links, the start included; safe in cycles."""
    steps = links.select(F.col("uri" if up else "broader").alias("a"), F.col("broader" if up else "uri").alias("b"))
    spark = links.sparkSession
    reached = front = spark.createDataFrame([(start,)], "uri string")
    while True:
        new = front.join(steps, F.col("uri") == F.col("a")).select(F.col("b").alias("uri")).distinct()
        front = checkpoint(new.join(reached, "uri", "left_anti"))
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
