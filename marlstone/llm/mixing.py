"""Mixing sources to target weights with DataFrame functions only.

Tokens are summed per source, each source gets a repetition rate, and a document
is emitted floor(rate) times plus one Bernoulli copy whose probability is the
rate's fraction. The draw is a hash of the document id and a seed. Of ``SEEDS``
seeds each source takes the one whose draws bring it nearest to its target, found
in the same single aggregation, so that heavy documents don't push a small source off.

Scale: one pass over the texts (to count words), then aggregations with
partial sums over a narrow table. Tables of sources are ranked by range
partitions, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, fresh

SEEDS = 32


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: Column | int) -> Column:
    """A number in [0, 1) from the document id and the seed."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed) if isinstance(seed, int) else seed), 11) / F.lit(float(1 << 53))


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``rank`` (from 0): place by code point, null last; by range partitions, written so that counts and ranks see the same."""
    split = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("last", "source")
    split = scratch.keep(split.withColumn("at", F.row_number().over(inner) - 1))
    tops = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = tops.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return split.join(before, "part").select("source", "source_size", (F.col("at") + F.col("before")).alias("rank"))


def source_targets(sources: DataFrame, scratch: Scratch, weights: list[int], cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): the total shared by weight.

    No target exceeds ``cap`` times its source's size; what is above is shared anew by
    weight among the others until none is above. Each pass is one aggregation of sums. A null source comes last; sources
    of size 0 get no target above 0; repeated sources aren't expected, as these are sums by source.
    """
    ranked = _ranked(sources, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    per_weight, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(per_weight) >= F.col("most") if full >= 0 else F.lit(False)
        sums = ranked.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(capped, 1).otherwise(0)).alias("n")).first()
        if sums.n is None or sums.n == full or not sums.free:
            break
        full, per_weight = sums.n, (total - sums.taken) / sums.free
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * F.lit(per_weight)).alias("target"))


def mixing_plan(docs: DataFrame, weights: list[int] | None = None, cap: float = 3.0, size: Column | None = None) -> DataFrame:
    """Copies of every row: doc_id, source, size, source_size, target, rate, copies, taken.

    ``size`` is a Column over ``docs`` (by default the number of words of ``text``; null
    text: 0). Sources by code point, null last, take ``weights`` in turn. A source
    of size 0 has target 0, and its documents no copies. Rows that repeat a doc_id
    get the same draw; so do rows without one. Other columns are ignored. An
    empty table gives no rows. Equal input gives equal output.
    """
    weights = weights or [5, 2, 1]
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size")))
    sources = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sources, scratch, weights, cap)
    targets = scratch.keep(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)).withColumn("source_known", F.coalesce(F.col("source"), F.lit(""))).withColumn("source_null", F.col("source").isNull()))
    keyed = sized.withColumn("source_known", F.coalesce(F.col("source"), F.lit(""))).withColumn("source_null", F.col("source").isNull())
    rates = targets.select("source_known", "source_null", "source_size", "target", "rate", (F.col("rate") - F.floor("rate")).alias("fraction"))
    rated = keyed.join(rates, ["source_known", "source_null"])
    extras = rated.groupBy("source_known", "source_null").agg(
        F.first("target").alias("target_"), F.first(F.floor("rate") * F.col("source_size")).alias("whole"), *[F.sum(F.when(_draw(s) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    )
    off = F.array(*[F.struct(F.abs(F.col("whole") + F.col(f"s{s}") - F.col("target_")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    seeds = extras.select("source_known", "source_null", F.array_min(off)["seed"].alias("seed"))
    drawn = keyed.join(scratch.keep(rates.join(seeds, ["source_known", "source_null"])), ["source_known", "source_null"])
    copies = (F.floor("rate") + F.when(_draw(F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("int")
    return drawn.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "seed", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def source_rates(docs: DataFrame, weights: list[int] | None = None, cap: float = 3.0) -> DataFrame:
    """(source, rate, seed) of each source: all that ``mix`` needs to draw. Null sources are one source; null texts have no words; no rows give no sources."""
    return mixing_plan(docs, weights, cap).groupBy("source").agg(F.first("rate").alias("rate"), F.first("seed").alias("seed"))


def mix(docs: DataFrame, weights: list[int] | None = None, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns of any name.

    The rates come back as a small table by source, so texts meet them once and are
    not dealt by key where that table is small enough for Spark to send it around. Null texts have size 0 but
    are taken like the others of their source; a source without words, null or not, gives no rows. Rows that
    repeat a doc_id, or have none, get the same draw. An empty table gives no rows.
    """
    rates = Scratch(docs.sparkSession, "rates").keep(source_rates(docs, weights, cap))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["source"]))
    draw = F.shiftrightunsigned(F.xxhash64(docs["doc_id"], rates["seed"]), 11) / F.lit(float(1 << 53))
    copies = F.floor(rates["rate"]) + F.when(draw < rates["rate"] - F.floor(rates["rate"]), 1).otherwise(0)
    (copy,) = fresh(docs, "copy")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(copy)).drop(copy)
