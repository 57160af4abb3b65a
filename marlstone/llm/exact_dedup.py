"""Exact deduplication by distributed most-significant-digit radix partitioning.

A document is the byte string *length (8 bytes, big-endian) + UTF-8 text*. Every
round splits the groups still open by their next digit, a run of successive
bytes, and keeps a group open while it has two or more rows and bytes left.
Groups that are singletons or have ended are closed: the rows of an ended group
agree in every byte, so equality needs no digest. The digit of round 0 holds
the length, so the rows of a group end together, and most groups close there;
later digits grow to 1 MiB, so rounds grow with the longest *repeated* text.

Scale: counting a digit is a partially aggregated ``groupBy``; rows find their
group by a sort-merge join of two plain exchanges, which adaptive execution
splits where one group is hot. Only rows of open groups carry their text on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, utf8

FIRST_BYTES = 56
LAST_DIGIT = 1 << 20


def _groups(rows: DataFrame, *digit: str) -> DataFrame:
    """Digits held by two or more rows: size, and the row that stays."""
    return rows.groupBy(*digit).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("stays")).filter("group_size > 1")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; texts are compared as they
    are. Null texts count as empty, and all empty texts are one group. Among rows
    that repeat id and text one stays. A null id is smaller than any other; a
    group whose ids are all null keeps one row, with a null keep_id. Other columns of
    ``docs`` are ignored, so their names can't clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    raw = utf8(F.col(text_col))
    size = F.octet_length(raw).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), F.monotonically_increasing_id().alias("uid"))
    digit = F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), F.substring(raw, 1, FIRST_BYTES))
    first = scratch.keep(
        docs.select(F.col(id_col).alias("doc_id"), digit.alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select("digit", F.monotonically_increasing_id().alias("group"))
    )
    keyed = rows.withColumn("size", F.octet_length("raw").cast("long"))
    keyed = keyed.withColumn("digit", F.concat(F.unhex(F.lpad(F.hex("size"), 16, "0")), F.substring("raw", 1, FIRST_BYTES)))
    alone = keyed.select("doc_id", "digit", F.sha2("raw", 256).alias("text_sha256")).join(first.hint("merge"), "digit", "left_anti")
    closed = [alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")]

    shared = keyed.join(first.hint("merge"), "digit").select("doc_id", "uid", "group", (F.col("size") - FIRST_BYTES).alias("left"), F.sha2("raw", 256).alias("text_sha256"), F.expr(f"substring(raw, {FIRST_BYTES + 1})").alias("rest"))
    shared = scratch.keep(shared)
    ended = shared.filter("left <= 0").drop("rest")
    closed.append(_settle(ended, _groups(ended, "group"), "group"))

    opened, width = shared.filter("left > 0"), 1024
    while not opened.isEmpty():
        cut = opened.withColumn("digit", F.substring("rest", 1, width))
        groups = scratch.keep(_groups(cut, "group", "digit").withColumn("next", F.monotonically_increasing_id()))
        joined = cut.join(groups.hint("merge"), ["group", "digit"], "left")
        after = scratch.keep(joined.select("doc_id", "uid", F.col("next").alias("group"), "group_size", "stays", "text_sha256", (F.col("left") - width).alias("left"), F.expr(f"substring(rest, {width + 1})").alias("rest")))
        closed.append(after.filter("group is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))
        done = after.filter("group is not null and left <= 0")
        closed.append(done.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("stays.uid")).alias("kept"), "text_sha256"))
        opened = after.filter("group is not null and left > 0").select("doc_id", "uid", "group", "left", "text_sha256", "rest")
        width = min(width * 32, LAST_DIGIT)

    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def _settle(rows: DataFrame, groups: DataFrame, *on: str) -> DataFrame:
    joined = rows.join(groups.hint("merge"), list(on))
    return joined.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("stays.uid")).alias("kept"), "text_sha256")
