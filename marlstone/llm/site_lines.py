"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. For each line the share of the host's pages that hold
it is the boilerplate ratio; lines at or above the limit go, on every page.

Scale: a page names each of its lines once, and counts are partial sums, so a
line on every page of a hot host costs one row per task. A host has at most
(lines per page / ratio) boilerplate lines; they meet the pages in a
join by host, which Spark sends around where small and splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host_key, line, pages_with, host_pages) of the lines to drop; empty lines never are.

    Null hosts are one host, null texts have no lines, a line counts once a page however often it stands there, and no pages give no rows.
    """
    keyed = pages.select(host.alias("host_key"), F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("lines"))
    totals = keyed.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = keyed.select("host_key", F.explode("lines").alias("line")).filter("line <> ''")
    counts = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("pages_with")).filter(F.col("pages_with") >= min_pages)
    joined = counts.join(totals, counts["host_key"].eqNullSafe(totals["host_key"])).select(counts["host_key"], "line", "pages_with", "host_pages")
    return joined.filter(F.col("pages_with") >= F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """The columns of ``pages`` plus clean_text, n_lines, n_dropped; columns of ``pages`` with these names give way.

    Lines are split at ``\\n`` and compared exactly; a line counts once a page.
    Lines on fewer than ``min_pages`` pages of a host stay, however small the host. Null texts
    count as empty and stay so; null hosts are one group. Order and repeats of
    the lines that stay are kept. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    found = scratch.keep(boilerplate_lines(pages, host, text, ratio, min_pages))
    by_host = scratch.keep(found.groupBy("host_key").agg(F.collect_set("line").alias("boilerplate")))
    joined = pages.join(by_host, host.eqNullSafe(by_host["host_key"]), "left")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    bad = F.coalesce(by_host["boilerplate"], F.array().cast("array<string>"))
    kept = F.filter(lines, lambda x: ~F.array_contains(bad, x))
    out = joined.select(*[pages[c] for c in pages.columns if c not in ("clean_text", "n_lines", "n_dropped")], F.array_join(kept, "\n").alias("clean_text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"))
    return out
