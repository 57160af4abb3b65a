"""Strict filters over pages: tags, time, collection and scope, each optional, all of them to hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.temporal import range_bounds


@dataclass
class StrictFilter:
    tags_all: list[str] = field(default_factory=list)
    tags_any: list[str] = field(default_factory=list)
    tags_none: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    collection: str | None = None
    recursive: bool = True
    scope: list[str] = field(default_factory=list)


def predicate(f: StrictFilter) -> Column:
    """What a row decides alone; true for an empty filter.

    A recursive collection is a case-blind LIKE with the slug as a pattern, so ``/folder`` takes ``/folder2`` too.
    """
    out = F.lit(True)
    if f.start or f.end:
        low, high = range_bounds(F.lit(f.start).cast("timestamp") if f.start else None, F.lit(f.end).cast("timestamp") if f.end else None)
        out = out & (F.col("id") >= low) & (F.col("id") < high)
    if f.collection is not None:
        out = out & (F.col("collection_path").ilike(f.collection + "%") if f.recursive else F.col("collection") == f.collection)
    if f.scope:
        out = out & F.col("scope").isin(f.scope)
    return out


def apply_filter(pages: DataFrame, page_tags: DataFrame, f: StrictFilter) -> DataFrame:
    """Pages that pass. Tags are semi- and anti-joins on the page; the rest is pushed to the scan."""
    pages = pages.filter(predicate(f))
    tagged = page_tags.withColumnRenamed("page", "slug")
    if f.tags_all:
        wanted = tagged.filter(F.col("tag").isin(f.tags_all)).groupBy("slug").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(set(f.tags_all)))
        pages = pages.join(wanted, "slug", "left_semi")
    if f.tags_any:
        pages = pages.join(tagged.filter(F.col("tag").isin(f.tags_any)), "slug", "left_semi")
    if f.tags_none:
        pages = pages.join(tagged.filter(F.col("tag").isin(f.tags_none)), "slug", "left_anti")
    return pages


def compile_sql(f: StrictFilter) -> tuple[str, dict]:
    """(condition, named arguments) for ``spark.sql(..., args=)`` over views pages and page_tags; times as for ``predicate``."""
    parts, args = [], {}

    def name(value) -> str:
        args[f"p{len(args)}"] = value
        return f":p{len(args) - 1}"

    has = "EXISTS (SELECT 1 FROM page_tags t WHERE t.page = pages.slug AND t.tag"
    parts += [f"{has} = {name(t)})" for t in f.tags_all]
    if f.tags_any:
        parts.append(f"{has} IN ({', '.join(name(t) for t in f.tags_any)}))")
    if f.tags_none:
        parts.append(f"NOT {has} IN ({', '.join(name(t) for t in f.tags_none)}))")
    if f.start or f.end:
        stamp = lambda t, tail: f"concat(substr(@, 1, 8), '-', substr(@, 9, 4), '{tail}')".replace("@", f"right(lpad(lower(hex(unix_millis({t}))), 16, '0'), 12)")
        low = f"CAST({name(f.start)} AS TIMESTAMP)" if f.start else "TIMESTAMP'1970-01-01 00:00:00Z'"
        high = f"CAST({name(f.end)} AS TIMESTAMP)" if f.end else "current_timestamp() + INTERVAL 1 DAY"
        parts.append(f"pages.id >= {stamp(low, '-7000-8000-000000000000')} AND pages.id < {stamp(high, '-7fff-bfff-ffffffffffff')}")
    if f.collection is not None:
        parts.append(f"pages.collection_path ILIKE concat({name(f.collection)}, '%')" if f.recursive else f"pages.collection = {name(f.collection)}")
    if f.scope:
        parts.append(f"pages.scope IN ({', '.join(name(s) for s in f.scope)})")
    return " AND ".join(parts) or "1=1", args
