"""Streams: ingest of files, the change feed, event fan-out, recipes and breaker state."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.extract import extract_edges
from marlstone.operators.graph import reconcile
from marlstone.operators.scratch import Tables
from marlstone.operators.store import Store
from marlstone.sources.store_source import StoreSource


def on_page_write(store: Store, pages: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
    """Write pages (slug, content, page_type) and the edges found in them as one commit; its number, or None if ``txn`` was committed before.

    All edges found are written, so that one that stays takes its new evidence; those that are gone are marked.
    """
    new = extract_edges(pages)
    prior = store.edges().join(pages.select(F.col("slug").alias("source")).distinct(), "source", "left_semi")
    _, remove = reconcile(prior, new)
    gone = remove.select("source", "target", "type", F.lit(None).cast("string").alias("evidence"), F.lit(True).alias("deleted"))
    return store.write({"pages": pages.drop("page_type"), "edges": new.withColumn("deleted", F.lit(False)).unionByName(gone)}, txn)


def ingest_stream(spark: SparkSession, store: Store, path: str, checkpoint: str, page_type: str | None = None) -> StreamingQuery:
    """Every new text file under ``path`` becomes a page; its slug is its name without ending. Runs over what is there, then stops.

    A micro-batch that is replayed after it was committed is passed over, so nothing is doubled.
    """
    name = f"{hash_text(checkpoint):x}"
    files = spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("name"))
    pages = files.select(F.regexp_replace(F.replace("name", F.lit("%20"), F.lit(" ")), r"\.[^.]+$", "").alias("slug"), "content", F.lit(page_type).cast("string").alias("page_type"))
    return pages.writeStream.foreachBatch(lambda df, i: on_page_write(store, df, (name, i))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_feed(spark: SparkSession, store: Store, kinds: list[str] = ("pages", "edges", "facts")) -> DataFrame:
    """A stream of (kind, key, batch, event) of new rows of the logs, whole commits in their order."""
    keys = {"pages": ["slug"], "edges": ["source", "target", "type"], "facts": ["id"]}
    spark.dataSource.register(StoreSource)
    out = None
    for kind in kinds:
        rows = spark.readStream.format(StoreSource.name()).option("path", store.path).option("table", kind).load()
        event = rows.select(F.lit(kind).alias("kind"), F.concat_ws("::", *keys[kind]).alias("key"), "batch", F.to_json(F.struct("*")).alias("event"))
        out = event if out is None else out.unionByName(event)
    return out


def watch(feed: DataFrame, kinds: list[str] | None = None, page_tags: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """The feed's events of some kinds, and of pages with a tag."""
    if kinds:
        feed = feed.filter(F.col("kind").isin(kinds))
    if tag is not None and page_tags is not None:
        feed = feed.join(page_tags.filter(F.col("tag") == tag).select(F.col("page").alias("key")), "key", "left_semi")
    return feed


class Ledger:
    """Which listeners have had which micro-batch, as empty folders under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, batch: int, listener: str) -> bool:
        fs, path = self._at(f"{batch}/{listener}")
        return fs.exists(path)

    def add(self, batch: int, listener: str) -> None:
        fs, path = self._at(f"{batch}/{listener}")
        fs.mkdirs(path)

    def forget(self, before: int) -> None:
        """Lets go of earlier micro-batches; only the last can come again."""
        fs, root = self._at("")
        for found in fs.listStatus(root) if fs.exists(root) else []:
            if int(found.getPath().getName()) < before:
                fs.delete(found.getPath(), True)


class EventBus:
    """Listeners by event type, or ``*`` for all; ``attach`` runs them on each micro-batch of their events."""

    def __init__(self) -> None:
        self.listeners: dict[str, tuple[str, Callable[[DataFrame], None]]] = {}

    def on(self, kind: str, listener: Callable[[DataFrame], None], name: str | None = None) -> Callable[[], None]:
        """``name`` tells the listener from others when a stream starts again; without it it is the kind and a number."""
        name = name or f"{kind.replace('*', 'all')}-{sum(k == kind for k, _ in self.listeners.values())}"
        if name in self.listeners:
            raise ValueError(f"there is a listener {name!r}")
        self.listeners[name] = kind, listener
        return lambda: self.listeners.pop(name, None)

    def emit(self, events: DataFrame, batch: int | None = None, ledger: Ledger | None = None) -> None:
        """``events`` has type and data, and ts (now, where it is null or missing). Listeners that have had the batch, by the ledger, are passed over."""
        ts = F.coalesce(F.col("ts"), F.current_timestamp()) if "ts" in events.columns else F.current_timestamp()
        events = events.withColumn("ts", ts)
        for name, (kind, listener) in list(self.listeners.items()):
            if ledger is None or not ledger.has(batch, name):
                listener(events if kind == "*" else events.filter(F.col("type") == kind))
                if ledger is not None:
                    ledger.add(batch, name)
        if ledger is not None:
            ledger.forget(batch)

    def attach(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over what is there, then stops. A micro-batch that is replayed because a listener failed reaches those that had it no second time."""
        ledger = Ledger(stream.sparkSession, f"{checkpoint}-listeners")
        return stream.writeStream.foreachBatch(lambda df, batch: self.emit(df, batch, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Recipes


class RecipeError(ValueError):
    """A recipe can't run as asked: field path and message."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")


class RecipeTimeout(RuntimeError):
    """A recipe's time was up; its Spark jobs were cancelled."""


#: Where recipes are by default.
RECIPES_DIR = os.path.join(os.getcwd(), "recipes")


def list_recipes(folder: str = RECIPES_DIR) -> list[str]:
    """Names of the YAML files in a folder; none if it isn't there."""
    return sorted(f[:-5] for f in os.listdir(folder) if f.endswith(".yaml")) if os.path.isdir(folder) else []


def load_recipe(folder: str, name: str) -> dict:
    import yaml

    with open(os.path.join(folder, f"{name}.yaml")) as f:
        return yaml.safe_load(f)


def enabled_recipes(folder: str, enabled: list[str] = ()) -> list[dict]:
    """The enabled ones that there are; all, if none is named."""
    there = list_recipes(folder)
    return [load_recipe(folder, n) for n in (enabled or there) if n in there]


def describe_recipe(folder: str, name: str) -> dict:
    """name, version, backend, input (the schema of its arguments), path_allow and max_seconds of a recipe; raises RecipeError if it isn't there."""
    if name not in list_recipes(folder):
        raise RecipeError("$", f"no recipe {name!r}")
    recipe = load_recipe(folder, name)
    return {"name": recipe.get("recipe"), "version": recipe.get("version"), "backend": recipe.get("backend"), "input": recipe.get("input") or {}, "path_allow": recipe.get("path_allow"), "max_seconds": recipe.get("max_seconds", 300)}


def recipe_table(spark: SparkSession, folder: str) -> DataFrame:
    """(name, version, backend, cron, body as JSON)."""
    rows = [(r.get("recipe"), r.get("version"), r.get("backend"), r.get("cron"), json.dumps(r, default=str)) for r in enabled_recipes(folder)]
    return spark.createDataFrame(rows, "name string, version int, backend string, cron string, body string")


def check_arguments(schema: dict, arguments: dict, path: str = "$", path_allow: str | None = None) -> None:
    """Raises RecipeError where required arguments miss, types differ, or a path or URL isn't one that ``path_allow`` matches."""
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list}
    for name in schema.get("required", []):
        if name not in arguments:
            raise RecipeError(f"{path}.{name}", "is required")
    for name, value in arguments.items():
        kind = schema.get("properties", {}).get(name, {}).get("type")
        if kind and not isinstance(value, kinds[kind]):
            raise RecipeError(f"{path}.{name}", f"must be {kind}")
        if isinstance(value, str) and re.search(r"[/\\;|&$`]|^\.\.?$", value) and not (path_allow and re.fullmatch(path_allow, value)):
            raise RecipeError(f"{path}.{name}", "isn't allowed")


def context_calls(specs: list[str], item: dict, prefix: str = "store") -> list[tuple[str, list[str]]]:
    """(function, arguments) of calls like ``store.recall(from)``; names of the item's fields become their values."""
    found = [re.match(rf"^{re.escape(prefix)}\.(recall|search)\((.*)\)$", s) for s in specs]
    return [(m[1], [str(item.get(a.strip(), a.strip())) for a in m[2].split(",") if a.strip()]) for m in found if m]


def run_recipe(items: DataFrame, recipe: dict, classify: Callable[[], Callable], draft: Callable[[], Callable], prefix: str = "store") -> DataFrame:
    """(item, classification, draft, ttl) as JSON of the items that need a reply.

    ``items`` has item (JSON). The factories make, once a task, functions of (settings, item) and of
    (settings, item, context calls). Works on batches and on streams.
    """
    first, second = recipe.get("classify") or {}, recipe.get("draft") or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, write = classify(), draft()
        for pdf in frames:
            out: list[tuple[Any, ...]] = []
            for raw in pdf["item"]:
                item = json.loads(raw)
                said = judge(first, item)
                if said.get("needs_reply"):
                    out.append((raw, json.dumps(said), write(second, item, context_calls(second.get("context") or [], item, prefix))))
            yield pd.DataFrame(out, columns=["item", "classification", "draft"])

    ttl = (recipe.get("enqueue") or {}).get("ttl")
    return items.select("item").mapInPandas(run, "item string, classification string, draft string").withColumn("ttl", F.lit(ttl).cast("string"))


_FETCHERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_fetcher(backend: str, fetch: Callable[[SparkSession, dict], DataFrame]) -> None:
    """How the items (item as JSON) of recipes with this backend are read; given the session and the recipe's ``ingest``."""
    _FETCHERS[backend] = fetch


def enqueue(results: DataFrame, queues: str, recipe: dict, run: str) -> None:
    """Writes results to their queue, a table under ``queues``; a run that is repeated replaces its own rows."""
    name = (recipe.get("enqueue") or {}).get("queue") or f"drafts.{recipe.get('recipe')}"
    results.write.mode("overwrite").parquet(f"{queues}/queue={name}/run={run}")


def fetch_and_run(spark: SparkSession, recipe: dict, queues: str, run: str, classify: Callable, draft: Callable, prefix: str = "store") -> bool:
    """From the recipe's source to its queue; False, and nothing done, where its backend has no fetcher."""
    fetch = _FETCHERS.get(recipe.get("backend"))
    if fetch is None:
        return False
    enqueue(run_recipe(fetch(spark, recipe.get("ingest") or {}), recipe, classify, draft, prefix), queues, recipe, run)
    return True


def schedule_recipes(folder: str, enabled: list[str], register: Callable[[str, str | None, Callable], None], run: Callable[[dict], Any]) -> list[dict]:
    """Registers (name, cron, handler) of each enabled recipe with a scheduler; returns the recipes."""
    recipes = enabled_recipes(folder, enabled)
    for recipe in recipes:
        register(f"recipe.{recipe.get('recipe')}", recipe.get("cron"), lambda recipe=recipe: run(recipe))
    return recipes


def within(spark: SparkSession, seconds: float, run: Callable[[], Any]) -> Any:
    """What ``run`` returns; after ``seconds`` its Spark jobs are cancelled and RecipeTimeout is raised."""
    group, late = f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "bounded", interruptOnCancel=True)
    timer.start()
    try:
        out = run()
    except Exception as error:
        if late.is_set():
            raise RecipeTimeout(f"more than {seconds} s") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise RecipeTimeout(f"more than {seconds} s")
    return out


def run_named(spark: SparkSession, folder: str, enabled: list[str], name: str, arguments: dict, seconds: float, results: str, key: str, run: Callable[[dict, dict], DataFrame]) -> DataFrame:
    """The result of an enabled recipe, with its arguments, paths and time checked; the same key and arguments give the kept one."""
    about = describe_recipe(folder, name)
    if enabled and name not in enabled:
        raise RecipeError("$", f"{name!r} isn't enabled")
    check_arguments(about["input"], arguments, path_allow=about["path_allow"])
    if not 0 < seconds <= about["max_seconds"]:
        raise RecipeError("$", f"time must be more than 0 and at most {about['max_seconds']} s")
    recipe = load_recipe(folder, name)
    return within(spark, seconds, lambda: run_once(spark, results, f"{name}-{key}", arguments, lambda: run(recipe, arguments)))


def run_once(spark: SparkSession, results: str, key: str, arguments: dict, run: Callable[[], DataFrame]) -> DataFrame:
    """The result kept under an idempotency key and canonical arguments; computed and written if there is none."""
    name = f"{re.sub(r'[^A-Za-z0-9_-]', '_', key)}-{abs(hash_text(json.dumps(arguments, sort_keys=True)))}"
    path = f"{results}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        run().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def breaker_states(calls: DataFrame, threshold: int = 5, cooldown_ms: int = 30_000) -> DataFrame:
    """(service, seq, state) before each call of (service, seq, ms, ok): the breaker's fold over a log.

    The log is dealt in ranges of (service, seq), so a service with most of the calls is spread. A range sums up what it does to a service
    (whether a call succeeded, failures since then, and when they reached the threshold); these few rows are composed in order, and each range's
    calls are then told from what came in and what went before in the range. The circuit opened at the failure that reached the
    threshold, and is half-open once the cooldown has passed. Calls of a service need different seqs.
    """
    from pyspark.sql.window import Window

    tables = Tables(calls.sparkSession)
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables.keep(calls.select("service", "seq", "ms", "ok").repartitionByRange(parts, "service", "seq").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("service", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.withColumn("run", F.coalesce(F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(before), F.lit(0)))
    inside = Window.partitionBy("service", "part", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fails = runs.withColumn("failures", F.coalesce(F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(inside), F.lit(0)))
    # what a range does: successes, failures behind the last, and those before the first
    sums = fails.groupBy("service", "part", "run").agg(F.max(F.when(F.col("ok"), 1).otherwise(0)).alias("closed"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"))
    ranges = sums.groupBy("service", "part").agg(F.max("closed").alias("reset"), F.max_by("failed", "run").alias("last_failed"), F.max_by("closed", "run").alias("ends_closed"))
    trailing = F.when(F.col("ends_closed") == 1, 0).otherwise(F.col("last_failed"))
    order = Window.partitionBy("service").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    grouped = ranges.withColumn("trailing", trailing).withColumn("since", F.coalesce(F.sum("reset").over(order), F.lit(0)))
    # failures that come in: those behind the last success of the ranges before
    group = Window.partitionBy("service", "since").orderBy("part")
    grouped = grouped.withColumn("upto", F.sum("trailing").over(group))
    carried = grouped.select("service", "part", F.coalesce(F.lag("upto").over(order), F.lit(0)).alias("carried"))
    known = fails.join(carried, ["service", "part"]).withColumn("failures", F.col("failures") + F.when(F.col("run") == 0, F.col("carried")).otherwise(0))
    reached = F.when(~F.col("ok") & (F.col("failures") + 1 == threshold), F.col("ms"))
    known = known.withColumn("opened", F.max(reached).over(inside))
    opens = known.groupBy("service", "part").agg(F.max_by(reached, F.when(reached.isNotNull(), F.col("seq"))).alias("opened_here"))
    came = opens.select("service", "part", F.last("opened_here", True).over(earlier).alias("came_open"))
    told = known.join(came, ["service", "part"])
    opened = F.when((F.col("run") == 0) & (F.col("carried") >= threshold), F.col("came_open")).otherwise(F.col("opened"))
    state = F.when(F.col("failures") < threshold, "closed").when(F.col("ms") - opened >= cooldown_ms, "half-open").otherwise("open")
    return told.select("service", "seq", state.alias("state"))
