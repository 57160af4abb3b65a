"""The knowledge store: append logs, and views that give each key's present state.

A write adds folders of rows, one for each table it touches, and becomes visible by one commit (see ``commits``), so readers see whole
writes only. ``seq`` is (batch, row), where the batch is the commit's number: a view is a grouped max_by / min_by over it, which
combines before the shuffle, so a key that is written very often is no burden. A write that a stream replays is
told by the stream's name and micro-batch, and passed over.

Positional postings are kept with each write of pages, made where a page is read and so without a shuffle; a search reads no texts but those it shows. ``compact`` writes every table's
present state, sorted by key (postings by term in runs, as a write's are, so that they needn't be moved), as a snapshot with the corpus figures; readers take that and the commits after it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.analysis import Analyzer
from marlstone.functions.terms import Cutter
from marlstone.functions.text import search_flags
from marlstone.operators import fulltext
from marlstone.operators.commits import Commits, State
from marlstone.operators.retrieval import fused_search, ranked, vector_search

SCHEMAS = {
    "pages": "row long, slug string, content string, frontmatter string, updated_at string, id string, collection string, collection_path string, scope string, memory string, deleted boolean, doc_len int",
    "edges": "row long, source string, target string, type string, evidence string, deleted boolean",
    "facts": "row long, id string, subject string, predicate string, object string, source string, ts string, confidence double",
    "page_tags": "row long, page string, tag string",
    "vectors": "row long, slug string, embedding array<double>",
    "concepts": "row long, uri string, pref_label string, alt_labels array<string>, hidden_labels array<string>, broader array<string>, narrower array<string>, related array<string>, scope_note string, in_scheme string, top_concept_of string",
    "schemes": "row long, uri string, pref_label string, top_concepts array<string>",
    "settings": "row long, key string, value string",
    "postings": "row long, slug string, term string, tf long, doc_len int, positions array<int>",
}

#: How files are compressed, where it isn't left to Spark.
PACKING = {"parquet": {"compression": "zstd"}}

#: What each table's snapshot is sorted by.
SORTED = {"pages": ["slug"], "edges": ["source", "target", "type"], "facts": ["subject", "id"], "page_tags": ["tag", "page"], "vectors": ["slug"], "concepts": ["uri"], "schemes": ["uri"], "settings": ["key"]}

#: Names of stores that need a package of their own.
ELSEWHERE = ("qdrant", "meilisearch", "postgres", "lancedb", "zapdb", "replicate", "vfs")

_BACKENDS: dict[str, Callable] = {}


def register_backend(name: str, factory: Callable) -> None:
    """The last registration of a name holds."""
    _BACKENDS[name] = factory


def list_backends() -> list[str]:
    return list(_BACKENDS)


def _elsewhere(name: str) -> Callable:
    def factory(*_args, **_more):
        raise RuntimeError(f"store {name!r} isn't included: install its connector and register it")

    return factory


NOW = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), NOW)


class Store:
    """Pages, edges, facts, tags, vectors, concepts and settings under one folder, read and written by Spark.

    ``analyzer`` makes the terms of the index (by the search flags, if it isn't given). After ``compact_every`` commits a write
    compacts the store; with 0 it is left to the caller.
    """

    kind = "parquet"

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", analyzer: Analyzer | None = None, compact_every: int = 0):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.analyzer, self.compact_every = analyzer or Analyzer.of_flags(), compact_every
        self.expressions = search_flags()["FTS_WEBSEARCH_TO_TSQUERY"]
        self.commits = Commits(spark, path)
        self._held: list[DataFrame] = []

    def init(self) -> Store:
        """Ready for reads and writes: texts are indexed again if the kept terms were made by another analyzer."""
        made = self._analyzers(self.commits.state())
        if made - {self.analyzer.version}:
            self.compact(index_again=True)
        return self

    def _analyzers(self, state: State) -> set[str]:
        return {c["analyzer"] for c in [state.snapshot, *state.commits] if c.get("analyzer")}

    # commits

    def _save(self, name: str, rows: DataFrame) -> str:
        """Writes rows to a folder of their own, which no reader sees before it is committed; columns that ``rows`` lacks become null. Rows keep their order."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows = rows if "row" in rows.columns else rows.withColumn("row", F.monotonically_increasing_id())
        schema = T._parse_datatype_string(SCHEMAS[name])
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.format(self.fmt).options(**PACKING.get(self.fmt, {})).save(f"{self.path}/{folder}")
        return folder

    def write(self, tables: dict[str, DataFrame], txn: tuple[str, int] | None = None) -> int | None:
        """Writes rows to several tables as one commit; returns its number. Pages bring their postings.

        ``txn`` is (stream, micro-batch): one that was committed before is passed over, and None is returned.
        """
        if txn and self.commits.state().seen(txn[0]) >= txn[1]:
            return None
        folders = {name: self._save(name, rows) for name, rows in tables.items() if name != "pages"}
        more = {}
        if "pages" in tables:
            rows = tables["pages"]
            more = {"updated_at": now(), "content": F.lit(None).cast("string")}
            stamped = rows.withColumns({c: v for c, v in more.items() if c not in rows.columns})
            counted = stamped.withColumn("doc_len", Cutter(self.analyzer).count(F.col("content")))
            folders["pages"] = self._save("pages", counted)
            written = self._load("pages", [(folders["pages"], 0)])
            # of a page that is written twice here readers take the last row's postings, so the texts needn't be grouped
            folders["postings"] = self._save("postings", self._postings(written.filter(~F.coalesce("deleted", F.lit(False)))))
            more = {"analyzer": self.analyzer.version}
        number = self.commits.add(folders, {txn[0]: txn[1]} if txn else {}, more)
        if self.compact_every and len(self.commits.state().commits) > self.compact_every:
            self.compact()
        return number

    def _postings(self, pages: DataFrame) -> DataFrame:
        """Postings of pages (slug, row, content) in runs that are sorted by term, so that a filter on the term skips most of a file's pages."""
        return fulltext.positional_postings(pages, self.analyzer, more=["row"])

    # tables

    def _load(self, name: str, folders: list[tuple[str, int]]) -> DataFrame:
        """Rows of committed folders with their ``batch``."""
        if not folders:
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, batch long")
        rows = self.spark.read.format(self.fmt).schema(SCHEMAS[name]).load([f"{self.path}/{f}" for f, _ in folders])
        batch = F.create_map(*[x for f, b in folders for x in (F.lit(f.rpartition("/")[2]), F.lit(b).cast("long"))])
        return rows.withColumn("batch", F.element_at(batch, F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]*$", 1)))

    def raw(self, name: str, state: State | None = None) -> DataFrame:
        """A table with its columns ``batch`` and ``row``, as of now."""
        return self._load(name, (state or self.commits.state()).folders(name))

    def log(self, name: str, state: State | None = None) -> DataFrame:
        return self.raw(name, state).withColumn("seq", F.struct("batch", "row")).drop("batch", "row")

    # pages and their index

    def upsert_pages(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        return self.write({"pages": rows}, txn)

    def _rewritten(self, state: State, tables: list[tuple[str, int]]) -> DataFrame:
        """(slug, last, gone) of those pages in folders of the table that are there more than once or deleted: the last write's seq, and whether it deletes."""
        log = self._load("pages", tables).select("slug", "batch", "row", "deleted")
        last = log.groupBy("slug").agg(F.max(F.struct("batch", "row", F.coalesce("deleted", F.lit(False)).alias("gone"))).alias("v"), F.count(F.lit(1)).alias("n"))
        return last.filter((F.col("n") > 1) | F.col("v.gone")).select("slug", F.struct("v.batch", "v.row").alias("last"), "v.gone")

    def _live(self, rows: DataFrame, rewritten: DataFrame) -> DataFrame:
        """Of rows (slug, batch, row, ...) those of each page's last write. Only pages that were written again are looked up, so the others aren't moved."""
        few, some = _small(rewritten)
        if not some:
            return rows
        met = rows.join(few, "slug", "left")
        return met.filter(F.col("last").isNull() | (~F.col("gone") & (F.col("last") == F.struct("batch", "row")))).drop("last", "gone")

    def _changed(self, state: State) -> DataFrame:
        """(slug, seq, doc_len, deleted) of the last write of the pages that were written after the snapshot."""
        log = self._load("pages", state.added("pages")).select("slug", "batch", "row", "deleted", "doc_len")
        last = log.groupBy("slug").agg(F.max(F.struct("batch", "row", "deleted", "doc_len")).alias("v"))
        return last.select("slug", F.struct("v.batch", "v.row").alias("seq"), "v.doc_len", F.coalesce("v.deleted", F.lit(False)).alias("deleted"))

    def figures(self, state: State | None = None) -> DataFrame:
        """One row (n, avg_len) over all pages: the snapshot's figures, and what the pages written since then change in them."""
        state = state or self.commits.state()
        base = state.snapshot.get("figures", {"pages": 0, "words": 0})
        n, words = F.lit(base["pages"]), F.lit(base["words"])
        changed = self._changed(state)
        held = [f for f in state.folders("pages") if f not in state.added("pages")]
        before = self._load("pages", held).select("slug", F.col("doc_len").alias("was"))
        met = changed.join(before.join(changed.select("slug"), "slug", "left_semi"), "slug", "left")
        live, old = F.when(F.col("deleted"), 0).otherwise(1), F.when(F.col("was").isNull(), 0).otherwise(1)
        sums = met.agg(F.coalesce(F.sum(live - old), F.lit(0)).alias("pages"), F.coalesce(F.sum(live * F.col("doc_len") - F.coalesce("was", F.lit(0))), F.lit(0)).alias("words"))
        sums = sums.select((F.col("pages") + n).alias("n"), (F.col("words") + words).alias("words"))
        return sums.select("n", F.when(F.col("n") > 0, F.col("words") / F.col("n")).alias("avg_len"))

    def index(self, state: State | None = None) -> DataFrame:
        """(slug, term, tf, doc_len, positions) of the present pages: the snapshot's postings of pages that weren't written since, and the last writes' of those that were. A filter on the term reaches both scans."""
        state = state or self.commits.state()
        columns = ["slug", "term", "tf", "doc_len", "positions"]
        added = state.added("postings")
        held = [f for f in state.folders("postings") if f not in added]
        old = self._load("postings", held).select(*columns)
        if not state.commits:
            return old
        new = self._live(self._load("postings", added), self._rewritten(state, state.added("pages"))).select(*columns)
        if not held:
            return new
        written, some = _small(self._changed(state).select("slug"))
        return (old.join(written, "slug", "left_anti") if some else old).unionByName(new)

    def delete_page(self, slug: str) -> None:
        """Marks the page and its outgoing edges as deleted; again is harmless."""
        gone = edges_for(self.edges(), slug, "out").select("source", "target", "type").withColumn("deleted", F.lit(True))
        self.write({"pages": self.spark.createDataFrame([(slug, True)], "slug string, deleted boolean"), "edges": gone})

    def upsert_edges(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> None:
        self.write({"edges": rows}, txn)

    def upsert_facts(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> None:
        self.write({"facts": with_fact_defaults(rows)}, txn)

    def upsert_vectors(self, rows: DataFrame) -> None:
        """Embeddings (slug, embedding) of pages, made by any client."""
        self.write({"vectors": rows})

    def add_tags(self, rows: DataFrame) -> None:
        """Tags (page, tag)."""
        self.write({"page_tags": rows})

    def pages(self, state: State | None = None) -> DataFrame:
        return latest_pages(self.log("pages", state)).drop("doc_len")

    def edges(self, state: State | None = None) -> DataFrame:
        return latest_edges(self.log("edges", state))

    def facts(self, state: State | None = None) -> DataFrame:
        return latest_facts(self.log("facts", state))

    def vectors(self, state: State | None = None) -> DataFrame:
        last = self.log("vectors", state).groupBy("slug").agg(F.max_by("embedding", "seq").alias("embedding"))
        return last.join(self.pages(state).select("slug"), "slug", "left_semi")

    def page_tags(self, state: State | None = None) -> DataFrame:
        return self.log("page_tags", state).select("page", "tag").distinct()

    def get_page(self, slug: str) -> DataFrame:
        """(slug, content, updated_at); the filter on the key reaches the scan."""
        return latest_pages(self.log("pages").filter(F.col("slug") == slug)).select("slug", "content", "updated_at")

    def get_doc(self, slug: str):
        row = self.get_page(slug).first()
        if row is None:
            raise KeyError(f"no page {slug!r}")
        return row

    def recall(self, entity: str, limit: int = 50, since: str = "1970-01-01") -> DataFrame:
        return recall(self.facts(), entity, limit, since)

    def search(self, query: str | list[str], limit: int = 50, tags: list[str] = (), since: str | None = None, near: list[float] | None = None) -> DataFrame:
        """(slug, excerpt, score, source) of pages by full text, and by the vector ``near`` where one is given; of those with any of the tags and updated since then.

        ``query`` is an expression (words, phrases in quotes, OR, ``-`` to exclude, ``*`` for a prefix) or a list of words, all of
        which are wanted; with the flag of search expressions off, a string is such a list too. Texts are read only for the excerpts of what was found.
        """
        query = query.split() if isinstance(query, str) and not self.expressions else query
        state = self.commits.state()
        asked = query if isinstance(query, str) else " ".join('"' + t.replace('"', " ") + '"' for t in query)
        queries = self.spark.createDataFrame([(0, asked)], "qid int, query string")
        hits = fulltext.atom_hits(self.index(state), fulltext.parsed_atoms(queries, self.analyzer))
        words = fulltext.search(self.index(state), self.figures(state), queries, self.analyzer, hits=hits).select("slug", "score")
        close = self.vectors(state) if near is not None else None
        if tags or since:
            fits = self.pages(state).select("slug", "updated_at").filter(F.col("updated_at") >= since if since else F.lit(True)).select("slug")
            if tags:
                fits = fits.join(self.log("page_tags", state).filter(F.col("tag").isin(list(tags))).select(F.col("page").alias("slug")), "slug", "left_semi")
            words = words.join(fits, "slug", "left_semi")
            close = close.join(fits, "slug", "left_semi") if close is not None else None
        lists = ranked(words, 2 * limit), None if close is None else ranked(vector_search(close, near, 2 * limit), 2 * limit)
        found = fused_search(*lists, limit)
        some = F.broadcast(found.select("slug"))  # at most ``limit`` slugs
        texts = latest_pages(self.log("pages", state).join(some, "slug", "left_semi")).select("slug", "content")
        windows = fulltext.best_windows(hits.join(some, "slug", "left_semi"))
        shown = found.join(windows.drop("qid"), "slug", "left").withColumns({"first": F.coalesce("first", F.lit(0)), "places": F.coalesce("places", F.array().cast("array<int>"))})
        return fulltext.excerpts(shown, texts, self.analyzer).select("slug", "excerpt", "score", "source").orderBy(F.desc("score"), "slug")

    def search_all(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, slug, score, rank) of each expression of a table (qid, query), from the kept index."""
        state = self.commits.state()
        return fulltext.search(self.index(state), self.figures(state), queries, self.analyzer, top_k)

    # upkeep

    def compact(self, index_again: bool = False) -> int:
        """Writes each table's present state, sorted by key, as a snapshot; returns the number of the last commit in it.

        Commits made meanwhile stay after the snapshot, so writers needn't wait. Postings are moved on as they are, in sorted runs that join small writes', unless texts are to be indexed again.
        """
        state = self.commits.state()
        views = {"pages": self._live(self.raw("pages", state), self._rewritten(state, state.folders("pages"))).drop("batch", "row", "deleted"), "edges": self.edges(state), "facts": self.facts(state), "page_tags": self.page_tags(state), "vectors": self.vectors(state), "concepts": own_concepts(self.log("concepts", state)), "schemes": self.schemes(state), "settings": latest_settings(self.log("settings", state))}
        folders = {name: self._save(name, rows.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])) for name, rows in views.items() if state.folders(name)}
        figures = {"pages": 0, "words": 0}
        if "pages" in folders:
            pages = self._load("pages", [(folders["pages"], 0)])
            if index_again:
                counted = pages.drop("doc_len", "batch").withColumn("doc_len", Cutter(self.analyzer).count(F.col("content")))
                folders["pages"] = self._save("pages", counted)
                pages = self._load("pages", [(folders["pages"], 0)])
                folders["postings"] = self._save("postings", self._postings(pages))
            else:
                folders["postings"] = self._save("postings", fulltext.sorted_runs(self.index(state), [("term", "ascending"), ("slug", "ascending")]).withColumn("row", F.lit(0)))
            row = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).first()
            figures = {"pages": row.pages, "words": row.words}
        streams = {name for c in [state.snapshot, *state.commits] for name in c.get("streams", {})}
        self.commits.add_snapshot(state.version, folders, {name: state.seen(name) for name in streams}, {"figures": figures, "analyzer": self.analyzer.version})
        return state.version

    def vacuum(self, keep_seconds: float = 3600) -> list[str]:
        """Deletes what no reader of the present state needs and is older than ``keep_seconds``, such as the leavings of killed writes; a write or read may not take longer than that."""
        return self.commits.vacuum(keep_seconds)

    # concepts and settings

    def add_concepts(self, rows: DataFrame) -> None:
        """Concepts by uri; a column that is null or missing leaves what was said before."""
        self.write({"concepts": rows})

    def add_schemes(self, rows: DataFrame) -> None:
        self.write({"schemes": rows})

    def concepts(self) -> DataFrame:
        return latest_concepts(self.log("concepts"))

    def schemes(self, state: State | None = None) -> DataFrame:
        return self.log("schemes", state).groupBy("uri").agg(F.max_by(F.struct("pref_label", "top_concepts"), "seq").alias("v")).select("uri", "v.*")

    def concept(self, uri: str):
        """The concept's row, or None."""
        return self.concepts().filter(F.col("uri") == uri).first()

    def hold(self, table: DataFrame) -> DataFrame:
        """Cache a view until the store is closed."""
        self._held.append(table.persist())
        return self._held[-1]

    def close(self) -> None:
        """Lets go of the views that this store holds; other cached tables of the session stay."""
        while self._held:
            self._held.pop().unpersist()


register_backend("parquet", Store)
for _name in ELSEWHERE:
    register_backend(_name, _elsewhere(_name))


def open_store(spark: SparkSession, path: str | None = None, backend: str | None = None, **more):
    """The backend named by the argument, else by MARLSTONE_BACKEND, else parquet; initialised. Without a path it lies in the warehouse."""
    name = backend or os.environ.get("MARLSTONE_BACKEND") or "parquet"
    if name not in _BACKENDS:
        raise ValueError(f"unknown store {name!r}; there are: {', '.join(_BACKENDS)}")
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/marlstone"
    return _BACKENDS[name](spark, path, **more).init()


class Settings:
    """Values by key: set ones (kept in the store) before the environment before defaults.

    Set values are an append log, so every session sees them; a null marks one that was cleared.
    """

    def __init__(self, store: Store, environment: dict[str, str], defaults: dict[str, str]):
        self.store, self.environment, self.defaults = store, environment, defaults

    def _layer(self, values: dict[str, str]) -> DataFrame:
        return self.store.spark.createDataFrame(list(values.items()), "key string, value string")

    def overrides(self) -> DataFrame:
        return latest_settings(self.store.log("settings"))

    def snapshot(self) -> DataFrame:
        """(key, value, source) of all keys."""
        return settings(self.overrides(), self._layer(self.environment), self._layer(self.defaults))

    def get(self, key: str) -> tuple[str | None, str]:
        """(value, source); the source of a key that isn't there is ``absent``."""
        row = self.snapshot().filter(F.col("key") == key).first()
        return (row.value, row.source) if row else (None, "absent")

    def set(self, values: dict[str, str]) -> None:
        self.store.write({"settings": self._layer(values)})

    def clear(self, keys: list[str]) -> None:
        self.store.write({"settings": self._layer(dict.fromkeys(keys))})

    def reset(self) -> None:
        """Clears all that are set."""
        self.store.write({"settings": self.overrides().select("key")})


def settings(overrides: DataFrame, environment: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, value, source) of three tables (key, value): override before environment before default."""
    layers = [(overrides, "db_override"), (environment, "env"), (defaults, "default")]
    rows = None
    for at, (table, source) in enumerate(layers):
        part = table.select("key", "value", F.lit(at).alias("at"), F.lit(source).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.filter("value is not null").groupBy("key").agg(F.min_by(F.struct("value", "source"), "at").alias("b"))
    return best.select("key", "b.value", "b.source")


def _small(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, to be broadcast if they are at most BROADCAST_ROWS, and their number up to that."""
    n = rows.limit(fulltext.BROADCAST_ROWS + 1).count()
    return (F.broadcast(rows) if n <= fulltext.BROADCAST_ROWS else rows), n


def latest_pages(log: DataFrame) -> DataFrame:
    """Each slug's last write; deleted ones are gone."""
    values = [c for c in log.columns if c not in ("slug", "seq")]
    last = log.groupBy("slug").agg(F.max_by(F.struct(*values), "seq").alias("v")).select("slug", "v.*")
    return last.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in values else last


def latest_edges(log: DataFrame) -> DataFrame:
    """Each (source, target, type) with the evidence of its last write."""
    values = [c for c in ("evidence", "deleted") if c in log.columns]
    last = log.groupBy("source", "target", "type").agg(F.max_by(F.struct(*values), "seq").alias("v")).select("source", "target", "type", "v.*")
    return last.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in values else last


def latest_facts(log: DataFrame) -> DataFrame:
    """By id: subject, predicate and source of the first write; object, ts and confidence of the last."""
    first, last = F.min_by(F.struct("subject", "predicate", "source"), "seq"), F.max_by(F.struct("object", "ts", "confidence"), "seq")
    found = log.groupBy("id").agg(first.alias("f"), last.alias("l"))
    return found.select("id", "f.subject", "f.predicate", "l.object", "f.source", "l.ts", F.coalesce("l.confidence", F.lit(1.0)).alias("confidence"))


def latest_settings(log: DataFrame) -> DataFrame:
    """Each key's last value; those cleared are gone."""
    return log.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("key", "v.value").filter("value is not null")


def own_concepts(log: DataFrame) -> DataFrame:
    """By uri, each column's last value that isn't null."""
    plain = [c for c in log.columns if c not in ("uri", "seq")]
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return log.groupBy("uri").agg(*[last(c) for c in plain])


def latest_concepts(log: DataFrame) -> DataFrame:
    """By uri, each column's last value that isn't null; broader and narrower also hold what other concepts say of them.

    Concepts that are only linked to are labelled by their uri.
    """
    own = own_concepts(log)
    links = own.select("uri", F.explode("broader").alias("broader")).unionByName(own.select(F.explode("narrower").alias("uri"), F.col("uri").alias("broader")))
    up = links.groupBy("uri").agg(F.array_sort(F.collect_set("broader")).alias("up"))
    down = links.groupBy(F.col("broader").alias("uri")).agg(F.array_sort(F.collect_set("uri")).alias("down"))
    every = own.join(up, "uri", "full").join(down, "uri", "full")
    none = F.array().cast("array<string>")
    more = {"broader": F.coalesce("up", none), "narrower": F.coalesce("down", none), "pref_label": F.coalesce("pref_label", "uri")}
    return every.withColumns(more).drop("up", "down")


def with_fact_defaults(facts: DataFrame) -> DataFrame:
    """Facts without time get the present one; those without id subject::predicate::milliseconds."""
    made = F.concat_ws("::", "subject", "predicate", F.unix_millis(F.current_timestamp()).cast("string"))
    stamped = facts.withColumn("ts", F.coalesce("ts", now()) if "ts" in facts.columns else now())
    return stamped.withColumn("id", F.coalesce("id", made) if "id" in facts.columns else made)


def edges_for(edges: DataFrame, slug: str | Column, direction: str = "both") -> DataFrame:
    """Edges in, out or both; one predicate, so that a self-loop comes once."""
    fits = {"out": F.col("source") == slug, "in": F.col("target") == slug, "both": (F.col("source") == slug) | (F.col("target") == slug)}
    return edges.filter(fits[direction])


def recall(facts: DataFrame, entity: str, limit: int = 50, since: str = "1970-01-01") -> DataFrame:
    """A subject's facts since then, newest first (times compare as text), ties by id."""
    return facts.filter((F.col("subject") == entity) & (F.col("ts") >= since)).orderBy(F.desc("ts"), "id").limit(limit)


def memory_of(headers: Column, names: list[str], default: str = "default") -> Column:
    """The first of the header ``names`` that a request's map has, else the default store."""
    return F.coalesce(*[F.element_at(headers, n) for n in names], F.lit(default))


def resolve_memory(requests: DataFrame, handles: DataFrame, names: list[str]) -> DataFrame:
    """Adds the handle's slug and data_dir; unknown stores fall back to ``default``, which always is."""
    asked = requests.withColumn("asked", memory_of(F.col("headers"), names))
    known = handles.select(F.col("slug").alias("memory"), "data_dir")
    found = asked.join(known, asked["asked"] == known["memory"], "left")
    return found.withColumn("memory", F.coalesce("memory", F.lit("default"))).drop("asked")
