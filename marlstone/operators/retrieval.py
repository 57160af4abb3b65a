"""Full-text and vector ranking, fusion, reranking and retrieval metrics.

A hit is a row of (list_idx, rank, slug, score); queries may add key columns, which are
passed as ``keys`` and partition everything. Ranks and positions count from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.analysis import DEFAULT
from marlstone.functions.vectors import cosine, l2_normalize
from marlstone.operators.fulltext import positional_postings

RRF_K = 20
BM25_K1, BM25_B = 1.2, 0.75


# Full text


def tokens(text: Column) -> Column:
    """The terms of a text, as the index of a store has them; a null text has none."""
    return DEFAULT.terms(F.coalesce(text, F.lit("")))


def postings(pages: DataFrame, slug: str = "slug", text: str = "content", more: list[str] = ()) -> DataFrame:
    """The inverted index: (slug, term, tf, doc_len) and the columns in ``more``; one row per page and term. Pages have slugs of their own."""
    return positional_postings(pages, DEFAULT, slug, text, more, positions=False)


def figures_of_postings(index: DataFrame, pages: int) -> DataFrame:
    """One row (n, avg_len) of so many pages, by the postings of all of them."""
    words = F.coalesce(F.sum("tf"), F.lit(0))
    return index.agg(F.lit(pages).cast("long").alias("n"), F.when(F.lit(pages > 0), words / F.lit(max(pages, 1))).alias("avg_len"))


def corpus_figures(pages: DataFrame, text: str = "content") -> DataFrame:
    """One row (n, avg_len)."""
    return pages.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count("n").alias("n"), F.avg("n").alias("avg_len"))


def _weight(n: Column, df: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    """A term's part of the score; its inverse document frequency is floored at 1e-6."""
    idf = F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / avg_len))


def bm25(pages: DataFrame, terms: list[str], slug: str = "slug", text: str = "content", keep: list[str] = ()) -> DataFrame:
    """(slug, score) of the pages that have all ``terms``, and their columns in ``keep``.

    Texts are scanned once: what leaves the scan is one narrow row per page, which both the corpus
    figures and the scores read from the same exchange.
    """
    terms = sorted({t.lower() for t in terms})
    words = pages.select(F.col(slug).alias("slug"), *keep, tokens(F.col(text)).alias("words"))
    times = lambda term: F.size(F.filter("words", lambda w: w == F.lit(term))).cast("double")
    tf = [times(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = words.select("slug", *keep, F.size("words").cast("double").alias("len"), *tf).repartition("slug")
    held = F.struct(*counted.columns)  # both readers take all columns, so that Spark makes the exchange once
    figures = counted.select(held.alias("r")).agg(F.count("r").alias("n"), F.avg("r.len").alias("avg_len"), *[F.sum(F.when(F.col(f"r.tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))], F.max("r.slug").alias("last"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _weight(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("len"), F.col("avg_len"))
    every = F.least(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(1.0)) if terms else F.lit(0.0)
    scored = counted.join(F.broadcast(figures)).withColumn("score", F.when((every > 0) & (F.col("n") > 0), score))  # one row
    return scored.filter("score is not null").select("slug", *keep, "score")


def bm25_of_postings(matches: DataFrame, figures: DataFrame, terms: list[str]) -> DataFrame:
    """(slug, score) of the pages that have all ``terms``, from (slug, term, tf, doc_len) of these and one row (n, avg_len)."""
    wanted = len({t.lower() for t in terms})
    frequency = matches.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = matches.join(F.broadcast(frequency), "term").join(F.broadcast(figures))  # a row per term; one row
    part = _weight(F.col("n"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return met.groupBy("slug").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("got")).filter(F.col("got") == wanted).select("slug", "score")


def ranked(hits: DataFrame, limit: int, order: str = "score") -> DataFrame:
    """The first ``limit`` with their ``rank``; ties go by slug. The cut comes first, so that only those few are numbered in one task."""
    top = hits.orderBy(F.desc(order), "slug").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), "slug")) - 1)


def fused_search(words: DataFrame, near: DataFrame | None, top_k: int) -> DataFrame:
    """(slug, score, source) of two ranked lists: the sum of 1 / (60 + rank); the source is keyword, vector, or fused where both have it."""
    lists = words.select("slug", "rank", F.lit("keyword").alias("source"))
    if near is None:
        return lists.filter(F.col("rank") < top_k).select("slug", (1 / (60 + F.col("rank"))).alias("score"), "source")
    lists = lists.unionByName(near.select("slug", "rank", F.lit("vector").alias("source")))
    source = F.when(F.count(F.lit(1)) > 1, "fused").otherwise(F.min("source"))
    return lists.groupBy("slug").agg(F.sum(1 / (60 + F.col("rank"))).alias("score"), source.alias("source")).orderBy(F.desc("score"), "slug").limit(top_k)


def hybrid_search(pages: DataFrame, terms: list[str], top_k: int = 5, slug: str = "slug", text: str = "content", near: DataFrame | None = None) -> DataFrame:
    """(slug, score, source): twice ``top_k`` by BM25, and of (slug, score) in ``near`` where there is one, fused to the first ``top_k``."""
    words = ranked(bm25(pages, terms, slug, text), 2 * top_k)
    return fused_search(words, None if near is None else ranked(near, 2 * top_k), top_k)


def snippet(text: Column, term: str, words: int = 32) -> Column:
    """Up to ``words`` words from the first with the term, the term in bold, with ellipses where cut."""
    parts = F.split(text, r"\s+")
    at = F.greatest(F.lit(1), F.array_position(F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), term.lower()).cast("int") - 4)
    cut = F.array_join(F.slice(parts, at, words), " ")
    bold = F.regexp_replace(cut, rf"(?i)\b({term})\b", "<b>$1</b>")
    return F.concat(F.when(at > 1, "...").otherwise(""), bold, F.when(F.size(parts) >= at + words, "...").otherwise(""))


# Fusion


def rrf_fuse(hits: DataFrame, n_lists: int, limit: int | None = None, k: int = RRF_K, keys: list[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank + 1) over its best, n_lists / (k + 1), at most 1.

    A slug met twice in a list counts twice. Ties go to the first met.
    """
    best = n_lists / (k + 1)
    fused = hits.groupBy(*keys, "slug").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("raw"), F.min(F.struct("list_idx", "rank")).alias("first"))
    return _cut(fused.withColumn("score", F.least(F.lit(1.0), F.col("raw") / F.lit(best))), limit, keys)


def rsf_fuse(hits: DataFrame, n_lists: int, weights: list[float] | None = None, limit: int | None = None, keys: list[str] = ()) -> DataFrame:
    """Relative-score fusion: scores min-max scaled by list (a list of equal scores: 1), summed by weight."""
    if weights is not None and len(weights) != n_lists:
        raise ValueError("one weight for each list is needed")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in (weights or [1 / n_lists] * n_lists)]), F.col("list_idx").cast("int") + 1)
    bounds = hits.groupBy(*keys, "list_idx").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = hits.join(bounds, [*keys, "list_idx"])
    part = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    fused = scaled.withColumn("part", weight * part).groupBy(*keys, "slug").agg(F.sum("part").alias("score"), F.min(F.struct("list_idx", "rank")).alias("first"))
    return _cut(fused, limit, keys)


def _cut(fused: DataFrame, limit: int | None, keys: list[str]) -> DataFrame:
    out = [*keys, "slug", "score", F.lit("fused").alias("source")]
    if limit is None:
        return fused.select(*out)
    if not keys:
        return fused.orderBy(F.desc("score"), "first").limit(limit).select(*out)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first"))
    return fused.withColumn("__place", place).filter(F.col("__place") <= limit).select(*out)


def characterize(query: Column) -> Column:
    """struct(token_count, is_phrase, is_boolean) of a query."""
    trimmed = F.trim(query)
    return F.struct(
        F.size(F.filter(F.split(trimmed, r"\s+"), lambda t: t != "")).alias("token_count"), trimmed.rlike(r"""^(".+"|'.+')$""").alias("is_phrase"), trimmed.rlike(r"\b(AND|OR|NOT)\b|\s-\S").alias("is_boolean")
    )


def _by_kind(query: Column, phrase, boolean, short, long, other) -> Column:
    kind = characterize(query)
    return F.when(kind["is_phrase"], phrase).when(kind["is_boolean"], boolean).when(kind["token_count"] <= 2, short).when(kind["token_count"] >= 10, long).otherwise(other)


def select_rrf_k(query: Column) -> Column:
    return _by_kind(query, *[F.lit(k) for k in (10, 15, 15, 40, 20)])


def select_weights(query: Column) -> Column:
    """struct(fts, semantic)."""
    pairs = [(0.8, 0.2), (0.7, 0.3), (0.65, 0.35), (0.3, 0.7), (0.5, 0.5)]
    return _by_kind(query, *[F.struct(F.lit(a).alias("fts"), F.lit(b).alias("semantic")) for a, b in pairs])


# Reranking


def mmr_rerank(hits: DataFrame, key: str, lam: float = 0.5, limit: int | None = None) -> DataFrame:
    """Maximal marginal relevance by query: (key, slug, score, pos).

    ``hits`` has key, ord, slug, score, embedding. The greedy choice is sequential, so a query's
    hits (a result list, cut before) are one group. Similarity to those chosen is floored at 0; hits
    without an embedding, or with an empty one, follow in input order.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        most = len(pdf) if limit is None else limit
        has = [i for i, e in enumerate(pdf["embedding"]) if e is not None and len(e)]
        rest = [i for i in range(len(pdf)) if i not in set(has)]
        chosen: list[int] = []
        if has:
            vectors = np.stack([np.asarray(pdf["embedding"][i], dtype=float) for i in has])
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
            scores, near, open_ = pdf["score"].to_numpy()[has], np.zeros(len(has)), np.ones(len(has), bool)
            while open_.any() and len(chosen) < most:
                value = np.where(open_, lam * scores - (1 - lam) * near, -np.inf)
                i = int(np.argmax(value))
                open_[i] = False
                chosen.append(has[i])
                near = np.maximum(near, unit @ unit[i])
        chosen = (chosen + rest)[:most]
        out = pdf.loc[chosen, [key, "slug", "score"]].copy()
        out["pos"] = range(len(out))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return hits.groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, slug {kinds['slug']}, score double, pos long")


def chain_of(slug: Column, chain_id: Column | None = None) -> Column:
    """The chain id, if there is one; else the slug without ``#chunk-N``, then without ``::N``."""
    plain = F.regexp_replace(F.regexp_replace(slug, r"#chunk-\d+$", ""), r"::\d+$", "")
    return plain if chain_id is None else F.coalesce(F.when(chain_id != "", chain_id), plain)


def dedup_hits(hits: DataFrame, chain: Column, per_chain: int = 1, order: str = "ord") -> DataFrame:
    """The best ``per_chain`` hits of each chain, ties by ``order``.

    Spark keeps only the first rows of a chain before its shuffle (a window group limit), so a hot chain is small on arrival.
    """
    place = F.row_number().over(Window.partitionBy("__chain").orderBy(F.desc("score"), order))
    return hits.withColumn("__chain", chain).withColumn("__place", place).filter(F.col("__place") <= per_chain).drop("__chain", "__place")


def vector_search(vectors: DataFrame, query: list[float], top_k: int) -> DataFrame:
    """(slug, score) of the nearest by cosine; ``vectors`` has slug and embedding."""
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("slug", cosine(F.col("embedding"), at).alias("score")).orderBy(F.desc("score"), "slug").limit(top_k)


def two_stage_rank(candidates: DataFrame, query: list[float], coarse: int, coarse_k: int, final_k: int) -> DataFrame:
    """(slug, score): the best ``coarse_k`` by cosine of short vectors, then by cosine of full ones.

    ``candidates`` has slug, ord, coarse and full; only the query is cut to ``coarse``. A slug that repeats takes the
    full vector of its first row; rows whose full vector is null keep the coarse score. Only the
    full vectors of the first stage's slugs leave their scan.
    """
    whole = F.array(*[F.lit(float(x)) for x in query])
    short = l2_normalize(F.slice(whole, 1, coarse))
    top = candidates.select("slug", "ord", cosine(F.col("coarse"), short).alias("coarse_score")).orderBy(F.desc("coarse_score"), "ord").limit(coarse_k)
    full = candidates.select(F.col("slug").alias("its"), F.col("ord").alias("at"), "full")
    met = full.join(F.broadcast(top), F.col("its") == F.col("slug"))  # at most ``coarse_k`` rows
    first = F.min_by("full", F.when(F.col("full").isNotNull(), F.col("at")))
    scored = met.groupBy("slug", "ord", "coarse_score").agg(first.alias("full")).withColumn("score", F.coalesce(cosine(F.col("full"), whole), F.col("coarse_score")))
    return scored.orderBy(F.desc("score"), F.desc("coarse_score"), "ord").limit(final_k).select("slug", "score")


def federated_search(hits: DataFrame, memories: list[str], limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """(slug, score, memory) over stores: ``hits`` has memory, rank, slug; the memory is the first that has the slug."""
    place = F.array_position(F.array(*[F.lit(m) for m in memories]), F.col("memory")) - 1
    lists = hits.withColumn("list_idx", place).filter("list_idx >= 0")
    fused = lists.groupBy("slug").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("raw"), F.min(F.struct("list_idx", "rank")).alias("first"))
    memory = F.element_at(F.array(*[F.lit(m) for m in memories]), F.col("first.list_idx").cast("int") + 1)
    out = fused.select("slug", F.least(F.lit(1.0), F.col("raw") / F.lit(len(memories) / (k + 1))).alias("score"), memory.alias("memory"), "first")
    return (out if limit is None else out.orderBy(F.desc("score"), "first").limit(limit)).drop("first")


# Metrics: run (qid, pos from 1, slug), qrels (qid, slug, grade)


def evaluate(run: DataFrame, qrels: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """(k, mrr, recall, precision, ndcg): means over the queries of ``run`` or ``qrels``."""
    ks = ks or [1, 5, 10, 20]
    per = per_query(run, qrels, ks)
    return per.groupBy("k").agg(F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("ndcg").alias("ndcg"))


def per_query(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(qid, k, rr, recall, precision, ndcg). Precision divides by min(k, length of the list); repeats count each time."""
    graded = run.join(qrels, ["qid", "slug"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)).cast("double"))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    found = graded.groupBy("qid").agg(
        F.min(F.when(F.col("grade") > 0, F.col("pos"))).alias("first"),
        F.count(F.lit(1)).alias("length"),
        *[F.sum(F.when((F.col("pos") <= k) & (F.col("grade") > 0), 1).otherwise(0)).alias(f"hits{k}") for k in ks],
        *[F.sum(F.when(F.col("pos") <= k, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "slug"))
    best = qrels.withColumn("pos", place).withColumn("grade", F.col("grade").cast("double"))
    ideal = best.groupBy("qid").agg(
        F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("relevant"), *[F.sum(F.when(F.col("pos") <= k, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias(f"ideal{k}") for k in ks]
    )
    joined = found.join(ideal, "qid", "full")
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    each = [
        F.struct(
            F.lit(k).alias("k"),
            F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
            ratio(F.col(f"hits{k}"), F.col("relevant")).alias("recall"),
            ratio(F.col(f"hits{k}"), F.least(F.lit(k), F.col("length"))).alias("precision"),
            ratio(F.col(f"dcg{k}"), F.col(f"ideal{k}")).alias("ndcg"),
        )
        for k in ks
    ]
    return joined.select("qid", F.inline(F.array(*each)))


# Inverted-index search over many queries


def search_many(index: DataFrame, corpus: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(qid, slug, score, rank) for a table of (qid, term), against postings kept as a table.

    ``corpus`` is one row (n, avg_len). Only postings of the queries' terms are joined; each
    query keeps its first ``top_k`` by a window group limit.
    """
    asked = queries.select("qid", F.lower("term").alias("term")).distinct()
    frequency = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = index.join(asked, "term").join(frequency, "term").join(F.broadcast(corpus))  # one row
    part = _weight(F.col("n"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    wanted = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"))
    scored = met.groupBy("qid", "slug").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("got")).join(wanted, "qid").filter("got = wanted")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slug")) - 1
    return scored.withColumn("rank", place).filter(F.col("rank") < top_k).select("qid", "slug", "score", "rank")

