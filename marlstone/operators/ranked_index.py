"""Ranking that skips postings: the first pages of a conjunction without reading what can't be among them.

Postings are kept by term and *level*, the posting's share of the most that its term can add to a score, in steps of 1 / ``LEVELS``. A smaller
table has each level's number of postings and greatest share in each run, which bounds what one of them adds. The corpus figures are kept with them.

A search first reads the best levels of its terms, doubling them until they hold enough pages with all terms: the last of the first ``top_k`` gives a score to
reach. Then it reads those levels only whose bound, with the best of all other terms, reaches that score. The result is that of
reading all of the terms' postings. Files are written where the index is read, in runs sorted by term and level, so what is skipped isn't read and no posting is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.fulltext import BM25_B, BM25_K1, in_runs, sorted_runs, weight

LEVELS = 32
#: So many times ``top_k`` postings of each term are read first.
AHEAD = 4


@dataclass
class Found:
    """The pages (slug, score), and how many of the terms' postings were read, and are there."""

    pages: DataFrame
    read: int
    total: int


def _summed_runs(shares: DataFrame) -> DataFrame:
    """(term, level, postings, most) of (term, level, share) by run; a search adds up the runs' rows of its own terms."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in in_runs(batches):
            sums = pa.Table.from_batches([run]).group_by(["term", "level"]).aggregate([("share", "count"), ("share", "max")])
            sums = sums.select(["term", "level", "share_count", "share_max"]).rename_columns(["term", "level", "postings", "most"])
            yield from sums.sort_by([("term", "ascending"), ("level", "descending")]).combine_chunks().to_batches()

    return shares.mapInArrow(summed, "term string, level int, postings long, most double")


class RankedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, index: DataFrame, figures: DataFrame) -> RankedIndex:
        """Keeps postings (slug, term, tf, doc_len) by level; ``figures`` is one row (n, avg_len)."""
        figures.select(F.col("n").cast("long").alias("n"), F.coalesce("avg_len", F.lit(0.0)).alias("avg_len")).coalesce(1).write.parquet(f"{self.path}/figures")
        row = self._read("figures").first()
        share = F.col("tf") / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / F.lit(max(row.avg_len, 1e-9))))
        leveled = index.select("slug", "term", "tf", "doc_len", F.floor(share * LEVELS).cast("int").alias("level"))
        sorted_runs(leveled, [("term", "ascending"), ("level", "descending"), ("slug", "ascending")]).write.parquet(f"{self.path}/postings")
        _summed_runs(self._read("postings").select("term", "level", share.alias("share"))).write.parquet(f"{self.path}/levels")
        return self

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _scored(self, chosen: dict[str, int], df: dict[str, int], n: int, avg_len: float) -> DataFrame:
        """(slug, score) of pages that have all terms at their chosen level or above."""
        near = F.lit(False)
        for term, level in chosen.items():
            near = near | ((F.col("term") == term) & (F.col("level") >= level))
        counts = F.element_at(F.create_map(*[x for t, c in df.items() for x in (F.lit(t), F.lit(c))]), F.col("term"))
        met = self._read("postings").filter(near)
        part = weight(F.lit(n), counts, F.col("tf"), F.col("doc_len"), F.lit(avg_len))
        # summed in the order of the terms, as a score must not depend on the order of rows
        sums = F.aggregate(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))), F.lit(0.0), lambda a, x: a + x["part"])
        return met.groupBy("slug").agg(sums.alias("score"), F.count(F.lit(1)).alias("got")).filter(F.col("got") == len(chosen)).select("slug", "score")

    def top(self, terms: list[str], top_k: int) -> Found:
        """The first ``top_k`` pages that have all terms, by falling score, then slug. Terms are as the index has them; repeated ones count once, and none finds nothing."""
        terms, row = sorted(set(terms)), self._read("figures").first()
        levels: dict[str, list] = {t: [] for t in terms}
        parts = self._read("levels").filter(F.col("term").isin(terms))
        for r in parts.groupBy("term", "level").agg(F.sum("postings").alias("postings"), F.max("most").alias("most")).collect():  # at most LEVELS for each term
            levels[r.term].append(r)
        total = sum(r.postings for rows in levels.values() for r in rows)
        if not terms or not all(levels.values()):
            return Found(self._read("postings").select("slug", F.lit(0.0).alias("score")).limit(0), 0, total)
        df = {t: sum(r.postings for r in rows) for t, rows in levels.items()}
        idf = {t: max(1e-6, math.log((row.n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
        bound = {t: {r.level: idf[t] * (BM25_K1 + 1) * r.most for r in rows} for t, rows in levels.items()}
        size = lambda chosen: sum(r.postings for t, rows in levels.items() for r in rows if r.level >= chosen[t])
        ahead, read = AHEAD * top_k, 0
        while True:
            chosen = {t: self._down_to(rows, ahead) for t, rows in levels.items()}
            scored = self._scored(chosen, df, row.n, row.avg_len)
            best = [r.score for r in scored.orderBy(F.desc("score")).limit(top_k).collect()]
            read += size(chosen)
            if len(best) >= top_k or size(chosen) == total:
                break
            ahead *= 2
        if size(chosen) < total:
            most = {t: max(b.values()) for t, b in bound.items()}
            reach = best[-1] - 1e-9
            needed = {t: min((lv for lv, b in bound[t].items() if b + sum(most.values()) - most[t] >= reach), default=LEVELS + 1) for t in terms}
            if any(needed[t] < chosen[t] for t in terms):
                read += size(needed)
                scored = self._scored(needed, df, row.n, row.avg_len)
        return Found(scored.orderBy(F.desc("score"), "slug").limit(top_k), read, total)

    @staticmethod
    def _down_to(rows: list, postings: int) -> int:
        """The level down to which there are so many postings."""
        met = 0
        for r in sorted(rows, key=lambda r: -r.level):
            met += r.postings
            if met >= postings:
                break
        return r.level
