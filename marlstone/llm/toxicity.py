"""Toxicity by a classifier chain of linear models.

The chain's categories are label columns, in order. The model of a category sees
the document's features and the probabilities of all earlier categories. For
training these are out-of-fold predictions, so a later model learns from
probabilities as good as those it meets later on; in use they come from models fitted on all rows.

Features are which of the selected words (runs of letters) and word beginnings (4 to 6 bytes) a
text has, and shares of upper case, symbols, digits and repeated words.
They are selected on the labelled sample by their association with a category,
by a distributed count of documents. The models are fitted on at most
``max_rows`` labelled rows, taken by a hash of the id; the bound is a
parameter. They are written once, with their texts. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import NOT_LETTER, SPACE, U64, pieces, prefix_hashes, word_hashes, word_spans
from .common import Scratch

MAX_ROWS = 12_000
PER_CATEGORY = 384
FOLDS = 3
PREFIXES = (4, 5, 6)
DENSE = 7

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = NOT_LETTER & ~SPACE & ~_DIGIT
_SYMBOL[[0x2E, 0x2C]] = False


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, their rows, word hashes' repeats per row)."""
    starts, lengths, rows = word_spans(data, offsets, NOT_LETTER)
    words = word_hashes(data, starts, lengths)
    again = np.zeros(len(offsets) - 1)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:][same], minlength=len(offsets) - 1) / np.maximum(1, np.bincount(rows, minlength=len(offsets) - 1))
    found, of = [words], [rows]
    for width in PREFIXES:
        long = lengths > width
        found.append(prefix_hashes(data, starts[long], width))
        of.append(rows[long])
    return np.concatenate(found), np.concatenate(of), again


def _shares(data: np.ndarray, offsets: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Dense features by row."""
    n = np.maximum(1, np.diff(offsets))
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]) / n
    upper, digit, symbol, space = share(_UPPER), share(_DIGIT), share(_SYMBOL), share(SPACE)
    return np.stack([upper, digit, symbol, space, again, np.log1p(n) / 10, (symbol > 0.05).astype(float)], axis=1)


@dataclass
class ChainModel:
    """Selected features and, by category, weights: features, dense, earlier categories, constant."""

    categories: list[str]
    selected: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    limit: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.selected & U64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature number) of selected features present, each once, and dense features."""
        hashes, rows, again = _tokens(data, offsets)
        near = self.maybe[(hashes & U64(0xFFFFF)).astype(np.int64)]
        hashes, rows = hashes[near], rows[near]
        place = np.minimum(np.searchsorted(self.selected, hashes), max(0, len(self.selected) - 1))
        real = self.selected[place] == hashes if len(self.selected) else np.zeros(len(hashes), bool)
        pair = np.unique(rows[real].astype(np.int64) * max(1, len(self.selected)) + place[real])
        dense = np.clip((_shares(data, offsets, again) - self.center) / self.scale, -8, 8)
        return pair // max(1, len(self.selected)), pair % max(1, len(self.selected)), dense

    def score(self, texts: pa.Array) -> pa.Array:
        """list<double> of the categories' probabilities, in order."""
        out = np.zeros((len(texts), len(self.categories)))
        m = len(self.selected)
        for row, data, offsets in pieces(texts):
            n = len(offsets) - 1
            rows, features, dense = self.hits(data, offsets)
            earlier = np.zeros((n, 0))
            for c, w in enumerate(self.weights):
                z = np.bincount(rows, weights=w[features], minlength=n) if m else np.zeros(n)
                z = z + dense @ w[m : m + DENSE] + earlier @ w[m + DENSE : m + DENSE + c] + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                out[row : row + n, c] = p
                earlier = np.concatenate([earlier, p[:, None]], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(self.categories), pa.int32()), pa.array(out.ravel()))


def _count_features(categories: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in categories])
            for row, data, offsets in pieces(batch.column("text")):
                hashes, rows, _ = _tokens(data, offsets)
                order = np.lexsort((rows, hashes))
                hashes, rows = hashes[order], rows[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                hashes, rows = hashes[new], rows[new]
                if len(hashes):
                    names, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    columns = [pa.array(names.view(np.int64)), pa.array(n)] + [pa.array(np.add.reduceat(lab[rows + row].astype(np.int64), first)) for lab in labels]
                    yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", *[f"n_{c}" for c in categories]])

    return count


def _design(model_args: tuple, categories: list[str]):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = ChainModel(*model_args)
        for batch in batches:
            for row, data, offsets in pieces(batch.column("text")):
                n = len(offsets) - 1
                rows, features, dense = probe.hits(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), pa.array(features.astype(np.int32)))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DENSE, pa.int32()), pa.array(dense.ravel()))
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), lists, shares, *[part.column(c) for c in categories]], names=["doc_id", "fold", "features", "dense", *categories])

    return rows_of


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-3, steps: int = 150) -> np.ndarray:
    """L2-regularised logistic regression by accelerated gradient steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    if y.min() == y.max():
        out = np.zeros(x.shape[1])
        out[-1] = 12.0 if y[0] else -12.0
        return out
    rate = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    rate = (0.5 * rate + 0.5 / len(y)).astype(x.dtype)
    y = y.astype(x.dtype)
    probe = np.ones(x.shape[1], x.dtype)
    for _ in range(12):
        probe = (rate * (x @ probe)) @ x
        top = float(np.linalg.norm(probe))
        probe /= top
    step = 1 / (0.25 * top + l2)
    w, at, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at.astype(x.dtype), -30, 30)))
        slope = (rate * (p - y)) @ x + l2 * np.append(at[:-1], 0)
        new, ahead = at - step * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, at, t = new, new + (t - 1) / ahead * (new - w), ahead
    return w


def _bounded(known: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows`` rows: those below a bound of a hash of doc_id, found from counts by steps of the hash; all, if there are no more."""
    step = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 48)
    least, held = 1 << 16, 0
    for r in sorted(known.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.step):  # at most 2^16 rows
        held += r.n
        if held > max_rows:
            least = r.step
            break
    return known.filter(step < least)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS, seed: int = 11) -> ChainModel:
    """Fit the chain on labelled documents.

    ``labels`` has doc_id and a column 0/1 for each category; rows with a null
    label or a null id, and labels without a document, aren't used; an id that is labelled twice counts once. Equal texts are in one
    fold, so that none is judged by a model that learnt it. Without rows all probabilities are 0.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna().dropDuplicates(["doc_id"])
    sample = F.broadcast(_bounded(known, max_rows, seed))  # at most max_rows rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    rows = scratch.keep(texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    schema = "feature long, n long, " + ", ".join(f"n_{c} long" for c in categories)
    counted = rows.select("text", *categories).mapInArrow(_count_features(categories), schema)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    counts = counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in categories]).filter("n >= 3")
    selected: set[int] = set()
    scores = []
    for c in categories:
        share = (totals[c] + 0.5) / (totals.n + 1)
        z = (F.col(f"n_{c}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 0.25)
        scores.append(F.abs(z).alias(f"z_{c}"))
    best = scratch.keep(counts.select("feature", *scores))
    for c in categories:
        selected |= {r.feature for r in best.filter(F.col(f"z_{c}") > 3.5).orderBy(F.desc(f"z_{c}"), "feature").limit(PER_CATEGORY).collect()}
    chosen = np.sort(np.array(sorted(selected), dtype=np.int64).view(U64))
    blank = (categories, chosen, np.zeros(DENSE), np.ones(DENSE), [], 0.5)
    found = rows.mapInArrow(_design(blank, categories), "doc_id long, fold int, features array<int>, dense array<double>, " + ", ".join(f"{c} int" for c in categories))
    got = found.orderBy("doc_id", "fold", "features").toPandas()  # at most max_rows rows of at most PER_CATEGORY features a category
    if not len(got):
        return ChainModel(categories, chosen[:0], np.zeros(DENSE), np.ones(DENSE), [np.append(np.zeros(DENSE + c), -30.0) for c in range(len(categories))], 0.5)
    dense = np.stack(got["dense"].to_numpy())
    center, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    x = np.zeros((len(got), len(chosen) + DENSE), dtype=np.float32)
    for i, f in enumerate(got["features"]):
        x[i, f] = 1
    x[:, len(chosen) :] = np.clip((dense - center) / scale, -8, 8)
    fold = got["fold"].to_numpy()
    weights, limit = [], 0.5
    for c in categories:
        y = got[c].to_numpy().astype(np.float64)
        held = np.zeros(len(y))
        for k in range(FOLDS):
            train = fold != k
            if train.any() and not train.all():
                w = _logistic(x[train], y[train])
                held[~train] = 1 / (1 + np.exp(-np.clip(x[~train] @ w[:-1] + w[-1], -30, 30)))
        w = _logistic(x, y)
        limit = _best_limit(held, y)
        weights.append(w)
        x = np.concatenate([x, held[:, None].astype(np.float32)], axis=1)
    return ChainModel(categories, chosen, center, scale, weights, limit)


def _best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The limit of best F0.5 on held-out predictions, midway in its gap."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not hits[-1]:
        return 1.0
    f = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * hits[-1])
    k = int(np.argmax(f))
    return float((p[order[k]] + p[order[min(k + 1, len(y) - 1)]]) / 2)


def chain_probabilities(model: ChainModel, docs: DataFrame, text: str = "text") -> F.Column:
    """array<double> Column of the categories' probabilities for ``docs``; null texts count as empty, and equal texts get equal probabilities."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        return held.value.score(texts)

    return score(docs[text])


def score_documents(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, a p_<category> for each, rejected (by the last).

    Null texts count as empty. Repeated ids are scored row by row; a label counts once an id. Other
    columns are ignored. An empty table gives no rows.
    """
    model = fit_chain(docs, labels, categories, max_rows)
    scored = docs.select("doc_id", chain_probabilities(model, docs).alias("p"))
    return scored.select("doc_id", *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(categories)], (F.col("p")[len(categories) - 1] > model.limit).alias("rejected"))


def clean_documents(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the chain's last category doesn't reject, with their columns of any name.

    Rows aren't shuffled. Null texts count as empty; repeated rows are judged alike and all
    stay or go; without labels all stay. An empty table gives no rows.
    """
    model = fit_chain(docs, labels, categories, max_rows)
    return docs.filter(chain_probabilities(model, docs)[len(categories) - 1] <= model.limit)
