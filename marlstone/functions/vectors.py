"""Vector functions as Columns over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and for a zero vector."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))


def rounded(x: Column, places: int) -> Column:
    """A double to so many places, as SQL's engine rounds it: halves go away from zero, and what is rounded to zero keeps its sign."""
    scaled = x * 10.0**places
    even = F.rint(scaled)
    whole = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even) / 10.0**places
    return F.when(F.abs(whole) == float("inf"), x).otherwise(whole)


def mrl_truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` numbers, normalised."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    return l2_normalize(F.slice(v, 1, dim))


def coarse_dim(dim: Column, allowed: Column) -> Column:
    """The smallest allowed dimension of at least an eighth; else the largest; without a list, ``dim``."""
    fits = F.filter(allowed, lambda d: d >= dim / 8)
    return F.when(allowed.isNull() | (F.size(allowed) == 0), dim).otherwise(F.coalesce(F.array_min(fits), F.array_max(allowed)))


#: The embedding models known at the start (slug, dim, dims to cut to, query prefix, passage prefix, family).
EMBEDDING_MODELS = [
    ("ollama:nomic-embed-text", 768, [128, 256, 512, 768], None, None, "nomic"),
    ("intfloat/e5-large-v2", 1024, None, "query: ", "passage: ", "e5"),
    ("openai:text-embedding-3-small", 1536, [256, 512, 768, 1024, 1536], None, None, "openai"),
    ("openai:text-embedding-3-large", 3072, [256, 512, 1024, 2048, 3072], None, None, "openai"),
]
EMBEDDING_MODEL_SCHEMA = "slug string, dim int, mrl_dims array<int>, query_prefix string, passage_prefix string, family string"


def embedding_models(spark, more: list[tuple] = ()):
    """Known models as a table; a later row with the same slug replaces an earlier one."""
    rows = {m[0]: m for m in [*EMBEDDING_MODELS, *more]}
    return spark.createDataFrame(list(rows.values()), EMBEDDING_MODEL_SCHEMA)


def prefixed(text: Column, task: Column, query_prefix: Column, passage_prefix: Column) -> Column:
    """The text behind its model's prefix for the task (query or passage), if it has one."""
    return F.concat(F.coalesce(F.when(task == "query", query_prefix).when(task == "passage", passage_prefix), F.lit("")), text)
