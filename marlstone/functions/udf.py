"""Pandas UDFs that can be declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_udf(kind: str) -> Callable:
    """Like ``pandas_udf(kind)``; the type is read at the first use."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
