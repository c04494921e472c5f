"""Arrow-batched functions whose result type is spelled out; the type is read when the function is first used in a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(ddl: str) -> Callable:
    """A function of pandas series as one of columns."""

    def decorate(function: Callable) -> Callable[..., Column]:
        made = cache(lambda: F.pandas_udf(function, ddl))

        @wraps(function)
        def call(*columns):
            return made()(*columns)

        return call

    return decorate
