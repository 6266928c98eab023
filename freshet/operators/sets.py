"""Set operations (inventory I1 to I4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(tagged: Sequence[tuple[str, DataFrame]], tag: str = "source") -> DataFrame:
    """Union by name with a source column; absent columns become null."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in tagged]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union by name, equal rows once."""
    return reduce(DataFrame.unionByName, frames).distinct()


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both."""
    return a.select(*keys).intersect(b.select(*keys))


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I4: expected keys that are absent."""
    return expected.select(*keys).subtract(present.select(*keys))
