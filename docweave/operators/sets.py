"""Set operations on ids, and unions that keep an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first that the second lacks."""
    return a.subtract(b)


def ordered_union(*lists: Column) -> Column:
    """The values of all lists, each where it comes first."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array()) for x in lists]))


def append_new(there: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """``there`` and those rows of ``more`` whose key it lacks; of rows of ``more`` that share a key the first by ``order``."""
    rest = [c for c in more.columns if c != key]
    one = more.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_first")) if rest else more.distinct()
    fresh = one.join(there, key, "left_anti")
    return there.unionByName(fresh.select(key, "_first.*") if rest else fresh)
