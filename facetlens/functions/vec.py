"""Vectors as ARRAY<DOUBLE>: Column expressions that stay in the JVM.

A norm is never divided into an array elementwise: Catalyst would work it out
again for every element. Dot products are divided by norms instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """1 for a vector of zeros, so that it stays zero when divided."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, n).otherwise(F.lit(1.0))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with -0 as 0."""
    return F.round(c, digits) + F.lit(0.0)


def vector_of(pos: str = "pos", x: str = "x") -> Column:
    """Aggregate: the vector of (pos, x) rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct(pos, x))), lambda s: s[x])


def long_form(df: DataFrame, *keys: str, unit: bool = True) -> DataFrame:
    """(keys, pos, x) of the column v, of unit length or as it is."""
    d = df.select(*keys, norm("v").alias("__n"), F.posexplode("v").alias("pos", "x"))
    return d.select(*keys, "pos", (F.col("x") / F.col("__n") if unit else F.col("x")).alias("x"))


def vector_sum(df: DataFrame, key: str, unit: bool = True) -> DataFrame:
    """key, n and s: the sum of the group's vectors. Partial sums by position combine before the shuffle, whatever the group's size."""
    sums = long_form(df, key, unit=unit).groupBy(key, "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), vector_of().alias("s"))
