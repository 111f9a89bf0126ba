"""Response tables in, result tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def responses(spark: SparkSession, path: str, columns: list[str], separator: str = "\t") -> DataFrame:
    """Cases by items from delimited text with a header; the schema is stated, so the file is read once. Values that are no whole numbers are NULL."""
    head = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).csv(path)
    return head.select(*[F.expr(f"try_cast(`{c}` AS INT)").alias(c) for c in columns])


def cleaned(cases: DataFrame, low: int = 1, high: int = 5, reverse: tuple[str, ...] = ()) -> DataFrame:
    """Cases whose every value is within low..high, with the reverse-keyed columns turned round."""
    within = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`{c}`").between(low, high), F.lit(False)) for c in cases.columns])
    return cases.where(within).select(*[(F.lit(low + high) - F.col(f"`{c}`") if c in reverse else F.col(f"`{c}`")).alias(c) for c in cases.columns])


def write_result(df: DataFrame, path: str, digits: int | None = None, form: str = "parquet") -> None:
    """A result table as Parquet or as CSV with a header, numbers rounded if digits are given."""
    if form not in ("parquet", "csv"):
        raise ValueError("form must be parquet or csv")
    if digits is not None:
        df = df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if form == "csv" else out.parquet(path)
