"""Item sets: ord, code, item, factor, scoring and v (the embedding)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_from(df: DataFrame, ord: str, embedding: str, code: str | None = None, item: str | None = None, factor: str | None = None, scoring: str | None = None) -> DataFrame:
    """The normal form of an item set. Codes default to item_%02d by order, keying to +1; ord is a column, for ties and first matches follow it."""
    opt = lambda c, default: F.col(c) if c else default
    return df.select(
        F.col(ord).cast("long").alias("ord"),
        opt(code, F.format_string("item_%02d", F.col(ord).cast("long") + 1)).alias("code"),
        opt(item, F.lit(None).cast("string")).alias("item"),
        opt(factor, F.lit(None).cast("string")).cast("string").alias("factor"),
        F.coalesce(opt(scoring, F.lit(1)), F.lit(1)).cast("int").alias("scoring"),
        F.col(embedding).cast("array<double>").alias("v"),
    )


def check_scoring(items: DataFrame) -> None:
    bad = items.where(~F.col("scoring").isin(-1, 1)).count()
    if bad:
        raise ValueError(f"scoring must be 1 or -1; {bad} items have other values")


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as an item set: labels are the theoretical factors and every fifth item is reverse-keyed."""
    e = table(spark, sf_dir, "embeddings")
    e = e.withColumns({"code": F.format_string("v%04d", "vec_id"), "scoring": F.when(F.col("vec_id") % 5 == 0, -1).otherwise(1)})
    return items_from(e, "vec_id", "embedding", code="code", factor="label", scoring="scoring")


def load_npz(spark: SparkSession, path: str, embeddings_key: str = "embeddings", codes_key: str = "codes", items_key: str = "items", factors_key: str = "factors", scoring_key: str = "scoring") -> DataFrame:
    """An item set from an .npz archive; metadata arrays that are missing are skipped."""
    with np.load(path, allow_pickle=False) as z:
        if embeddings_key not in z.files:
            raise KeyError(f"no array {embeddings_key!r} in {path}; there are {sorted(z.files)}")
        m = np.asarray(z[embeddings_key], float)
        more = {name: z[key].tolist() for name, key in (("code", codes_key), ("item", items_key), ("factor", factors_key), ("scoring", scoring_key)) if key in z.files}
    for name, values in more.items():
        if len(values) != len(m):
            raise ValueError(f"{name} has {len(values)} entries for {len(m)} rows")
    kinds = {"code": "string", "item": "string", "factor": "string", "scoring": "int"}
    rows = [(k, v.tolist(), *(int(more[c][k]) if c == "scoring" else str(more[c][k]) for c in more)) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, ", ".join(["ord long", "embedding array<double>", *(f"{c} {kinds[c]}" for c in more)]))
    return items_from(df, "ord", "embedding", **{c: c for c in more})


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One term a line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def quantised(df: DataFrame, v: str = "v") -> DataFrame:
    """A pool's vectors as unit rows in eight bits with one scale for each row."""
    top = F.array_max(F.transform(v, F.abs))
    d = df.withColumn("scale", (top / 127).cast("double"))
    return d.withColumn("q", F.transform(v, lambda x: F.round(x / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).cast("tinyint"))).drop(v)


def dequantised(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)
