"""Candidate pools on disk: Parquet by blocks of rows, with a manifest that tells whether all is there as it was written."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import norm
from .items import dequantised, quantised

PRECISIONS = ("int8", "float")
BLOCK = 50_000


def pool_path(root: str, model: str, precision: str = "int8") -> str:
    """The one place that names a pool: by its model and by the precision it has."""
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {PRECISIONS}")
    return f"{root}/pool_{re.sub('[^A-Za-z0-9.]+', '-', model)}_{precision}"


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file, read on executors in pieces of Spark's binary source."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return {r[0].rsplit("/", 2)[-2] + "/" + r[0].rsplit("/", 1)[-1]: r[1] for r in rows.select("path", F.sha2("content", 256).alias("h")).collect()}


def _manifest(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.manifest.json")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def build_pool(words: DataFrame, root: str, model: str, precision: str = "int8") -> str:
    """Writes words (row, word, family, tier1, v) with unit vectors and returns the path; the manifest is written last."""
    spark, path = words.sparkSession, pool_path(root, model, precision)
    d = words.select("row", "word", F.coalesce("family", "word").alias("family"), F.coalesce("tier1", F.lit(False)).alias("tier1"), "v", norm("v").alias("__n"))
    d = d.select("row", "word", "family", "tier1", F.expr("transform(v, x -> x / __n)").alias("v"))
    if precision == "int8":
        d = quantised(d)
    d = d.withColumn("block", (F.col("row") / BLOCK).cast("long"))
    d.repartition("block").sortWithinPartitions("row").write.mode("overwrite").partitionBy("block").parquet(path)
    out = spark.read.parquet(path)
    dim = out.agg(F.max(F.size("q" if precision == "int8" else "v"))).first()[0]
    body = json.dumps({"model": model, "precision": precision, "rows": out.count(), "dim": dim, "files": _files(spark, path)}, indent=1)
    fs, at = _manifest(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    fs, at = _manifest(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"no manifest beside {path}: the pool wasn't built to its end")
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{path}.manifest.json").collect()))


def verify_pool(spark: SparkSession, path: str) -> dict:
    """The manifest, once all files are there with the content they were written with."""
    m = manifest(spark, path)
    have = _files(spark, path)
    wrong = sorted(set(m["files"].items()) ^ set(have.items()))
    if wrong:
        raise ValueError(f"files of {path} aren't as they were written: {sorted({f for f, _ in wrong})}")
    return m


def load_pool(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """row, word, family, tier1, v of rows first..last - 1; whole blocks outside are never opened."""
    d = spark.read.parquet(path)
    if first is not None:
        d = d.where((F.col("block") >= first // BLOCK) & (F.col("row") >= first))
    if last is not None:
        d = d.where((F.col("block") <= max(0, last - 1) // BLOCK) & (F.col("row") < last))
    if "q" in d.columns:
        d = d.withColumn("v", dequantised(F.col("q"), F.col("scale")))
        d = d.withColumn("__n", norm("v")).withColumn("v", F.expr("transform(v, x -> x / __n)"))
    return d.select("row", "word", "family", "tier1", "v")


def pool_rows(pool: DataFrame, rows: DataFrame) -> DataFrame:
    """The pool's rows of these numbers (column row); numbers that it lacks give nothing."""
    return pool.join(rows.select("row").distinct(), "row", "left_semi")


def family_of(words: DataFrame, pool: DataFrame) -> DataFrame:
    """word, family: the pool's family of each word, the word itself if the pool lacks it."""
    known = pool.groupBy("word").agg(F.min("family").alias("__family"))
    return words.select("word").join(known, "word", "left").select("word", F.coalesce("__family", "word").alias("family"))
