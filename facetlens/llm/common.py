"""What the operators of this subpackage share: input columns, working tables in the shared folder, words."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import shared_dir, ship


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they start, on machines that haven't got it too."""
    ship(spark)


#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers by bytes, not only by number: 10,000 texts at once take tens of MB
    outside the heap, and buffers of that size stay with the executor when they are freed. A smaller bound of the session's own stays."""
    if _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as 64MB."""
    m = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


#: Folders that operators of this process have made.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark)}/facetlens-{name}-{uuid.uuid4().hex[:12]}")
    return _paths[-1]


def clean_up(spark: SparkSession) -> int:
    """Removes the working tables and side files of all operators run so far; their results must have been written by then. Returns how many there were."""
    n = len(_paths)
    while _paths:
        drop_path(spark, _paths.pop())
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so lost executors cost one task again and no more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table made by written() once nothing reads it any more."""
    files = df.inputFiles()
    for path in {f.rsplit("/", 1)[0] for f in files}:
        if "/facetlens-" in path:
            drop_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no others, so that extra columns can't clash with the ones an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def parallel(spark: SparkSession, at_least: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table of fewer files than cores, as small tables are; larger ones keep their splits and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < min(cores, 4) else df


def ascii_words(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of the text, as UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: A-Z to a-z, nothing else, for UTF-8.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after LOWER: digits, a-z and all beyond ASCII stay; the rest separates.
ALNUM = bytes(LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []
