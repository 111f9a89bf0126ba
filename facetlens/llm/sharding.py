"""Sharding along a Hilbert curve, so that readers can skip files by several metadata columns.

Source, language and length are quantised to `BITS` bits each, in their order:
by quantiles of the names' first bytes and of the lengths, so that neighbours on
the curve are neighbours in each dimension. Documents are ordered by their cell's index on the Hilbert curve and the order is cut into
runs of near-equal bytes (law `bytes`). Equal texts form a group, which takes
the metadata of its smallest doc_id and stays in one shard; only a group larger
than a whole shard is divided, by a hash of its rows' places. Groups of over
`BIG` of a shard are placed first, in the shard of their place on the curve or
the nearest with room, and the runs are cut to fill what is left.

`write_shards` writes the shards as files with an index of each file's ranges,
and `read_shards` opens only files whose ranges a filter meets.

Defined results: a null text has size 1 and crc32 0 as an empty one has, but is
a group of its own; null sources,
languages and ids have a cell and an order of their own; repeated rows are
rows; an empty table gives an empty result; further columns are ignored by
`shard_plan` and kept by `shard`, which replaces any named shard, slot or hilbert.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, parallel, prepare, spread, written

SHARDS = 16
BITS = 6
#: Share of a shard from which a group is placed first; so there are at most SHARDS / BIG such groups.
BIG = 0.05
#: Cells that the curve is divided into to find where large groups belong.
COARSE = 4096


def hilbert_index(dims: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows of dims, each below 2**bits), by Skilling's transform to transposed form."""
    x = dims.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def name_code(c: str) -> Column:
    """The first seven bytes of a name as a number that sorts as they do; NULL for NULL."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def cuts_of(rows: DataFrame) -> list[np.ndarray]:
    """Quantiles of the codes of source and language and of the size, 2**BITS - 2 at most of each: the bounds of their cells."""
    n = (1 << BITS) - 1
    at = F.array(*[F.lit(k / n) for k in range(1, n)])
    got = rows.agg(*[F.percentile_approx(c, at, 1000) for c in (name_code("source"), name_code("lang"), F.col("__size"))]).first()
    return [np.unique(np.array(x or [], np.int64)) for x in got]


def curve_of(cuts: list[np.ndarray]):
    """Index on the curve of codes of source and language (NULL: a cell of its own) and size in bytes. Cells are spread over the whole of each dimension, however few there are."""

    @F.pandas_udf(T.LongType())
    def curve(source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.Series:
        cells = []
        for x, at in zip((source, lang, size), cuts, strict=True):
            cell = np.where(x.isna(), 0, 1 + np.searchsorted(at, x.fillna(0).to_numpy(np.int64), side="left"))
            cells.append((cell << BITS) // (len(at) + 2))
        return pd.Series(hilbert_index(np.column_stack(cells)))

    return curve


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __k1 and __k2 (128 bits of the text), __size and __crc."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.lit(1))
    return docs.withColumns({"__k1": F.xxhash64(text, empty), "__k2": F.xxhash64(F.lit(91), text), "__size": (F.octet_length(text) + 1).cast("long"), "__crc": F.crc32(text.cast("binary"))})


def numbered(df: DataFrame, order: list[str], amount: str | None, per: str | None, name: str) -> DataFrame:
    """df in total order with __before: the sum of `amount` (or the number) of all earlier rows, counted anew for each value of `per`.

    A range partitioning sorts; each partition counts for itself and the partitions' totals, a few numbers for each,
    give the offsets. `per`, where given, leads the order, so that a partition holds few of its values."""
    spark = df.sparkSession
    prepare(spark)
    schema = df.schema
    at_amount = df.columns.index(amount) if amount else None
    at_per = df.columns.index(per) if per else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        done: dict = {}
        for b in batches:
            v = np.ones(b.num_rows, np.int64) if at_amount is None else b.column(at_amount).to_numpy(zero_copy_only=False).astype(np.int64)
            g = np.zeros(b.num_rows, np.int64) if at_per is None else b.column(at_per).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(v) - v
            out = np.zeros(b.num_rows, np.int64)
            for k in np.unique(g):
                own = np.flatnonzero(g == k)
                out[own] = run[own] - run[own[0]] + done.get(k, 0)
                done[k] = int(out[own[-1]] + v[own[-1]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array(np.full(b.num_rows, pid, np.int32))], [*b.schema.names, "__in", "__pid"])

    full = T.StructType([*schema.fields, T.StructField("__in", T.LongType()), T.StructField("__pid", T.IntegerType())])
    parts = written(df.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order).mapInArrow(count, full), name)
    group = F.col(per) if per else F.lit(0)
    ends = parts.groupBy("__pid", group.cast("int").alias("__g")).agg((F.sum(F.col(amount) if amount else F.lit(1))).alias("n")).toPandas()
    ends = ends.sort_values(["__g", "__pid"])
    ends["__off"] = ends.groupby("__g")["n"].cumsum() - ends["n"]
    if not len(ends):
        return parts.withColumn("__before", F.col("__in")).drop("__in", "__pid")
    off = F.broadcast(spark.createDataFrame(ends[["__pid", "__g", "__off"]].astype(np.int64), "__opid long, __og long, __off long"))
    return parts.join(off, (F.col("__pid") == F.col("__opid")) & (group == F.col("__og"))).withColumn("__before", F.col("__in") + F.col("__off")).drop("__in", "__pid", "__opid", "__og", "__off")


def placed(big: list[tuple], cells: np.ndarray, total: int, shards: int) -> tuple[dict, np.ndarray]:
    """Shares of shards for each big group, as {(k1, k2): [(shard, part), ...]}, and the room left in each shard. big: (k1, k2, cell, bytes)."""
    room = np.full(shards, total / shards)
    start = np.cumsum(cells) - cells
    out = {}
    for k1, k2, cell, size in sorted(big, key=lambda g: (-g[3], g[0], g[1])):
        home = min(shards - 1, int(start[cell] * shards // max(1, total)))
        near = sorted(range(shards), key=lambda s: (abs(s - home), s))
        fits = next((s for s in near if room[s] >= size), None)
        if fits is None and size <= total / shards:
            fits = int(room.argmax())
        if fits is not None:
            out[k1, k2] = [(fits, 1.0)]
            room[fits] -= size
            continue
        parts, left = [], float(size)
        for s in sorted(range(shards), key=lambda s: -room[s]):
            take = min(left, max(0.0, room[s]))
            if take > 0:
                parts.append((s, take / size))
                room[s] -= take
                left -= take
        out[k1, k2] = parts
    return out, np.maximum(room, 0)


def shard_groups(rows: DataFrame, shards: int) -> tuple[DataFrame, dict]:
    """(__g1, __g2, __curve, __shard) of each small group, and where the big ones go. rows: keyed, with doc_id, source and lang."""
    prepare(rows.sparkSession)
    curve = curve_of(cuts_of(rows))
    head = F.min(F.struct(F.col("doc_id"), name_code("source").alias("s"), name_code("lang").alias("l"), F.col("__size").alias("z"))).alias("h")
    groups = rows.groupBy(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2")).agg(head, F.sum("__size").alias("__bytes"))
    groups = written(groups.withColumn("__curve", curve(F.col("h.s"), F.col("h.l"), F.col("h.z"))).drop("h"), "shard-groups")
    total = int(groups.agg(F.sum("__bytes")).first()[0] or 0)
    limit = BIG * total / shards
    cell = (F.col("__curve") / F.lit((1 << 3 * BITS) // COARSE)).cast("int")
    cells = np.zeros(COARSE, np.int64)
    for c, n in groups.groupBy(cell).agg(F.sum("__bytes")).collect():  # COARSE rows at most
        cells[c] = n
    big = [tuple(r) for r in groups.where(F.col("__bytes") >= limit).select("__g1", "__g2", cell, "__bytes").collect()] if total else []  # shards / BIG rows at most
    where, room = placed(big, cells, total, shards)
    cuts = np.cumsum(room)
    small = numbered(groups.where(F.col("__bytes") < limit), ["__curve", "__g1", "__g2"], "__bytes", None, "shard-order")
    middle = F.col("__before") + F.col("__bytes") / 2
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (middle >= F.lit(float(c))).cast("int")
    small = small.select("__g1", "__g2", "__curve", shard.cast("int").alias("__shard"))
    return small, {"where": where, "groups": groups.where(F.col("__bytes") >= limit).select("__g1", "__g2", "__curve")}


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """rows with __curve and __shard."""
    narrow = only(rows, "doc_id", "source", "lang", "__k1", "__k2", "__size")
    # the place in the scan, which is the same whenever a task runs again: rows of one id, or of none, are spread too
    place = F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id())
    rows = rows.withColumn("__lot", F.pmod(place, F.lit(1 << 20)) / F.lit(float(1 << 20)))
    small, big = shard_groups(narrow, shards)
    spark = rows.sparkSession
    spec = [(k1, k2, int(s), float(lo), float(hi)) for (k1, k2), parts in big["where"].items() for (s, _), lo, hi in zip(parts, np.cumsum([0] + [p for _, p in parts[:-1]]), [*np.cumsum([p for _, p in parts[:-1]]), 2.0], strict=True)]
    few = spark.createDataFrame(spec, "__b1 long, __b2 long, __shard int, __low double, __high double")
    few = few.join(big["groups"], (F.col("__b1") == F.col("__g1")) & (F.col("__b2") == F.col("__g2"))).drop("__b1", "__b2")
    both = small.withColumns({"__low": F.lit(0.0), "__high": F.lit(2.0)}).unionByName(few)
    on = (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")) & (F.col("__lot") >= F.col("__low")) & (F.col("__lot") < F.col("__high"))
    return rows.join(both, on).drop("__g1", "__g2", "__low", "__high", "__lot")


def slotted(rows: DataFrame) -> DataFrame:
    """Adds slot: the place in the shard, in the order of the curve, then of the group, then of doc_id."""
    return numbered(rows, ["__shard", "__curve", "__k1", "__k2", "doc_id"], None, "__shard", "shard-slots").withColumnRenamed("__before", "__slot")


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of docs; texts aren't moved."""
    rows = written(keyed(only(docs, "doc_id", "source", "lang", "text")).drop("text"), "shard-rows")
    out = slotted(assigned(rows, shards))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__curve").alias("hilbert"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs in shard order with shard, slot and hilbert; each partition written holds one run of the curve."""
    out = slotted(assigned(keyed(docs), shards))
    own = [c for c in docs.columns if c not in ("shard", "slot", "hilbert")]
    return out.select(*[F.col(f"`{c}`") for c in own], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.col("__curve").alias("hilbert"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes docs as Parquet by shard, in the order of slots, and beside it an index of the files: file, shard, n_rows, and the ranges of source, lang, size (bytes of the text, plus 1) and hilbert. Returns the index."""
    spark = docs.sparkSession
    out = shard(docs, shards).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data")
    ranges = [f(c).alias(f"{name}_{c}") for c in ("source", "lang", "size", "hilbert") for f, name in ((F.min, "min"), (F.max, "max"))]
    nulls = [(F.count("*") - F.count(c)).alias(f"null_{c}") for c in ("source", "lang")]
    files = spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_path").alias("file"), "shard").agg(F.count("*").alias("n_rows"), *ranges, *nulls)
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def meeting_files(index: DataFrame, source: str | None = None, lang: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The files that can hold rows of that source and language, of least to most bytes."""
    for c, x in (("source", source), ("lang", lang)):
        if x is not None:
            index = index.where((F.col(f"min_{c}") <= x) & (F.col(f"max_{c}") >= x))
    if least is not None:
        index = index.where(F.col("max_size") >= least)
    return index.where(F.col("min_size") <= most) if most is not None else index


def read_shards(spark: SparkSession, path: str, source: str | None = None, lang: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The rows that meet the filter; files whose ranges don't are never opened. The driver reads the names of the others, one for each file."""
    files = [r[0] for r in meeting_files(spark.read.parquet(f"{path}/index"), source, lang, least, most).select("file").orderBy("file").collect()]
    data = spark.read.option("basePath", f"{path}/data").schema(spark.read.parquet(f"{path}/data").schema)
    df = data.parquet(*files) if files else data.parquet(f"{path}/data").limit(0)
    for c, x in (("source", source), ("lang", lang)):
        df = df.where(F.col(c) == x) if x is not None else df
    df = df.where(F.col("size") >= least) if least is not None else df
    return df.where(F.col("size") <= most) if most is not None else df
