"""Item-pair similarities under four encodings.

Items belong to blocks of `BLOCK` numbers, and blocks to one of `BANDS` bands.
Each pair of bands is dealt to one task and sorted there, and each pair of its
blocks is one matrix product in a Python worker. So no side is broadcast, each
item is sent `BANDS` times however many items there are, a worker holds two
bands and a threshold is applied before pairs leave the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

ENCODINGS = ("atomic", "keyed", "squid", "pearson")
BLOCK = 512
BANDS = 16


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows of zeros, or with values that aren't finite, stay zero."""
    n = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(n) & (n > 0)
    return np.where(ok[:, None], m / np.where(ok, n, 1.0)[:, None], 0.0)


def encode(m: np.ndarray, encoding: str, scoring: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """Unit rows whose products are the similarities."""
    if encoding == "keyed":
        m = m * scoring[:, None]
    elif encoding == "squid":
        m = m - (m.mean(axis=0) if mean is None else mean)
    elif encoding == "pearson":
        m = m - m.mean(axis=1, keepdims=True)
    elif encoding != "atomic":
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    return unit(m)


def column_means(items: DataFrame) -> np.ndarray:
    """One number for each dimension."""
    rows = items.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x")).collect()
    return np.array([x for _, x in sorted(map(tuple, rows))])


def blocked(items: DataFrame, columns: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """b, rows: the items by blocks of their numbers, each with the given columns."""
    return items.groupBy((F.col("ord") / block).cast("long").alias("b")).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def numbers(items: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """The numbers of the items' blocks."""
    return items.select((F.col("ord") / block).cast("long").alias(name)).distinct()


class Side:
    """A block of items in a worker: numbers, other columns, and a matrix of unit rows for each encoding, in order of the numbers."""

    def __init__(self, rows: pa.Table, encodings: tuple[str, ...], mean: np.ndarray | None):
        m, scoring = batch_matrix(rows.column("v")), rows.column("scoring").to_numpy().astype(float)
        self.rows, self.ord = rows, rows.column("ord").to_numpy()
        self.units = [encode(m, e, scoring, mean) for e in encodings]

    def column(self, name: str) -> list:
        return self.rows.column(name).to_pylist()


#: What a worker makes of two sides, their products by encoding, and which cells of these are pairs.
Emit = Callable[[Side, Side, list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of the key, which they are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        ends = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            if a == z:
                continue
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def block_products(items: DataFrame, encodings: tuple[str, ...], emit: Emit, schema: str, more: tuple[str, ...] = (), block: int = BLOCK, bands: int = BANDS) -> DataFrame:
    """What emit yields of each pair of blocks: the sides, with the columns `more`, and one matrix product for each encoding."""
    for e in encodings:
        if e not in ENCODINGS:
            raise ValueError(f"encoding must be one of {ENCODINGS}")
    ship(items.sparkSession)
    mean = column_means(items) if "squid" in encodings else None
    columns = list(dict.fromkeys(("ord", "scoring", "v", *more)))
    own = F.pmod((F.col("ord") / block).cast("long"), F.lit(bands)).cast("int")
    # a pair of bands is the lower one times their number, plus the other
    pairs = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda other: F.least(own, other) * bands + F.greatest(own, other))
    work = items.select(*columns, F.explode(pairs).alias("__pair")).repartition("__pair").sortWithinPartitions("__pair", "ord")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "__pair"):
            low, high = divmod(rows.column("__pair")[0].as_py(), bands)
            b = (rows.column("ord").to_numpy() / block).astype(np.int64)
            ends = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            sides = [(int(b[a]) % bands, Side(rows.slice(a, z - a), encodings, mean)) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            for k, (of, x) in enumerate(sides):
                for other, y in sides[k:]:
                    if (of == other) == (low == high):
                        s = [u @ w.T for u, w in zip(x.units, y.units, strict=True)]
                        cells = np.ones((len(x.ord), len(y.ord)), bool)
                        yield from emit(x, y, s, np.triu(cells, 1) if x is y else cells)

    return work.mapInArrow(multiply, schema)


def similarity_pairs(items: DataFrame, encoding: str = "atomic", threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """i, j, sim of pairs with i < j; with a threshold only those of at least that absolute similarity."""

    def over(x: Side, y: Side, products: list[np.ndarray], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = products[0]
        p, q = np.nonzero(cells if threshold is None else cells & (np.abs(s) >= threshold))
        for k in range(0, len(p), 100_000):
            a, z = p[k : k + 100_000], q[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"i": x.ord[a], "j": y.ord[z], "sim": s[a, z]})

    return block_products(items, (encoding,), over, "i long, j long, sim double", block=block)


def nearest(queries: DataFrame, items: DataFrame, others: bool = False, block: int = BLOCK) -> DataFrame:
    """ord, nearest, nearest_sim: the item (ord, v) of the highest cosine to each query (ord, v), the first of those equal to 12 decimals; with `others` not the one of the query's own number.

    Every block of queries meets every block of items in a matrix product, and one row a query and block leaves the worker."""
    ship(items.sparkSession)
    asked = blocked(queries, ("ord", "v"), block).select(F.col("rows").alias("asked"))
    work = asked.crossJoin(numbers(items, "b", block)).join(blocked(items, ("ord", "v"), block), "b").select("asked", "rows")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                two = sorted(two, key=lambda r: r["ord"])
                (i, x), (j, y) = ((np.array([r["ord"] for r in rows], np.int64), unit(np.array([r["v"] for r in rows], float))) for rows in (one, two))
                s = np.round(x @ y.T, 12)
                if others:
                    s[i[:, None] == j] = -np.inf
                at = s.argmax(axis=1)
                top = s[np.arange(len(i)), at]
                ok = np.isfinite(top)
                yield pa.RecordBatch.from_pydict({"ord": i[ok], "nearest": j[at][ok], "s": top[ok]})

    found = work.mapInArrow(best, "ord long, nearest long, s double")
    top = found.groupBy("ord").agg(F.max(F.struct("s", (-F.col("nearest")).alias("m"))).alias("t"))
    return top.select("ord", (-F.col("t.m")).alias("nearest"), F.col("t.s").alias("nearest_sim"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def matrix(items: DataFrame, limit: int = 5000) -> tuple[np.ndarray, list]:
    """Vectors and rows of an item set on the driver, for the dense kernels; item sets are small by nature and this checks it."""
    rows = items.orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} items: dense kernels need J x J memory")
    return np.array([r["v"] for r in rows], float), rows


def batch_matrix(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as a matrix."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    wide = set(v.value_lengths().unique().to_pylist())
    if len(wide) > 1 or None in wide:
        raise ValueError("the items' vectors must be of one length")
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), float).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def vectors(items: DataFrame) -> tuple[np.ndarray, pa.Table]:
    """Vectors, and ord and code, of an item set on the driver in order of ord, for kernels that need no matrix of items by items."""
    t = items.select("ord", "code", "v").orderBy("ord").toArrow()
    return batch_matrix(t.column("v")), t.drop_columns("v")


def size_of(items: DataFrame) -> tuple[int, int]:
    """How many items, and of how many dimensions."""
    j, low, high = items.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not j or low < 0 or low != high:
        raise ValueError("the items' vectors must be of one length" if j else "there are no items")
    return j, low


def signed_nli(texts: DataFrame, classifier) -> DataFrame:
    """i, j, sim: entailment minus contradiction of all ordered pairs, both directions averaged. texts: ord, text.

    classifier(premises, hypotheses) gives columns of a DataFrame; it is a Column pair for rules, or wraps a model in a pandas UDF."""
    a = texts.select(F.col("ord").alias("i"), F.col("text").alias("premise"))
    b = texts.select(F.col("ord").alias("j"), F.col("text").alias("hypothesis"))
    scored = a.join(b, F.col("i") != F.col("j"))
    entailment, contradiction = classifier(F.col("premise"), F.col("hypothesis"))
    return scored.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg(entailment - contradiction).alias("sim"))
