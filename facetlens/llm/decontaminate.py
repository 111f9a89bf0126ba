"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Each item gives patterns: its windows of `width` consecutive words, or all its
words if it has fewer. Patterns of one length form a table. A shift table over
blocks of two words (of one for one-word patterns) tells how far the scan may
jump; where it may not jump, the block's bucket holds the patterns that end in
it, and direct comparison of words confirms each occurrence.

Items are searched in blocks whose tables have a bounded size (`TABLE_BYTES`):
long items are cut into pieces that overlap, so that each window is in one, and
the driver and every worker hold the tables of one block at a time. Each block
is searched against all rows; the hits of several blocks are united by row.

Defined results: a null or empty text has no words and no hits; items without
words, or with a null id, are left out; items of one id count once; several
items may share a pattern and all count; without items nothing is hit. Further
columns are ignored by `contamination` and kept by `decontaminate`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, only, prepare, spread, written
from .exchange import blocks as numbered_rows

WIDTH = 10
#: Bytes of tables that a worker holds at once, and what a word of an item takes in them.
TABLE_BYTES, WORD_BYTES = 256 << 20, 1000


class Table:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m, self.b = length, min(2, length)
        self.most = length - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, ids in patterns.items():
            for j in range(self.b, length + 1):
                block = p[j - 2 : j] if self.b == 2 else p[j - 1]
                self.shift[block] = min(self.shift.get(block, self.most), length - j)
            self.bucket[block].append((p, tuple(ids)))

    def search(self, words: list[bytes], hits: list[int], items: set[str]) -> None:
        """Adds the starts of occurrences to hits and the ids of the items to items."""
        m, most, shift, bucket, i, n = self.m, self.most, self.shift.get, self.bucket, self.m - 1, len(words)
        two = self.b == 2
        while i < n:
            block = (words[i - 1], words[i]) if two else words[i]
            jump = shift(block, most)
            if jump:
                i += jump
                continue
            found = tuple(words[i - m + 1 : i + 1])
            for p, ids in bucket[block]:
                if p == found:
                    hits.append(i - m + 1)
                    items.update(ids)
            i += 1


class Searcher:
    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for key, text in items:
            words = alnum_words(text)
            n = min(width, len(words))
            if key is not None and n:
                for k in range(len(words) - n + 1):
                    patterns[n][tuple(words[k : k + n])].add(str(key))
        self.tables = [Table(n, p) for n, p in sorted(patterns.items())]

    def find(self, text: str | None) -> tuple[np.ndarray, set[str]]:
        """Which words of the text are hit, and by which items."""
        words = alnum_words(text)
        edge, items = np.zeros(len(words) + 1, np.int32), set()
        for t in self.tables:
            hits: list[int] = []
            t.search(words, hits, items)
            if hits:
                at = np.unique(hits)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + t.m, -1)
        return np.cumsum(edge[:-1]) > 0, items


def pieces(text: str | None, width: int, words: int) -> Iterator[str]:
    """A text's words in pieces of at most `words`, each window of `width` in one of them."""
    own = alnum_words(text)
    step = max(1, words - width + 1)
    for k in range(0, max(1, len(own) - width + 1), step):
        yield b" ".join(own[k : k + step + width - 1]).decode("utf-8", "surrogatepass")


def item_blocks(items: DataFrame, width: int = WIDTH, table_bytes: int = TABLE_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items, in blocks whose tables take about table_bytes. A benchmark is a stated query set: the driver reads it block by block, and each block is searched against all rows."""
    most = max(2 * width, table_bytes // WORD_BYTES)
    block: list = []
    size = 0
    for r in only(items, "item_id", "text").where("item_id is not null and text is not null").dropDuplicates().toLocalIterator():
        for piece in pieces(r[1], width, most):
            n = piece.count(" ") + 1
            if block and size + n > most:
                yield block
                block, size = [], 0
            block.append((r[0], piece))
            size += n
    yield block


_made: dict = {}


def _ready(name: str, block, width: int) -> Searcher:
    """The tables of a block, built once in each Python worker, which drops those of the last block."""
    if name not in _made:
        _made.clear()
        _made[name] = Searcher(block.value, width)
    return _made[name]


FOUND = "n_words long, hits array<int>, items array<string>"


def searched(df: DataFrame, block, width: int, all_rows: bool) -> DataFrame:
    """The columns of df but text, with n_words, the places of hit words and the items that hit them; rows without hits only with all_rows."""
    name = uuid.uuid4().hex
    keys = [c for c in df.columns if c != "text"]
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _ready(name, block, width)
        for b in batches:
            found = [search.find(t) for t in b.column(at).to_pylist()]
            rows = pa.array(np.flatnonzero([all_rows or bool(ids) for _, ids in found]))
            some = [found[k] for k in rows.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in keys), pa.array([len(h) for h, _ in some], pa.int64()), pa.array([np.flatnonzero(h).astype(np.int32) for h, _ in some], pa.list_(pa.int32())), pa.array([sorted(x) for _, x in some], pa.list_(pa.string()))], [*keys, "n_words", "hits", "items"])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes if c != "text"] + [FOUND]))


def with_hits(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, hits, items of every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = item_blocks(items, width)
    first, second = next(blocks), next(blocks, None)
    df = only(spread(docs), "doc_id", "text")
    if second is None:
        return searched(df, spark.sparkContext.broadcast(first), width, True)
    rows = numbered_rows(docs)
    parts = []
    for k, block in enumerate(chain([first, second], blocks)):
        held = spark.sparkContext.broadcast(block)
        parts.append(written(searched(rows, held, width, k == 0), f"hits-{k}"))
        held.destroy()
    more = reduce(DataFrame.unionByName, parts[1:]).select("block", "row", F.explode(F.transform("hits", lambda x: F.struct(x.alias("hit"), F.lit(None).cast("string").alias("item")))).alias("h"))
    more = more.unionByName(reduce(DataFrame.unionByName, parts[1:]).select("block", "row", F.explode(F.transform("items", lambda x: F.struct(F.lit(None).cast("int").alias("hit"), x.alias("item")))).alias("h")))
    more = more.groupBy(F.col("block").alias("b"), F.col("row").alias("r")).agg(F.collect_set("h.hit").alias("h2"), F.collect_set("h.item").alias("i2"))
    none = F.array().cast("array<int>")
    both = parts[0].join(more, (F.col("block") == F.col("b")) & (F.col("row") == F.col("r")), "left")
    return both.select("doc_id", "n_words", F.array_sort(F.array_union("hits", F.coalesce("h2", none))).alias("hits"), F.array_sort(F.array_union("items", F.coalesce("i2", F.array().cast("array<string>")))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted ids) for every row of docs."""
    found = with_hits(docs, items, width)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no pattern occurs, with all their columns; between blocks of items, what is left is written."""
    spark = docs.sparkSession
    prepare(spark)
    held = None
    for block in item_blocks(items, width):
        if held is not None:
            docs = written(docs, "clean")
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        docs = docs.where(_clean(held, width)(F.col("text")))
    return docs


def _clean(block, width: int):
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        search = _ready(name, block, width)
        return pd.Series([not search.find(t)[1] for t in texts], dtype=bool)

    return clean
