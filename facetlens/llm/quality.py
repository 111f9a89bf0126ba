"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays.

`document_stats` works out the statistics of one text, `fit` boosts trees on a
bounded sample of labelled documents and `FlatTrees` scores whole batches with
numpy indexing. Features named in `DECREASING` may only lower the score of good
quality as they grow (monotonic constraints).

Defined results: a null or empty text has no words and fails the base rule; a
null label is no label; documents labelled twice count twice; without labels
of both classes no trees are grown and the base rule alone decides; an empty
table gives an empty result; further columns are ignored by `quality_scores`
and kept by `quality_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, only, prepare, spread, written

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words"]
DECREASING = ("symbols", "dup_lines", "repeats")
#: Labelled rows that a fit uses at most; more labels than this hardly move ten features.
MAX_LABELLED = 20_000


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key = ids[:n].copy()
    for k in range(1, width):  # dense again after each word, so that keys can't overflow
        key = np.unique(key, return_inverse=True)[1] if k > 1 else key
        key = key * len(seen) + ids[k : n + k]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: Classes of ASCII bytes; code points beyond ASCII are letters here.
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def document_stats(text: str | None) -> tuple[int, ...]:
    """The numbers named in STATS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen, dup = [x for x in raw.split(b"\n") if x.split()], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    spaces = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    gone = lambda kind: len(raw) - len(raw.translate(None, kind))
    return (len(words), len(text) - spaces, gone(SYMBOLS.encode()), dup, repeated_words(words), len(lines), gone(UPPER), gone(DIGITS), gone(MARKS), len(set(words)))


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES of rows of STATS."""
    s = dict(zip(STATS, np.asarray(stats, float).T, strict=True))
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_distinct"] / words, s["n_words"] / lines])


def base_failed(stats: np.ndarray, min_words: int = 50, max_repeat: int = 50) -> np.ndarray:
    n, repeat = stats[:, 0], stats[:, 4]
    return (n < min_words) | (100 * repeat > max_repeat * n)


@dataclass
class FlatTrees:
    """Trees as arrays of nodes: a leaf has feature -1; roots holds each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                below = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(f < 0, at, np.where(below, self.left[at], self.right[at]))
            out += self.value[at]
        return out


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 20) -> FlatTrees:
    """Boosts histogram trees for the logistic loss. signs: -1 where the score may only fall with the feature, 1 rise, 0 free."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def new() -> int:
        for k, v in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            nodes[k].append(v)
        return len(nodes["feature"]) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        roots.append(new())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            leaf = float(np.clip(grad[rows].sum() / (hess[rows].sum() + l2), low, high))
            nodes["value"][at] = rate * leaf
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    g, h, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                    lg, lh = g / (h + l2), (grad[rows].sum() - g) / (hess[rows].sum() - h + l2)
                    gain = g * lg + (grad[rows].sum() - g) * lh - grad[rows].sum() ** 2 / (hess[rows].sum() + l2)
                    ok = (n >= least) & (len(rows) - n >= least)
                    if signs[j]:
                        ok &= (lh - lg) * signs[j] >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, np.clip(lg[k], low, high), np.clip(lh[k], low, high)))
            if best[1] is None:
                score[rows] += rate * leaf
                continue
            j, k, lv, rv = best[1]
            nodes["feature"][at], nodes["cut"][at] = j, float(cuts[j][k])
            nodes["left"][at], nodes["right"][at] = left, right = new(), new()
            go = binned[rows, j] <= k
            mid = (lv + rv) / 2
            bounds = {-1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high)), 0: ((low, high), (low, high))}[int(signs[j])]
            todo += [(left, rows[go], level + 1, *bounds[0]), (right, rows[~go], level + 1, *bounds[1])]
    return FlatTrees(*(np.array(nodes[k]) for k in ("feature", "cut", "left", "right", "value")), np.array(roots), depth, base)


def stats_of(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and STATS for each row of docs."""
    prepare(docs.sparkSession)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document_stats(t) for t in b.column(n).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], [*keys, *STATS])

    df = only(docs, *keys, "text")
    return df.mapInArrow(run, ", ".join([f"{k} {t}" for k, t in df.dtypes[:n]] + [f"{k} long" for k in STATS]))


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> FlatTrees | None:
    """Grows trees on at most max_labelled labelled documents, those of the smallest seeded hash. stats: doc_id and STATS."""
    picked = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    picked = picked.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed))).orderBy("h", "doc_id", "quality").limit(max_labelled).drop("h")
    rows = stats.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", *STATS).toPandas().sort_values(["doc_id", "quality", *STATS])
    y = rows["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    signs = np.array([-1 if f in DECREASING else 0 for f in FEATURES])
    return grow(features(rows[STATS].to_numpy()), y, signs)


def verdict(stats: np.ndarray, trees: FlatTrees | None, threshold: float = 0.5) -> np.ndarray:
    """True where a document passes the base rule and the trees give good quality at least the threshold."""
    ok = ~base_failed(stats)
    return ok & (trees.raw(features(stats)) >= np.log(threshold / (1 - threshold))) if trees else ok


def kept_column(trees: FlatTrees | None, stats: list[Column]) -> Column:
    @F.pandas_udf("boolean")
    def kept(*cols: pd.Series) -> pd.Series:
        return pd.Series(verdict(np.column_stack([c.to_numpy(np.int64) for c in cols]), trees))

    return kept(*stats)


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, STATS, base_failed, kept for every row of docs. The statistics are written once and both fitted on and scored."""
    stats = written(stats_of(spread(docs), "doc_id"), "stats")
    trees = fit(stats, labels, max_labelled)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": kept_column(trees, [F.col(k) for k in STATS])})


def quality_filter(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that pass, with all their columns; texts are read once more to fit, on labelled rows alone."""
    ids = only(labels, "doc_id").where("doc_id is not null").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(7))).orderBy("h", "doc_id").limit(max_labelled)
    trees = fit(stats_of(docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id"), labels, max_labelled)
    prepare(docs.sparkSession)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series(verdict(np.array([document_stats(t) for t in texts], np.int64).reshape(-1, len(STATS)), trees), dtype=bool)

    return docs.where(passes(F.col("text")))
