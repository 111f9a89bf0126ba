"""Similarity of texts by natural-language inference: entailment less contradiction, with a classifier that is a function of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship


def label_positions(labels: list[str] | None) -> dict[str, int]:
    """Where a classifier's output has contradiction and entailment; exactly one label must name each. Without labels the usual order holds: contradiction, entailment, neutral."""
    if labels is None:
        return {"contradiction": 0, "entailment": 1}
    out = {}
    for name in ("contradiction", "entailment"):
        at = [k for k, x in enumerate(labels) if name in x.lower()]
        if len(at) != 1:
            raise ValueError(f"labels {labels} must have exactly one {name}")
        out[name] = at[0]
    return out


def checked(out, n: int) -> np.ndarray:
    """Entailment less contradiction of a classifier's columns, which must be there, numeric, finite and of n rows."""
    for name in ("entailment", "contradiction"):
        if name not in out:
            raise ValueError(f"the classifier gave no column {name!r}")
        if len(out[name]) != n:
            raise ValueError(f"the classifier gave {len(out[name])} rows for {n} pairs")
    try:
        signed = np.asarray(out["entailment"], float) - np.asarray(out["contradiction"], float)
    except (TypeError, ValueError) as e:
        raise ValueError("the classifier's columns aren't numeric") from e
    if not np.isfinite(signed).all():
        raise ValueError("the classifier gave values that aren't finite")
    return signed


def nli_pairs(texts: DataFrame, classifier: Callable[[list[str], list[str]], dict], symmetric: bool = True) -> DataFrame:
    """i, j, sim: of pairs i < j the mean of both directions, or of all ordered pairs. texts: ord, text.

    classifier(premises, hypotheses) gives columns entailment and contradiction; it runs in batches on executors, and
    pairs are as many as the square of the texts, as the measure asks."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(checked(classifier(a.tolist(), b.tolist()), len(a)))

    ship(texts.sparkSession)
    a = texts.select(F.col("ord").alias("i"), F.col("text").alias("premise"))
    b = texts.select(F.col("ord").alias("j"), F.col("text").alias("hypothesis"))
    scored = a.join(b, F.col("i") != F.col("j")).select("i", "j", run("premise", "hypothesis").alias("sim"))
    if not symmetric:
        return scored
    return scored.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("sim").alias("sim"))
