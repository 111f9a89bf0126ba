"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact length in each source. A source's target is
filled with whole rounds of all its documents, then with a proportional share
of each length, then a bounded-knapsack dynamic program over the lengths finds
the counts that come nearest to what is left. Of budgets over `FINE` words the
longest documents first take what is beyond FINE, as the program's table has a
bit for each word: the sum is then the nearest that contains those, which is the
budget itself wherever the documents left over can make up the last FINE words. Which documents of a length are
taken is decided by a seeded hash of their ids.

Defined results: a null or empty text has size 0 and takes no words; a null
source is a source of its own, last in order; a source without words has
target 0; rows repeated with one doc_id are documents of their own; an empty
table gives an empty result; further columns are ignored by `mix_plan` and
kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, prepare, spread, written

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
CAP = 2.0
#: Buckets of the seeded hash within one source and length. Only the bucket where the count runs out is ranked row by row.
BUCKETS = 4096
#: Words of a source's budget that are left to the dynamic program, and the length of one document more at most.
FINE = 1 << 16


def targets(sizes: np.ndarray, weights: np.ndarray, budget: float, cap: float = CAP) -> np.ndarray:
    """Shares of the budget by weight, each at most cap times its size; what is over is shared again by weight among the rest."""
    out = np.zeros(len(sizes))
    full = cap * sizes.astype(float)
    free = sizes > 0
    left = float(budget)
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > full)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = full[over]
        left -= full[over].sum()
        free &= ~over
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(rounds, extra): take all documents `rounds` times and `extra[k]` documents of lengths[k] once more, so that the sum comes nearest to target."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if not total or target <= 0:
        return 0, extra
    rounds = int(target // total)
    left = int(round(target - rounds * total))
    extra = np.floor(counts * (left / total)).astype(np.int64)
    rest = left - int((lengths * extra).sum())
    if rest < 0:  # by rounding of very large counts only
        extra[:] = 0
        rest = left
    for k in np.argsort(-lengths, kind="stable"):  # the longest first, down to a budget that the dynamic program fits exactly
        more = min(int(counts[k] - extra[k]), max(0, rest - FINE) // int(lengths[k])) if lengths[k] else 0
        extra[k] += more
        rest -= more * int(lengths[k])
    return rounds, extra + knapsack(lengths, counts - extra, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts of each length, at most those given, whose sum comes nearest to budget, above or below.

    Reachable sums are bits of one integer for each length, doubled by binary splitting of the counts. Sums beyond
    twice the budget are farther from it than the empty one, so that many bits suffice."""
    out = np.zeros(len(lengths), np.int64)
    usable = [k for k in range(len(lengths)) if lengths[k] > 0 and counts[k] > 0]
    if budget <= 0 or not usable:
        return out
    top = 2 * budget
    mask = (1 << (top + 1)) - 1
    steps, reach = [], 1
    for k in sorted(usable, key=lambda k: -lengths[k]):
        if lengths[k] > top:
            continue
        left, part = min(int(counts[k]), top // int(lengths[k])), 1
        while left > 0:
            take = min(part, left)
            steps.append((k, take, reach))
            reach |= (reach << (take * int(lengths[k]))) & mask
            left -= take
            part *= 2
        if reach >> budget & 1:
            break
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    high = reach >> budget
    at = low if not high or budget - low <= (high & -high).bit_length() - 1 else budget + (high & -high).bit_length() - 1
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * int(lengths[k])
            out[k] += take
    return out


def with_size(docs: DataFrame) -> DataFrame:
    """Adds __size: the number of words, counted by the JVM."""
    return docs.withColumn("__size", F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long"))


def plan_of(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, size, rounds, extra, source_size, target. Reads sources and their totals to the driver: one row for each source."""
    spark = sized.sparkSession
    prepare(spark)
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    per = [(r[0], int(r[1] or 0)) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    per.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = np.array([n for _, n in per], np.int64)
    share = np.array([weights[k % len(weights)] for k in range(len(per))], float)
    goal = targets(sizes, share, budget * float(sizes.sum()), cap)
    known = {s: (int(n), float(t)) for (s, n), t in zip(per, goal, strict=True)}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        source = None if pd.isna(source) else source
        pdf = pdf.sort_values("size")
        total, target = known[source]
        rounds, extra = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), target)
        return pd.DataFrame({"source": source, "size": pdf["size"], "rounds": rounds, "extra": extra, "source_size": total, "target": target})

    schema = "source string, size long, rounds long, extra long, source_size long, target double"
    return counts.groupBy("source").applyInPandas(fitted, schema)


def multiplied(sized: DataFrame, seed: int, **settings) -> DataFrame:
    """sized (with source, size and a key column) with times, source_size and target; each shuffle moves ids and counts only."""
    plan = written(plan_of(sized, **settings), "mix-plan")
    ranked = sized.withColumn("h", F.xxhash64(F.col("key"), F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    w = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ranked.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    plan = plan.withColumnsRenamed({"source": "p_source", "size": "p_size"})
    buckets = buckets.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    buckets = buckets.withColumn("more", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")))
    b = buckets.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "n", "more", "rounds", "source_size", "target")
    on = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))
    rows = ranked.join(b, on).drop("b_source", "b_size", "b_bucket")
    split = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    whole = rows.where(~split).withColumn("times", F.col("rounds") + (F.col("more") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "key"))
    part = rows.where(split).withColumn("times", F.col("rounds") + (rank <= F.col("more")).cast("long"))
    return whole.unionByName(part).drop("h", "bucket", "n", "more", "rounds")


def mix_plan(docs: DataFrame, seed: int = 11, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken (size times times) for every row of docs."""
    d = with_size(only(docs, "doc_id", "source", "text"))
    sized = written(d.select(F.col("doc_id").alias("key"), "source", F.col("__size").alias("size")), "mix-sizes")
    out = multiplied(sized, seed, **settings)
    return out.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, seed: int = 11, **settings) -> DataFrame:
    """docs with each row as often as the mix takes it (0, 1 or 2 times), all columns kept."""
    names = docs.columns
    body = with_size(docs).withColumn("__key", F.xxhash64("doc_id", "text"))
    sized = written(body.select(F.struct(F.col("doc_id"), F.col("__key").alias("k")).alias("key"), "source", F.col("__size").alias("size")), "mix-sizes")
    take = multiplied(sized, seed, **settings).groupBy(F.col("key.doc_id").alias("t_id"), F.col("key.k").alias("t_key")).agg(F.sum("times").alias("t_times"), F.count("*").alias("t_rows"))
    rows = body.join(take, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("__key") == F.col("t_key")))
    # Rows of one id and text share their times evenly; which of them takes the odd one can't be told apart, so the first does.
    odd = rows.where("t_rows > 1").withColumn("__rank", F.row_number().over(Window.partitionBy("t_id", "t_key").orderBy(F.lit(0))))
    odd = odd.withColumn("__n", F.floor((F.col("t_times") + F.col("t_rows") - F.col("__rank")) / F.col("t_rows")).cast("int"))
    one = rows.where("t_rows = 1").withColumn("__n", F.col("t_times").cast("int"))
    both = one.unionByName(odd.drop("__rank"))
    return both.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in names])
