"""Items against constructs: anchoring, projection, jingle and jangle, item fit, short forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_name
from ..functions.vec import dot, norm, vector_sum
from .similarity import nearest

FLAG, STRENGTH, REDUNDANT, CROSS = 0.20, 0.05, 0.9, 0.07


def anchor_centroid(items: DataFrame) -> DataFrame:
    """ord, factor (the item's own), construct, sim: to each construct's centroid of unit vectors, without the item itself in its own.

    With S the sum of the group, u the item and a = u.S: u.(S-u) = a - 1 and |S-u|^2 = |S|^2 - 2a + 1, so nothing is
    summed anew. A construct of one item gives NULL for it."""
    sums = vector_sum(items.select("factor", "v"), "factor").select(F.col("factor").alias("construct"), "n", "s", dot("s", "s").alias("ss"))
    a = dot("v", "s") / F.col("norm")
    rest = F.sqrt(F.greatest(F.col("ss") - 2 * F.col("a") + 1, F.lit(0.0)))
    own = F.when((F.col("n") > 1) & (rest > 1e-12), (F.col("a") - 1) / rest)
    other = F.when(F.col("ss") > 0, F.col("a") / F.sqrt("ss"))
    d = items.select("ord", "factor", "v", norm("v").alias("norm")).crossJoin(sums).select("ord", "factor", "construct", "n", "ss", a.alias("a"))
    return d.select("ord", "factor", "construct", F.when(F.col("factor") == F.col("construct"), own).otherwise(other).alias("sim"))


def anchor_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """ord, factor, construct, sim to the label vectors (construct, w)."""
    both = items.select("ord", "factor", "v").crossJoin(labels.select("construct", "w"))
    return both.select("ord", "factor", "construct", (dot("v", "w") / (norm("v") * norm("w"))).alias("sim"))


def missing_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.select(F.col("factor").alias("construct")).distinct().join(labels, "construct", "left_anti")


def own_similarity(anchor: DataFrame) -> DataFrame:
    return anchor.where(F.col("factor") == F.col("construct")).select("ord", "factor", F.col("sim").alias("own"))


def weakest(anchor: DataFrame, n: int = 8) -> DataFrame:
    return own_similarity(anchor).orderBy(F.asc_nulls_last("own"), "ord").limit(n)


def project(items: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """ord, projection, scaled: onto the axis from the mean of low to the mean of high (raw vectors, column v), and with the unit poles at 0 and 1."""
    mean = lambda d, name: vector_sum(d.select(F.lit(0).alias("k"), "v"), "k", unit=False).select(F.transform("s", lambda x: x / F.col("n")).alias(name))
    axis = mean(low, "lo").crossJoin(mean(high, "hi")).select("lo", "hi", F.zip_with("hi", "lo", lambda x, y: x - y).alias("a"))
    axis = axis.select("a", norm("a").alias("an"), (dot("lo", "a") / norm("lo") / norm("a")).alias("p_lo"), (dot("hi", "a") / norm("hi") / norm("a")).alias("p_hi"))
    p = items.select("ord", "v").crossJoin(axis).select("ord", (dot("v", "a") / (norm("v") * F.col("an"))).alias("projection"), "p_lo", "p_hi")
    span = F.col("p_hi") - F.col("p_lo")
    return p.select("ord", "projection", F.when(span != 0, (F.col("projection") - F.col("p_lo")) / span).alias("scaled"))


def project_axes(items: DataFrame, poles: DataFrame, normalize: bool = True) -> DataFrame:
    """ord, axis, score: items on several axes. poles: axis, pole ("low" or "high") and v, one row or more for each pole.

    Poles that are phrases are embedded first (see embedding.embed). Axes are few, and their vectors are checked here: both
    poles must be there, differ, and have the items' dimension."""
    mean = vector_sum(poles.select(F.concat_ws("\u0001", "axis", "pole").alias("k"), "v"), "k", unit=False).select(F.split("k", "\u0001").alias("k"), F.transform("s", lambda x: x / F.col("n")).alias("m"))
    ends = mean.groupBy(F.col("k")[0].alias("axis")).agg(F.max(F.when(F.col("k")[1] == "low", F.col("m"))).alias("lo"), F.max(F.when(F.col("k")[1] == "high", F.col("m"))).alias("hi"))
    axes = ends.select("axis", "lo", "hi", F.zip_with("hi", "lo", lambda x, y: x - y).alias("a"))
    size = items.select(F.size("v").alias("n")).first()
    for r in axes.select("axis", F.size("lo").alias("lo"), F.size("hi").alias("hi"), F.coalesce(dot("a", "a"), F.lit(0.0)).alias("aa")).collect():
        if r["lo"] in (None, -1) or r["hi"] in (None, -1):
            raise ValueError(f"axis {r['axis']!r} lacks a pole")
        if size and {r["lo"], r["hi"]} != {size["n"]}:
            raise ValueError(f"the poles of {r['axis']!r} aren't of the items' {size['n']} dimensions")
        if r["aa"] == 0:
            raise ValueError(f"the poles of {r['axis']!r} are the same")
    axes = axes.select("axis", "a", norm("a").alias("an"), (dot("lo", "a") / norm("lo") / norm("a")).alias("p_lo"), (dot("hi", "a") / norm("hi") / norm("a")).alias("p_hi"))
    p = items.select("ord", "v", norm("v").alias("n")).crossJoin(axes).select("ord", "axis", (dot("v", "a") / (F.col("n") * F.col("an"))).alias("p"), "p_lo", "p_hi")
    span = F.col("p_hi") - F.col("p_lo")
    return p.select("ord", "axis", (F.when(span != 0, (F.col("p") - F.col("p_lo")) / span).otherwise(F.col("p")) if normalize else F.col("p")).alias("score"))


def axis_ends(scores: DataFrame, n: int = 5) -> DataFrame:
    """axis, pole, place, ord, score: the n lowest and the n highest of each axis, the outermost first."""
    low = F.row_number().over(Window.partitionBy("axis").orderBy("score", "ord"))
    high = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("score"), "ord"))
    one = lambda w, name: scores.withColumn("place", w).where(F.col("place") <= n).select("axis", F.lit(name).alias("pole"), "place", "ord", "score")
    return one(low, "low").unionByName(one(high, "high"))


def resolved_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """The label vectors (construct, w) of the items' constructs; a construct without one is an error."""
    missing = [r[0] for r in missing_labels(items, labels).limit(20).collect()]
    if missing:
        raise ValueError(f"no label for {sorted(map(str, missing))}")
    return labels.join(items.select(F.col("factor").alias("construct")).distinct(), "construct", "left_semi")


def flags_in_order(flags: DataFrame) -> DataFrame:
    """Flags of jingle_jangle with their place: by the size of the divergence, then by scale_b and scale_a."""
    return flags.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("divergence")), "scale_b", "scale_a")))


def jingle_jangle(items: DataFrame, labels: DataFrame, flag: float = FLAG) -> DataFrame:
    """scale_a, scale_b, content_sim, label_sim, divergence, type of all pairs of scales; content is the mean of raw vectors, and the unrounded divergence decides."""
    content = vector_sum(items.select("factor", "v"), "factor", unit=False)
    scales = content.join(labels.select(F.col("construct").alias("factor"), "w"), "factor").select("factor", "s", "w")
    a = scales.select(F.col("factor").alias("scale_a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
    b = scales.select(F.col("factor").alias("scale_b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
    both = a.join(b, F.col("scale_a") < F.col("scale_b")).select("scale_a", "scale_b", (dot("sa", "sb") / (norm("sa") * norm("sb"))).alias("c"), (dot("wa", "wb") / (norm("wa") * norm("wb"))).alias("l"))
    d = F.col("c") - F.col("l")
    kind = F.when(d >= flag, "jangle").when(d <= -flag, "jingle").otherwise("-")
    return both.select("scale_a", "scale_b", F.round("c", 3).alias("content_sim"), F.round("l", 3).alias("label_sim"), F.round(d, 3).alias("divergence"), kind.alias("type"))


# What strength says of a candidate against its construct's own items.
STRONGER, WEAKER, TYPICAL = "stronger than average", "weaker than average", "about typical"


def signed(candidates: DataFrame, reverse_key: bool = True) -> DataFrame:
    """Candidates with their vectors turned round, as reverse-keyed ones are compared."""
    return candidates.withColumn("v", F.transform("v", lambda x: -x)) if reverse_key else candidates


def profile(candidates: DataFrame, items: DataFrame, labels: DataFrame, members: bool = False, sign: int = 1) -> DataFrame:
    """ord, construct, sim_name, sim_items of each candidate (ord, v) and construct: to its label vector (construct, w) and to the centroid of its items' unit vectors.

    With `members` candidates are among the items, turned round where sign is -1, and each is left out of its own
    construct's centroid as in anchor_centroid; NULL if nothing is left."""
    sums = vector_sum(items.select("factor", "v"), "factor").select(F.col("factor").alias("construct"), "n", "s", dot("s", "s").alias("ss"))
    c = candidates.select("ord", "v", norm("v").alias("cn"))
    c = c.join(items.select("ord", F.col("factor").alias("own")), "ord", "left") if members else c.withColumn("own", F.lit(None).cast("string"))
    a = c.crossJoin(sums.join(labels, "construct")).select("ord", "construct", "own", "n", "ss", (dot("v", "w") / (F.col("cn") * norm("w"))).alias("sim_name"), (dot("v", "s") / F.col("cn")).alias("a"))
    rest = F.sqrt(F.greatest(F.col("ss") - 2 * sign * F.col("a") + 1, F.lit(0.0)))
    left = F.when((F.col("n") > 1) & (rest > 1e-12), (F.col("a") - sign) / rest)
    whole = F.col("a") / F.when(F.col("ss") > 0, F.sqrt("ss")).otherwise(F.lit(1.0))
    return a.select("ord", "construct", "sim_name", F.when(F.col("own") == F.col("construct"), left).otherwise(whole).alias("sim_items"))


def item_fit(candidates: DataFrame, items: DataFrame, labels: DataFrame, redundancy_cutoff: float = REDUNDANT, construct: str | None = None, reverse_key: bool = False, members: bool = False) -> DataFrame:
    """ord, best, sim_name, sim_items, second, gap, strength, nearest, nearest_sim, verdict of each candidate (ord, v).

    With `members` candidates are rows of items, by ord: each is held against all of them but itself.

    The construct whose items the candidate is most like is its best, and the gap is to the second by that similarity. With
    `construct` (a name, or the beginning of one) target and target_sim say how like that one's items it is."""
    if construct is not None:
        construct = match_name(construct, [r[0] for r in labels.select("construct").distinct().collect()])
    candidates = signed(candidates, reverse_key)
    sims = profile(candidates, items, labels, members, -1 if reverse_key else 1)
    first = items.groupBy(F.col("factor").alias("construct")).agg(F.min("ord").alias("first"))
    w = Window.partitionBy("ord").orderBy(F.desc("sim_items"), "first")
    top = sims.join(first, "construct").withColumn("r", F.row_number().over(w)).where("r <= 2")
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    best = top.groupBy("ord").agg(at(1, "construct").alias("best"), at(1, "sim_name").alias("sim_name"), at(1, "sim_items").alias("sim_items"), at(2, "construct").alias("second"), at(2, "sim_items").alias("s2"))
    usual = own_similarity(anchor_centroid(items)).groupBy(F.col("factor").alias("best")).agg(F.avg("own").alias("usual"))
    d = best.join(usual, "best", "left").join(nearest(candidates, items, others=members), "ord")
    gap = F.col("sim_items") - F.col("s2")
    strength = F.when(F.col("usual").isNull(), TYPICAL).when(F.col("sim_items") >= F.col("usual") + STRENGTH, STRONGER).when(F.col("sim_items") <= F.col("usual") - STRENGTH, WEAKER).otherwise(TYPICAL)
    verdict = F.when(F.col("nearest_sim") >= redundancy_cutoff, "redundant").when(strength == WEAKER, "weak").when(gap < CROSS, "cross-loads").otherwise("good")
    out = d.select("ord", "best", "sim_name", "sim_items", "second", gap.alias("gap"), strength.alias("strength"), "nearest", "nearest_sim", verdict.alias("verdict"))
    if construct is None:
        return out
    own = sims.where(F.col("construct") == construct).select("ord", F.col("construct").alias("target"), F.col("sim_items").alias("target_sim"))
    return out.join(own, "ord", "left")


def short_form(anchor: DataFrame, n: int) -> DataFrame:
    """ord, factor, rank of the n best anchored items of each factor."""
    w = Window.partitionBy("factor").orderBy(F.desc_nulls_last("own"), "ord")
    return own_similarity(anchor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("ord", "factor", "rank")


def dropped(items: DataFrame, kept: DataFrame) -> DataFrame:
    return items.select("ord", "factor").join(kept, "ord", "left_anti")
