"""Queries by name over the fixture tables (whole tables), and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vec import rounded, vector_of, vector_sum
from ..operators import agreement, constructs, diagnostics, lowrank, maps, naming, nli, partials, redundancy, retention, similarity, sums
from ..operators.fit import item_loadings
from ..sources import files, pool
from ..sources.items import dequantised, fixture, quantised, table
from .oracle import SQL

THRESHOLD = 0.40
DEPTH = 5
POOL = 400
PICK = 5

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def labels_of(items: DataFrame) -> DataFrame:
    """Each factor's label vector: that of its first item."""
    return items.groupBy(F.col("factor").alias("construct")).agg(F.min_by("v", "ord").alias("w"))


def loadings_of(items: DataFrame) -> DataFrame:
    """The leading coordinates as pseudo-loadings."""
    return items.select("ord", F.posexplode(F.slice("v", 1, DEPTH)).alias("f_ord", "loading")).select("ord", "f_ord", F.format_string("F%d", F.col("f_ord") + 1).alias("factor"), "loading")


def theory_of(items: DataFrame) -> DataFrame:
    return items.select("ord", F.col("factor").alias("theoretical"))


def phi_of(items: DataFrame) -> DataFrame:
    """Correlations of the pseudo-loadings, by position."""
    l = loadings_of(items)
    a, b = l.select("ord", F.col("f_ord").alias("f1"), F.col("loading").alias("x")), l.select("ord", F.col("f_ord").alias("f2"), F.col("loading").alias("y"))
    return a.join(b, "ord").groupBy("f1", "f2").agg(F.corr("x", "y").alias("r"))


def pool_of(items: DataFrame) -> DataFrame:
    return items.select(F.col("ord").alias("row"), F.format_string("w%d", "ord").alias("word"), F.format_string("f%d", F.floor(F.col("ord") / 2)).alias("family"), (F.col("ord") % 3 == 0).alias("tier1"), "v")


def targets_of(items: DataFrame) -> DataFrame:
    return vector_sum(items.select("factor", "v"), "factor", unit=False).select(F.col("factor").alias("target"), F.transform("s", lambda x: x / F.col("n")).alias("t"))


def eigen_of(items: DataFrame) -> DataFrame:
    """Variances of the dimensions, scaled to sum to their number and ranked: shaped like eigenvalues."""
    v = items.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("s2"))
    v = v.crossJoin(v.agg(F.sum("s2").alias("all"), F.count("*").alias("j")))
    return v.select("pos", (F.col("s2") * F.col("j") / F.col("all")).alias("eig")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("eig"), "pos"))).select("rank", "eig")


def six(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


def pairs(spark: SparkSession, sf_dir: str, encoding: str = "atomic", threshold: float | None = None) -> DataFrame:
    return similarity.similarity_pairs(fixture(spark, sf_dir), encoding, threshold)


@query
def unit_norms(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return d.select("ord", "code", rounded(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


@query
def atomic_pairs(spark, sf_dir):
    return six(pairs(spark, sf_dir), "sim")


@query
def keyed_pairs(spark, sf_dir):
    return six(pairs(spark, sf_dir, "keyed"), "sim")


@query
def squid_pairs(spark, sf_dir):
    return six(pairs(spark, sf_dir, "squid"), "sim")


@query
def pearson_pairs(spark, sf_dir):
    return six(pairs(spark, sf_dir, "pearson"), "sim")


@query
def encoding_ranges(spark, sf_dir):
    return six(sums.sim_ranges(fixture(spark, sf_dir)), "lowest", "highest", "mean")


@query
def redundant_pairs(spark, sf_dir):
    return redundancy.redundant_pairs(pairs(spark, sf_dir, threshold=THRESHOLD), THRESHOLD)


@query
def redundant_clusters(spark, sf_dir):
    return redundancy.connected_components(pairs(spark, sf_dir, threshold=THRESHOLD))


@query
def centrality(spark, sf_dir):
    return six(sums.centrality(fixture(spark, sf_dir)), "centrality")


@query
def suggest_remove(spark, sf_dir):
    central = sums.centrality(fixture(spark, sf_dir))
    return redundancy.suggest_remove(redundancy.connected_components(pairs(spark, sf_dir, threshold=THRESHOLD)), central)


@query
def anchor_centroid_loo(spark, sf_dir):
    return six(constructs.anchor_centroid(fixture(spark, sf_dir)), "sim")


@query
def anchor_label(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(constructs.anchor_labels(d, labels_of(d)), "sim")


@query
def weak_items(spark, sf_dir):
    return six(constructs.weakest(constructs.anchor_centroid(fixture(spark, sf_dir))), "own")


@query
def projection(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(constructs.project(d, d.where("factor = '0'"), d.where("factor = '1'")), "projection", "scaled")


@query
def jinglejangle_flags(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return constructs.jingle_jangle(d, labels_of(d))


@query
def item_fit_summary(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(constructs.item_fit(d.where("ord % 50 = 0").select("ord", "v"), d, labels_of(d), members=True), "sim_name", "sim_items", "gap", "nearest_sim")


@query
def short_form_topn(spark, sf_dir):
    return constructs.short_form(constructs.anchor_centroid(fixture(spark, sf_dir)), PICK)


@query
def short_form_dropped(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return constructs.dropped(d, constructs.short_form(constructs.anchor_centroid(d), PICK))


@query
def assign_items(spark, sf_dir):
    return six(agreement.assign(loadings_of(fixture(spark, sf_dir))), "loading")


@query
def contingency_nmi(spark, sf_dir):
    return six(agreement.nmi(table(spark, sf_dir, "documents"), "lang", "source"), "nmi")


@query
def contingency_ari(spark, sf_dir):
    return six(agreement.ari(table(spark, sf_dir, "documents"), "lang", "source"), "ari")


@query
def daal(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(agreement.daal(loadings_of(d), theory_of(d)), "daal")


@query
def omega(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(agreement.omega(loadings_of(d), theory_of(d)), "omega_assigned", "omega_theoretical")


@query
def tucker_phi(spark, sf_dir):
    d = fixture(spark, sf_dir)
    other = loadings_of(d.withColumn("v", F.slice("v", DEPTH + 1, DEPTH)))
    return six(agreement.tucker(loadings_of(d), other), "phi")


@query
def frobenius_phi(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(agreement.frobenius(phi_of(d), phi_of(d.withColumn("v", F.slice("v", DEPTH + 1, DEPTH)))), "frobenius")


@query
def split_half(spark, sf_dir):
    return six(sums.split_half(fixture(spark, sf_dir)), "reliability")


@query
def disattenuated(spark, sf_dir):
    return six(sums.disattenuated(fixture(spark, sf_dir)), "r", "disattenuated")


@query
def consensus_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("method"), (F.col("n_chars") % 7 + 1).alias("n_factors"))
    return retention.consensus(d)


@query
def ekc_references(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(retention.ekc(eigen_of(d), 64, d.count()), "eig", "ref")


@query
def sequential_rule(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return retention.sequential(retention.ekc(eigen_of(d), 64, d.count()))


@query
def kaiser_count(spark, sf_dir):
    return retention.kaiser(eigen_of(fixture(spark, sf_dir)))


@query
def tefi_partition(spark, sf_dir):
    return six(sums.tefi(fixture(spark, sf_dir)), "tefi")


@query
def rmsr_pairs(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(sums.rmsr(d, d.select("ord", F.slice("v", 1, DEPTH).alias("l"))), "rmsr")


@query
def minmax_composite(spark, sf_dir):
    d = fixture(spark, sf_dir).groupBy(F.col("factor").cast("int").alias("depth")).agg(F.avg(F.abs(F.col("v")[0])).alias("nmi"), F.avg(F.col("v")[1]).alias("tefi"))
    return six(retention.composite(d), "nmi", "tefi", "nmi_norm", "tefi_norm", "composite")


@query
def pool_topk(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(naming.pool_topk(pool_of(d), targets_of(d), POOL), "score").drop("v")


@query
def pool_gate(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(naming.gate(naming.pool_topk(pool_of(d), targets_of(d), POOL)), "score").select("target", "place", "word", "family", "tier1", "score")


@query
def pool_pick(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return six(naming.pick(naming.gate(naming.pool_topk(pool_of(d), targets_of(d), POOL)), PICK), "score")


@query
def nli_signed_pairs(spark, sf_dir):
    rule = lambda p, h: (F.when(F.substring(p, 1, 3) == F.substring(h, 1, 3), 0.9).otherwise(0.1), (F.length(p) % 7) / 10.0)
    return six(similarity.signed_nli(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text"), rule), "sim")


@query
def data_corr_matrix(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    both = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    one = table(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in both])
    return six(one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in both])).alias("c")).select("c.*"), "r")


@query
def response_clean_reverse_score(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("int") % 7).alias("q"))
    return d.where(F.col("q").between(1, 5)).withColumn("reversed", 6 - F.col("q")).groupBy("l_returnflag", "q", "reversed").agg(F.count("*").alias("n"))


@query
def corplot_order(spark, sf_dir):
    """Blocks of factors: those named first, in their order, then the others as they first appear; items stay in order."""
    return maps.group_order(fixture(spark, sf_dir), ("3", "1"))


@query
def heatmap(spark, sf_dir):
    """The similarity matrix in the order of its blocks."""
    d = fixture(spark, sf_dir)
    return six(maps.item_heatmap(d, maps.group_order(d, ("3", "1"))), "sim")


@query
def projection_axes(spark, sf_dir):
    """Two axes between label means."""
    d = fixture(spark, sf_dir)
    pole = lambda f, axis, name: d.where(F.col("factor") == f).select(F.lit(axis).alias("axis"), F.lit(name).alias("pole"), "v")
    poles = [pole("0", "first", "low"), pole("1", "first", "high"), pole("2", "second", "low"), pole("3", "second", "high")]
    return six(constructs.project_axes(d, reduce(DataFrame.unionByName, poles)), "score")


@query
def projection_ends(spark, sf_dir):
    return constructs.axis_ends(projection_axes(spark, sf_dir), 5)


@query
def flags_ordered(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return constructs.flags_in_order(constructs.jingle_jangle(d, labels_of(d)))


@query
def pairs_ordered(spark, sf_dir):
    return redundancy.in_order(redundancy.redundant_pairs(pairs(spark, sf_dir, threshold=THRESHOLD), THRESHOLD))


@query
def gap_bands(spark, sf_dir):
    return item_fit_summary(spark, sf_dir).select("ord", "gap", text.band(F.col("gap"), text.GAP_BANDS).alias("discrimination"))


@query
def item_fit_reversed(spark, sf_dir):
    """Reverse-keyed candidates, with a construct named by the beginning of its name."""
    d = fixture(spark, sf_dir).withColumn("factor", F.concat(F.lit("Scale "), "factor"))
    out = constructs.item_fit(d.where("ord % 50 = 0").select("ord", "v"), d, labels_of(d), construct="scale 3", reverse_key=True, members=True)
    return six(out, "sim_name", "sim_items", "gap", "nearest_sim", "target_sim")


@query
def name_rules(spark, sf_dir):
    """Slugs, default codes and the naming template over part names."""
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.default_code(F.col("p_partkey")).alias("code"), text.naming_query(F.col("p_name")).alias("query"))


@query
def like_codes(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    both = [text.like_codes(d, c).withColumn("of", F.lit(c)) for c in ("p_name", "p_brand", "p_type")]
    return reduce(DataFrame.unionByName, both).unionByName(text.like_codes(fixture(spark, sf_dir), "code").withColumn("of", F.lit("code")))


@query
def generated_codes(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("factor"))
    return text.generated_codes(d)


@query
def name_matches(spark, sf_dir):
    """Beginnings of nation names, and whether each means one nation."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    wanted = names.select(F.lower(F.substring("name", 1, 2)).alias("wanted")).unionByName(names.select(F.lower("name").alias("wanted"))).unionByName(names.select(F.concat("name", F.lit("?")).alias("wanted")))
    return text.matches(wanted, names)


@query
def pool_scan(spark, sf_dir):
    """Words 100 to 299 of a pool in eight bits, as unit vectors again: their first coordinates."""
    d = quantised(pool_of(fixture(spark, sf_dir))).where("row >= 100 AND row < 300").withColumn("v", dequantised(F.col("q"), F.col("scale")))
    d = d.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return d.select("row", "word", rounded(F.col("v")[0] / F.col("n"), 5).alias("x0"), rounded(F.col("v")[1] / F.col("n"), 5).alias("x1"))


@query
def pool_lookup(spark, sf_dir):
    d = pool_of(fixture(spark, sf_dir))
    return pool.pool_rows(d, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"))).select("row", "word", "family", "tier1")


@query
def family_lookup(spark, sf_dir):
    d = fixture(spark, sf_dir)
    return pool.family_of(d.select(F.format_string("w%d", F.col("ord") * 2).alias("word")), pool_of(d))


@query
def nli_ordered(spark, sf_dir):
    """All ordered pairs by a classifier on executors."""
    rule = lambda a, b: {"entailment": [0.9 if x[:3] == y[:3] else 0.1 for x, y in zip(a, b)], "contradiction": [len(x) % 7 / 10 for x in a]}  # noqa: B905, E731
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return six(nli.nli_pairs(texts, rule, symmetric=False), "sim")


@query
def responses_cleaned(spark, sf_dir):
    """Cases whose values are all in range, one column turned round."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") % 7).alias("a"), (F.col("l_linenumber") % 6).alias("b"))
    return files.cleaned(d, 1, 5, ("b",)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query
def null_summary(spark, sf_dir):
    """Mean and tails of each metric over draws."""
    from ..operators.fit import calibration_summary

    d = fixture(spark, sf_dir).select(F.col("v")[0].alias("rmsr"), F.col("v")[1].alias("caf"), F.col("v")[2].alias("tefi"))
    return six(calibration_summary(d), "mean", "q05", "q95")


@query
def null_percentiles(spark, sf_dir):
    draws = fixture(spark, sf_dir).select(F.posexplode("v").alias("rank", "eig"))
    return six(retention.null_percentiles(draws), "q")


@query
def cd_improvement(spark, sf_dir):
    d = fixture(spark, sf_dir).select((F.col("factor").cast("int") + 1).alias("k"), F.abs(F.col("v")[0]).alias("rmsr"))
    return six(retention.cd_profile(d), "median_rmsr", "normalized", "improvement")


# Kernels: no SQL form


@query
def fit_loadings(spark, sf_dir):
    return item_loadings(fixture(spark, sf_dir), DEPTH)


@query
def parallel_analysis(spark, sf_dir):
    return retention.parallel_analysis(spark, *similarity.size_of(fixture(spark, sf_dir)))


@query
def map_rule(spark, sf_dir):
    m, _ = similarity.vectors(fixture(spark, sf_dir))
    c = partials.profile(spark, similarity.unit(m))
    return spark.createDataFrame(pa.table({"m": np.arange(1, len(c) + 1, dtype=np.int32), "criterion": c}), "m int, criterion double")


@query
def cd_profile(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return retention.comparison_data_of(table(spark, sf_dir, "lineitem").select(*cols), k_max=2, alpha=0.30)


@query
def ega_communities(spark, sf_dir):
    m, rows = similarity.vectors(fixture(spark, sf_dir))
    c = lowrank.walktrap(len(m), *lowrank.tmfg(similarity.unit(m)))
    return spark.createDataFrame(pa.table({"ord": rows["ord"], "community": c.astype(np.int32)}))


@query
def uva_pairs(spark, sf_dir):
    """Overlaps of all item pairs in the EBIC network."""
    m, rows = similarity.vectors(fixture(spark, sf_dir))
    own, b = lowrank.repaired(similarity.unit(m))
    i, j, w = lowrank.ebic_glasso(own, b, max(1000, 20 * len(m)))
    return redundancy.network_overlaps(spark, i, j, w, rows.column("code").to_pylist())


@query
def item_map(spark, sf_dir):
    return maps.pca_map(fixture(spark, sf_dir)).select("ord", "x", "y")
