"""Sums in the workers against the pair functions, searches over all items, and what workers can import."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.operators import agreement, constructs, diagnostics, redundancy, similarity, sums
from facetlens.sources.items import items_from

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def random_items(spark, n=600, step=3):
    """Items in several blocks, with gaps between their numbers, a row of zeros and an item of no factor."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(n, 6)) + rng.normal(size=6)
    m[5 % n] = 0
    rows = [(k * step, x.tolist(), None if k == 9 else str(k % 4)) for k, x in enumerate(m)]
    return items_from(spark.createDataFrame(rows, "ord long, embedding array<double>, factor string"), "ord", "embedding", factor="factor")


def test_sums_in_the_workers_equal_sums_over_pairs(spark):
    d = random_items(spark)
    p, y = similarity.similarity_pairs(d), similarity.similarity_pairs(d, "pearson")
    close = lambda a, b: all(u == v or u == pytest.approx(v, rel=1e-9) for u, v in zip(a, b, strict=True))
    ranges = {r.encoding: r for r in sums.sim_ranges(d).collect()}
    assert len(ranges) == 4 and close(ranges["atomic"][1:], diagnostics.sim_range(p).first()) and close(ranges["pearson"][1:], diagnostics.sim_range(y).first())
    a, b = (dict(map(tuple, c.collect())) for c in (sums.centrality(d), redundancy.centrality(p, 600)))
    assert len(a) == 600 and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in b)
    g = d.select("ord", F.col("factor").alias("group"))
    assert close(sums.tefi(d).first(), diagnostics.tefi(p, g).first())
    l = d.select("ord", F.slice("v", 1, 2).alias("l"))
    assert close(sums.rmsr(d, l).first(), diagnostics.rmsr(p, l).first())
    assert close(sums.split_half(d).first(), agreement.split_half(p).first())
    assert close(sums.disattenuated(d).first(), agreement.disattenuated(p, y).first())


def test_sums_of_one_item_and_of_none(spark):
    d = random_items(spark, 3)
    for few in (d.where("ord = 0"), d.where("ord < 0")):
        assert [tuple(r)[1:] for r in sums.sim_ranges(few, ("atomic",)).collect()] == [(None, None, None)]
        assert sums.rmsr(few, few.select("ord", F.col("v").alias("l"))).first().rmsr is None
        assert sums.split_half(few).collect() == [] and sums.disattenuated(few).first().disattenuated is None
    assert [tuple(r) for r in sums.centrality(d.where("ord = 0")).collect()] == [(0, 1.0)] and sums.centrality(d.where("ord < 0")).collect() == []


def test_nearest_searches_all_items_and_takes_the_first_of_equals(spark):
    d = random_items(spark)
    u = similarity.unit(np.array([r.v for r in d.orderBy("ord").collect()]))
    asked = d.where("ord % 5 = 0").select("ord", "v")
    got = {r.ord: (r.nearest, r.nearest_sim) for r in similarity.nearest(asked, d, others=True).collect()}
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert len(got) == 120 and all(got[k] == (3 * int(s[k // 3].argmax()), pytest.approx(s[k // 3].max())) for k in got if k != 15)
    assert got[15] == (0, 0.0)
    twice = d.unionByName(d.withColumn("ord", F.col("ord") + 10_000))
    assert all(r.ord == r.nearest for r in similarity.nearest(asked.where("ord <> 15"), twice).collect())


def test_item_fit_of_members_leaves_each_out(spark):
    d = random_items(spark, 40, 1)
    labels = d.where("factor is not null").groupBy(F.col("factor").alias("construct")).agg(F.min_by("v", "ord").alias("w"))
    items = d.where("factor is not null and ord <> 5")
    one = items.where("ord = 7").select("ord", "v")
    rest = items.where("ord <> 7")
    for turned in (False, True):
        a = constructs.item_fit(one, items, labels, reverse_key=turned, members=True).first()
        b = constructs.item_fit(one, rest, labels, reverse_key=turned).first()
        assert (a.best, a.second, a.nearest) == (b.best, b.second, b.nearest)
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in ("sim_name", "sim_items", "gap", "nearest_sim"))


def test_package_and_shared_folder_without_any_settings(tmp_path):
    """A session of another folder, whose configuration sets no checkpoint folder."""
    code = f"""
import sys; sys.path.insert(0, {str(HERE)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from facetlens.operators.redundancy import connected_components
from facetlens.operators.similarity import similarity_pairs
from facetlens.sources.items import items_from
d = s.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "ord long, embedding array<double>")
print(s.conf.get("spark.checkpoint.dir", None), connected_components(similarity_pairs(items_from(d, "ord", "embedding"))).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == ["None", "2"], out.stderr[-2000:]


def test_components_leave_only_their_result_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(redundancy, "shared_dir", lambda _: f"file://{tmp_path}")
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60)], "i long, j long")
    got = {r.item: r.cluster for r in redundancy.connected_components(chain).collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 60: 50} and len(list(tmp_path.iterdir())) == 1
