"""What is sent so that workers meet the pairs of items."""

import numpy as np
import pytest

from facetlens.operators import maps, similarity
from facetlens.sources.items import items_from


def some(spark, n, d):
    """Items with gaps between their numbers, which begin below 0."""
    m = np.random.default_rng(5).normal(size=(n, d))
    rows = [(3 * k - 40, x.tolist(), str(k % 3)) for k, x in enumerate(m)]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return u @ u.T, items_from(spark.createDataFrame(rows, "ord long, embedding array<double>, factor string"), "ord", "embedding", factor="factor").repartition(4).cache()


def shuffled(spark) -> float:
    """MB that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


@pytest.fixture(autouse=True)
def large(spark):
    """Joins as of tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("encoding", similarity.ENCODINGS)
def test_items_are_sent_a_fixed_number_of_times(spark, encoding):
    s, d = some(spark, 800, 64)
    d.count()
    before = shuffled(spark)
    got = similarity.similarity_pairs(d, encoding, block=8).toPandas()
    assert shuffled(spark) - before < 12 * 800 * 64 * 8 / 1e6
    i, j = ((got[c].to_numpy() + 40) // 3 for c in "ij")
    assert (i < j).all() and len(set(zip(i, j, strict=True))) == 800 * 799 // 2
    if encoding == "atomic":
        assert np.allclose(got["sim"], s[i, j])


def test_heatmap_sends_no_pairs(spark):
    s, d = some(spark, 700, 4)
    d.count()
    before = shuffled(spark)
    order = maps.group_order(d, ("1",))
    got = maps.item_heatmap(d, order).toPandas()
    assert shuffled(spark) - before < 2.5
    at = {r.place: (r.ord + 40) // 3 for r in order.collect()}
    m = np.full((700, 700), np.nan)
    m[[at[r] for r in got["row"]], [at[c] for c in got["col"]]] = got["sim"]
    assert len(got) == 490_000 and np.allclose(m, s)
