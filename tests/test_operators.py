import numpy as np
import pytest

from facetlens.functions.vec import norm
from facetlens.operators import agreement, constructs, embedding, kernels, naming, redundancy, retention, similarity
from facetlens.operators.fit import check_similarity, fit, medoids, simplify
from facetlens.plans import catalog
from facetlens.sources.items import check_scoring, items_from, load_npz


def items(spark, m, factors=None, scoring=None):
    rows = [(k, [float(x) for x in v], factors[k] if factors else None, scoring[k] if scoring else 1) for k, v in enumerate(m)]
    return items_from(spark.createDataFrame(rows, "ord long, embedding array<double>, factor string, scoring int"), "ord", "embedding", factor="factor", scoring="scoring")


def planted(j=50, d=256, k=5, noise=1.0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((k, d))
    return np.repeat(centres, j // k, axis=0) + noise * rng.standard_normal((j, d)), [f"f{i // (j // k)}" for i in range(j)]


@pytest.mark.parametrize("encoding", similarity.ENCODINGS)
def test_blocks_equal_one_product(spark, encoding):
    m = np.random.default_rng(0).standard_normal((23, 6))
    s = [(-1) ** k for k in range(23)]
    u = similarity.encode(m, encoding, np.array(s, float))
    for block in (1 << 10, 5, 4):
        got = {(r.i, r.j): r.sim for r in similarity.similarity_pairs(items(spark, m, scoring=s).repartition(3), encoding, block=block).collect()}
        assert len(got) == 23 * 22 // 2
        assert all(abs(x - u[i] @ u[j]) < 1e-12 for (i, j), x in got.items())


def test_zero_row_is_like_nothing(spark):
    got = {(r.i, r.j): r.sim for r in similarity.similarity_pairs(items(spark, [[0, 0], [1, 0], [1, 1]])).collect()}
    assert got[0, 1] == got[0, 2] == 0 and got[1, 2] > 0.7
    assert items(spark, [[0, 0]]).select(norm("v")).first()[0] == 1.0


def test_scoring_is_checked(spark):
    with pytest.raises(ValueError, match="scoring"):
        check_scoring(items(spark, [[1.0]], scoring=[2]))


def test_nmi_and_ari_edges(spark):
    two = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "y")], "a string, b string")
    one = spark.createDataFrame([("a", "x")] * 3, "a string, b string")
    assert abs(agreement.nmi(two, "a", "b").first()[0] - 1) < 1e-12
    assert agreement.nmi(one, "a", "b").first()[0] == 0
    assert agreement.ari(one, "a", "b").first()[0] == 1
    assert abs(retention.nmi(np.array([0, 0, 1]), np.array([1, 1, 0])) - 1) < 1e-12


def test_components_keep_apart(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "i long, j long")
    assert {r.item: r.cluster for r in redundancy.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_single_item_construct_has_no_anchor(spark):
    a = {(r.ord, r.construct): r.sim for r in constructs.anchor_centroid(items(spark, [[1, 0], [0.5, 1], [0, 1]], ["p", "q", "q"])).collect()}
    assert a[0, "p"] is None and abs(a[2, "q"] - 1 / np.sqrt(1.25)) < 1e-12


def test_injected_duplicate_is_redundant(spark):
    m, f = planted(20, 32, 2)
    d = items(spark, m, f)
    labels = d.groupBy("factor").agg({"v": "first"}).toDF("construct", "w")
    got = constructs.item_fit(spark.createDataFrame([(99, m[3].tolist())], "ord long, v array<double>"), d, labels).first()
    assert (got.nearest, got.verdict) == (3, "redundant")


def test_psd_repair_and_symmetry():
    r = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    x = kernels.psd_repair(r)
    assert np.linalg.eigvalsh(x).min() > -1e-8 and np.allclose(np.diag(x), 1)
    with pytest.raises(ValueError, match="symmetric"):
        check_similarity(np.array([[1, 0.2], [0.3, 1]]))


def test_tefi_drops_rows_with_zeros():
    assert np.isfinite(kernels.tefi(np.eye(5), np.array([0, 0, 1, 1, 1])))


def test_planted_structure_is_found(spark):
    m, f = planted()
    out = fit(items(spark, m, f), n_factors=5)
    found = np.abs(out.loadings).argmax(axis=1)
    assert retention.nmi(found, np.array(f)) > 0.95
    assert fit(items(spark, m, f), method="parallel", n_iter=20).n_factors == 5
    assert "5 factors" in out.report() and out.as_dict()["factors"] == 5
    short = simplify(items(spark, m, f), fit(items(spark, m, f), n_factors=5), 5)
    assert short.kept.count() == 25 and len(short.fit.codes) == 25


def test_networks_find_planted_groups():
    m, f = planted(40, 128, 4)
    u = similarity.unit(m)
    assert retention.nmi(kernels.walktrap(kernels.tmfg(u @ u.T)), np.array(f)) > 0.9
    w = kernels.wto(kernels.ebic_glasso(np.corrcoef(m[:12]), 300))
    assert np.allclose(w, w.T) and not np.diag(w).any()


def test_graphical_lasso_meets_its_conditions():
    s = np.corrcoef(np.random.default_rng(8).standard_normal((15, 40)))
    x = kernels.graphical_lasso(s, 0.1)
    g = np.linalg.inv(x) - s
    assert np.abs(g).max() < 0.1 + 1e-3 and np.abs(g - 0.1 * np.sign(x))[x != 0].max() < 1e-3 and (x == 0).any()


def test_uva_sees_all_items(spark, tmp_path):
    m, f = planted(12, 32, 2)
    m[7] = m[3] + 0.05
    spark.createDataFrame([(k, v.tolist(), f[k]) for k, v in enumerate(m)], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.overlap for r in catalog.QUERIES["uva_pairs"](spark, str(tmp_path)).collect()}
    assert len(got) == 12 * 11 // 2 and max(got, key=got.get) == ("v0003", "v0007")


def test_average_partials_go_past_forty(spark, tmp_path):
    m = np.random.default_rng(11).standard_normal((60, 80))
    spark.createDataFrame([(k, v.tolist(), "f") for k, v in enumerate(m)], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.m: r.criterion for r in catalog.QUERIES["map_rule"](spark, str(tmp_path)).collect()}
    u = similarity.unit(m)
    s = kernels.psd_repair(u @ u.T)
    values, vectors = np.linalg.eigh(s)
    for k in (1, 41, 58):
        e = s - (vectors[:, -k:] * values[-k:]) @ vectors[:, -k:].T
        p = e / np.sqrt(np.outer(np.diag(e), np.diag(e)))
        assert abs(got[k] - ((p * p).sum() - 60) / (60 * 59)) < 1e-9
    assert sorted(got) == list(range(1, 59))
    q = {r["rank"]: r.q for r in catalog.QUERIES["parallel_analysis"](spark, str(tmp_path)).collect()}
    draws = np.array([kernels.null_eigenvalues(60, 80, 42 + k) for k in range(100)])
    assert np.allclose([q[k + 1] for k in range(60)], np.percentile(draws, 95, axis=0))


def test_comparison_data_falls_with_factors(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((300, 3)), 4, axis=1) * 0.8 + 0.6 * rng.standard_normal((300, 12))
    got = retention.comparison_data(spark, x, k_max=4, n_samples=60, n_pop=2000).orderBy("k").collect()
    med = [r.median_rmsr for r in got]
    assert med[2] < med[1] < med[0] and got[0].normalized == 1
    with pytest.raises(ValueError, match="cases"):
        retention.comparison_data(spark, x[:5])
    assert kernels.mann_whitney_less(np.arange(10.0), np.arange(10.0) + 5) < 0.01


def test_comparison_data_takes_all_cases(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((400, 1)) * 0.8 + 0.6 * rng.standard_normal((400, 5)), 1)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{k} double" for k in range(5)))
    a, b = (sorted(d.collect()) for d in (retention.comparison_data(spark, x, 2, 60, 2000, alpha=0.3), retention.comparison_data_of(df, 2, 60, 2000, alpha=0.3)))
    assert np.allclose([r.median_rmsr for r in a], [r.median_rmsr for r in b]) and [r.n_factors for r in b] == [1, 1]
    with pytest.raises(ValueError, match="missing"):
        retention.comparison_data_of(df.union(spark.sql("SELECT NULL, 0D, 0D, 0D, 0D")))


def test_comparison_query_takes_rows_not_means(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(k % 9, *x) for k, x in enumerate((rng.random((300, 4)) * 50).tolist())]
    spark.createDataFrame(rows, "l_suppkey int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, inner = [], retention.comparison
    monkeypatch.setattr(retention, "comparison", lambda *a: seen.append((a[1], *a[4:7])) or inner(*a))
    assert len(catalog.QUERIES["cd_profile"](spark, str(tmp_path)).collect()) == 2 and seen == [(300, 2, 500, 10_000)]


def test_drawn_counts_equal_drawn_cases():
    population, observed = np.random.default_rng(1).standard_normal((50, 4)), np.ones(4)
    times = np.random.default_rng(7).multinomial(200, np.full(50, 1 / 50))
    values = np.linalg.eigvalsh(np.corrcoef(np.repeat(population, times, axis=0).T))[::-1]
    assert abs(kernels.cd_misfit(population, observed, 200, np.random.default_rng(7)) - np.sqrt(((values - observed) ** 2).mean())) < 1e-12


def test_sequential_rule_stops():
    a = np.arange(40.0)
    assert [kernels.cd_factors(x, 0.3) for x in ([a], [a, a - 20], [a, a, a - 20], [a, a - 20, a - 20])] == [1, 2, 1, 2]


def test_depth_grid():
    assert len(retention.depth_grid(3, 4096)) == 148 and retention.depth_grid(3, 10, 4) == [3, 7, 10]


def test_pool_search_in_parts_equals_full_sort(spark):
    rng = np.random.default_rng(5)
    pool = spark.createDataFrame([(k, f"w{k}", f"f{k // 2}", k % 3 == 0, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(200)], "row long, word string, family string, tier1 boolean, v array<double>")
    target = spark.createDataFrame([("a", [1.0, 2.0, 0.0, 1.0]), ("b", [0.0, -1.0, 1.0, 1.0])], "target string, t array<double>")
    full = {}
    for r in naming.score_against(pool, target).collect():
        full.setdefault(r.target, []).append((-round(r.score, 9), r.row))
    for parts in (1, 4, 13):
        got = {}
        for r in naming.pool_topk(pool.repartition(parts), target, 30).collect():
            got.setdefault(r.target, []).append((r["rank"], r.row))
        for t in full:
            assert len(got[t]) == 30
            best = dict((row, s) for s, row in full[t])
            assert [best[row] for _, row in sorted(got[t])] == [s for s, _ in sorted(full[t])[:30]]


def test_collisions_are_settled():
    g = lambda *w: [{"word": x, "family": x[0], "tier1": x[0] == "c", "score": 1 - k / 10} for k, x in enumerate(w)]
    gates = {"p": g("aa", "bb", "cc"), "q": g("aa", "bb", "cc")}
    picks = {"p": dict(gates["p"][0], score=0.9), "q": dict(gates["q"][0], score=0.8)}
    out = naming.settle_collisions(picks, gates)
    assert out["p"]["word"] == "aa" and out["q"]["word"] == "cc" and out["q"]["collision_moved"]
    out = naming.settle_collisions({"p": gates["p"][0], "q": gates["q"][0]}, {"p": gates["p"][:1], "q": gates["q"][:1]})
    assert out["p"]["word"] == "aa" and (out["q"]["word"], out["q"]["rule"]) == (None, "exhausted")  # nothing is left: no label


def test_encoder_is_checked_and_cached(spark, tmp_path):
    t = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "text string")
    path = f"file://{tmp_path}/cache"
    calls = embedding.embed_cached(t, embedding.hashing_encoder(8), 8, "m", path)
    assert calls.count() == 4 and embedding.embed_cached(t, lambda x: 1 / 0, 8, "m", path).count() == 4
    assert embedding.clear_cache(spark, path)
    with pytest.raises(Exception, match="shape"):
        embedding.embed(t, lambda x: np.zeros((1, 3)), 8).collect()


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "x.npz", embeddings=np.eye(3), codes=np.array(["a", "b", "c"]))
    assert [r.code for r in load_npz(spark, str(tmp_path / "x.npz")).orderBy("ord").collect()] == ["a", "b", "c"]
    with pytest.raises(KeyError, match="no array"):
        load_npz(spark, str(tmp_path / "x.npz"), embeddings_key="other")


def test_maps_are_padded():
    assert kernels.pca(np.arange(6.0)[:, None]).shape == (6, 2)
    assert np.isfinite(kernels.mds(np.zeros((5, 5)))).all()
    assert kernels.tsne(np.random.default_rng(0).standard_normal((12, 3)), rounds=30).shape == (12, 2)
    assert medoids(similarity.unit(np.array([[1, 0], [0.9, 0.1], [0, 1.0]])), 2)[-1] == 2


def test_vetting_a_stream(spark, tmp_path):
    from facetlens.streaming.vetting import vet_stream

    m, f = planted(20, 16, 2)
    d = items(spark, m, f)
    labels = d.groupBy("factor").agg({"v": "first"}).toDF("construct", "w")
    spark.createDataFrame([(99, m[3].tolist())], "ord long, v array<double>").write.parquet(f"{tmp_path}/in")
    vet_stream(spark.readStream.schema("ord long, v array<double>").parquet(f"{tmp_path}/in"), d, labels, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert [r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["redundant"]
