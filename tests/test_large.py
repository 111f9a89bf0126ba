"""Item sets beyond the 5,000 items that a J x J matrix is allowed for."""

import time

import numpy as np
import pytest

from facetlens.operators import kernels, lowrank, partials, redundancy, retention, similarity
from facetlens.operators.fit import similarity_matrix
from facetlens.plans import catalog

N = 5100


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The folder, and the vectors in order."""
    rng = np.random.default_rng(21)
    m = rng.standard_normal((N, 12)) + 2 * rng.standard_normal((4, 12))[np.arange(N) % 4]
    path = str(tmp_path_factory.mktemp("large"))
    spark.createDataFrame([(k, v.tolist(), str(k % 4)) for k, v in enumerate(m)], "vec_id long, embedding array<double>, label string").repartition(8).write.parquet(f"{path}/embeddings.parquet")
    return path, m


def test_item_map_places_all_items(spark, large):
    got = {r.ord: (r.x, r.y) for r in catalog.QUERIES["item_map"](spark, large[0]).collect()}
    assert len(got) == N and np.allclose([got[k] for k in range(N)], kernels.pca(large[1]))


def test_parallel_analysis_has_all_ranks(spark, large):
    q = {r["rank"]: r.q for r in catalog.QUERIES["parallel_analysis"](spark, large[0]).collect()}
    x = [np.random.default_rng(42 + k).standard_normal((N, 12)) for k in range(100)]
    draws = np.array([np.linalg.eigvalsh(y.T @ y)[::-1] for y in (d / np.linalg.norm(d, axis=1, keepdims=True) for d in x)])
    assert sorted(q) == list(range(1, N + 1)) and np.allclose([q[k] for k in range(1, 13)], np.percentile(draws, 95, axis=0))
    assert not any(q[k] for k in range(13, N + 1))


def random_units(n=150, d=9):
    """Unit rows with copies and rows of zeros."""
    m = np.random.default_rng(4).standard_normal((n, d)) + 2 * np.random.default_rng(5).standard_normal((3, d))[np.arange(n) % 3]
    m[[7, 70]] = m[8]
    m[[5, 60]] = 0
    return similarity.unit(m), similarity_matrix(m, "atomic", np.ones(n))


def test_loadings_without_the_matrix_equal_those_with_it(spark, large):
    u, s = random_units()
    own, b = lowrank.repaired(u)
    r = kernels.psd_repair(s)
    assert np.allclose(np.diag(own) + b @ b.T, r, atol=1e-9)
    assert np.allclose(lowrank.minres(own, b, 3), kernels.minres(r, 3) * np.sign((lowrank.minres(own, b, 3) * kernels.minres(r, 3)).sum(axis=0)), atol=1e-6)
    assert np.allclose(lowrank.loadings(u, 3), kernels.oblimin(kernels.minres(r, 3))[0], atol=1e-4)
    rows = catalog.QUERIES["fit_loadings"](spark, large[0]).collect()
    assert len(rows) == 5 * N and {(r.factor, r.f_ord) for r in rows} == {(f"F{k + 1}", k) for k in range(5)} and all(np.isfinite(r.loading) for r in rows)
    assert all(r.code == f"v{r.ord:04d}" for r in rows)


def test_networks_without_the_matrix_equal_those_with_it(spark, large, tmp_path):
    for m in (random_units()[0], *(np.random.default_rng(9).standard_normal((n, 6)) for n in (1, 2, 4, 5, 40))):
        m = similarity.unit(m[np.unique(m, axis=0, return_index=True)[1]])
        s = similarity_matrix(m, "atomic", np.ones(len(m)))
        w = kernels.tmfg(s)
        i, j, x = lowrank.tmfg(m)
        net = np.zeros_like(s)
        net[i, j] = net[j, i] = x
        assert np.allclose(net, np.abs(w)) and (lowrank.walktrap(len(m), i, j, x) == kernels.walktrap(w)).all()
    star = np.zeros((90, 90))  # more edges than are added column by column
    star[0, 1:] = star[1:, 0] = 1 + np.arange(89) / 7
    star[range(1, 89), range(2, 90)] = star[range(2, 90), range(1, 89)] = 0.3
    i, j = np.nonzero(np.triu(star))
    assert (lowrank.walktrap(90, i, j, star[i, j]) == kernels.walktrap(star)).all()
    got = {r.ord: r.community for r in catalog.QUERIES["ega_communities"](spark, large[0]).collect()}
    assert len(got) == N and retention.nmi(np.array([got[k] for k in range(N)]), np.arange(N) % 4) > 0.1


def test_partials_without_the_matrix_equal_those_with_it(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((150, 9))
    copies = m.copy()
    copies[[7, 70, 71]] = copies[8]
    copies[60] = -copies[61]
    for x, zero in ((m, []), (copies, []), (m, [5, 60])):
        x[zero] = 0
        u = similarity.unit(x)
        for floor in (1e-2, 1e-3):  # high enough for the dense kernel to tell the components beyond the axes apart
            got = partials.profile(spark, u, floor, band=64, group=16)
            want = kernels.map_criterion(kernels.psd_repair(similarity_matrix(x, "atomic", np.ones(150)), floor))
            assert len(got) == len(want) == (9 if zero else 144 if x is copies else 148) and np.allclose(got, want, rtol=1e-5 if x is m else 1e-3, atol=0)
    for n, d in ((3, 2), (12, 3)):
        got = partials.profile(spark, similarity.unit(rng.standard_normal((n, d))), group=4)
        assert len(got) <= n - 2 and np.isfinite(got).all()


def test_tied_items_have_components_of_their_own(spark):
    m = np.concatenate([np.eye(3), -np.eye(3), np.eye(3), [[1, 2, 3], [3, 1, 2]], [[1, 1, 0], [1, -1, 0]]])
    x = partials.axes(similarity.unit(m), 1e-2)
    c = partials.components(x, [partials.roots(x.poles, x.rows, 0, len(x.poles) - 3)])
    w = c.of(x, slice(0, 13), slice(0, 10)) / np.sqrt(1 + 1e-2 * (c.pole + c.offset))
    assert np.allclose(w.T @ w, np.eye(10), atol=1e-9) and np.allclose(w.T @ x.w, 0, atol=1e-9)
    l = c.pole + c.offset
    assert np.allclose((w * x.p[:, None]).T @ w, np.diag(l), atol=1e-9)


def test_map_rule_takes_all_items(spark, tmp_path):
    """Over the limit of the dense kernel; copies of one vector, so that most components are of equal items and the profile soon ends."""
    m = np.repeat(np.random.default_rng(2).standard_normal((30, 4)), 171, axis=0)[:N]
    spark.createDataFrame([(k, v.tolist(), "f") for k, v in enumerate(m)], "vec_id long, embedding array<double>, label string").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.m: r.criterion for r in catalog.QUERIES["map_rule"](spark, str(tmp_path)).collect()}
    u = similarity.unit(m)
    values, vectors = np.linalg.eigh(u.T @ u)
    e = (u @ vectors[:, :2]) @ (u @ vectors[:, :2]).T  # after two components the rest of the four is all but the floor
    d = np.sqrt(np.diag(e))
    assert sorted(got) == list(range(1, len(got) + 1)) and len(got) > 40
    assert abs(got[2] - (((e / np.outer(d, d)) ** 2).sum() - N) / (N * (N - 1))) < 1e-4


def test_overlaps_by_components_equal_those_of_the_matrix(spark):
    for n, d in ((20, 9), (40, 60)):
        m = np.random.default_rng(6).standard_normal((n, d))
        m[3] = 0
        x, r = similarity.unit(m), kernels.psd_repair(similarity_matrix(m, "atomic", np.ones(n)))
        i, j, w = lowrank.ebic_glasso(*lowrank.repaired(x), 1200)
        net, want = np.zeros_like(r), kernels.ebic_glasso(r, 1200)
        net[i, j] = net[j, i] = w
        assert np.abs(net - want).max() < 2e-3 and len(i)
        rows = redundancy.network_overlaps(spark, i, j, w, [f"v{k:02d}" for k in range(len(r))], band=16).collect()
        overlap = np.abs(kernels.wto(net))
        assert len(rows) == len(r) * (len(r) - 1) // 2 and len({(q.a, q.b) for q in rows}) == len(rows)
        assert all(q.a < q.b and abs(q.overlap - overlap[int(q.a[1:]), int(q.b[1:])]) < 1e-12 for q in rows)
    assert redundancy.network_overlaps(spark, *lowrank.ebic_glasso(*lowrank.repaired(np.eye(3)), 1000), ["a", "b", "c"]).toPandas().overlap.tolist() == [0, 0, 0]


def test_graphical_lasso_settles_late():
    """Many items of few dimensions need more than a thousand rounds."""
    u = similarity.unit(np.random.default_rng(3).standard_normal((60, 3)))
    s = kernels.psd_repair(u @ u.T)
    x = kernels.graphical_lasso(s, 0.1)
    g = np.linalg.inv(x) - s
    assert np.abs(g).max() < 0.1 + 1e-3 and np.abs(g - 0.1 * np.sign(x))[x != 0].max() < 1e-3 and (x == 0).any()


def test_uva_takes_all_items(spark, tmp_path):
    """Over the limit of the dense kernel: 300 groups of 17 copies each, whose overlap has a closed form."""
    n, size = 5100, 17
    m = np.eye(300)[np.arange(n) % 300]
    spark.createDataFrame([(k, v.tolist(), "f") for k, v in enumerate(m)], "vec_id long, embedding array<double>, label string").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["uva_pairs"](spark, str(tmp_path)).cache()
    some = got.where("overlap > 1e-9").collect()
    assert got.count() == n * (n - 1) // 2 and len(some) == 300 * size * (size - 1) // 2
    r = (1 - 0.1) / (1 + 0.1)  # the smallest penalty: off the diagonal the similarity less the penalty, on it with the penalty
    a = r / (1 + (size - 2) * r)
    assert all(abs(q.overlap - ((size - 2) * a * a + a) / ((size - 1) * a + 1 - a)) < 1e-3 and (int(q.a[1:]) - int(q.b[1:])) % 300 == 0 for q in some)


def test_walks_stay_where_they_are_needed():
    """A chain of 4,000 triangles: walks over all of its 12,000 places for every one took 49 s of CPU, those near it take 9."""
    n = 12_000
    k = np.arange(0, n, 3)
    i, j = np.concatenate([k, k, k + 1, k[:-1] + 2]), np.concatenate([k + 1, k + 2, k + 2, k[1:]])
    began = time.process_time()
    c = lowrank.walktrap(n, i, j, np.concatenate([np.ones(n), np.full(len(k) - 1, 0.1)]))
    assert time.process_time() - began < 27
    assert (c.reshape(-1, 3) == c[::3, None]).all() and 50 < c.max() < 1000


def test_network_of_copies_equals_that_of_the_matrix():
    """Ties and items alike, more than are held for a face, and rows of zeros, which have no gain."""
    m = np.repeat(np.random.default_rng(11).integers(-1, 2, (40, 5)), 5, axis=0)
    u = similarity.unit(m.astype(float))
    i, j, w = lowrank.tmfg(u, chunk=32, spare=2, held=3)
    again = lowrank.tmfg(u, chunk=200, spare=64, held=200)
    assert all((x == y).all() for x, y in zip((i, j, w), again, strict=True))
    assert len(i) <= 3 * len(u) - 6 and np.allclose(w, np.abs((u[i] * u[j]).sum(axis=1)))
