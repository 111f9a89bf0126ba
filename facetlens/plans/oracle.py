"""SQL that gives what the queries of the catalogue give, written for the same tables."""

from __future__ import annotations

U = """u AS (
  SELECT vec_id AS ord, format('v{:04d}', vec_id) AS code, CAST(label AS VARCHAR) AS factor, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END AS scoring,
         embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings)"""
LONG = "l AS (SELECT ord, factor, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM u)"
SUMS = "g AS (SELECT factor, pos, sum(x / n) AS x, sum(x) AS raw, count(*) AS c FROM l GROUP BY ALL), s AS (SELECT factor, max(c) AS c, list(x ORDER BY pos) AS s, list(raw ORDER BY pos) AS raw FROM g GROUP BY factor)"
LABELS = "w AS (SELECT factor, arg_min(v, ord) AS w FROM u GROUP BY factor)"
LOADINGS = "f AS (SELECT ord, factor AS theoretical, unnest(v[1:5]) AS loading, generate_subscripts(v[1:5], 1) - 1 AS f_ord FROM u), fl AS (SELECT ord, theoretical, f_ord, 'F' || (f_ord + 1) AS factor, loading FROM f)"
LOO = """a AS (
  SELECT u.ord, u.factor, s.factor AS construct, s.c, list_dot_product(u.v, s.s) / u.n AS a, list_dot_product(s.s, s.s) AS ss FROM u, s
), anchor AS (
  SELECT ord, factor, construct, CASE WHEN factor = construct THEN CASE WHEN c > 1 THEN (a - 1) / sqrt(ss - 2 * a + 1) END ELSE a / sqrt(ss) END AS sim FROM a)"""


def encoded(kind: str) -> str:
    """e(ord, v): the vectors of an encoding, not yet of unit length."""
    if kind == "keyed":
        return "e AS (SELECT ord, list_transform(v, lambda x: x * scoring) AS v FROM u)"
    if kind == "pearson":
        return "e AS (SELECT ord, list_transform(v, lambda x: x - list_avg(v)) AS v FROM u)"
    if kind == "squid":
        return f"{LONG}, m AS (SELECT pos, avg(x) AS m FROM l GROUP BY pos), e AS (SELECT ord, list(x - m ORDER BY pos) AS v FROM l JOIN m USING (pos) GROUP BY ord)"
    return "e AS (SELECT ord, v FROM u)"


def pairs(kind: str = "atomic") -> str:
    return f"""{U}, {encoded(kind)}, en AS (SELECT ord, v, sqrt(list_dot_product(v, v)) AS n FROM e), p AS (
  SELECT a.ord AS i, b.ord AS j, list_dot_product(a.v, b.v) / (a.n * b.n) AS sim FROM en a JOIN en b ON a.ord < b.ord)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


CLUSTERS = """k AS (SELECT i AS a, j AS b FROM p WHERE abs(sim) >= 0.40 UNION SELECT j, i FROM p WHERE abs(sim) >= 0.40),
reach(item, other) AS (SELECT a, a FROM k UNION SELECT reach.item, k.b FROM reach JOIN k ON reach.other = k.a), clusters AS (SELECT item, min(other) AS cluster FROM reach GROUP BY item)"""
CENTRAL = "both_ways AS (SELECT i AS item, abs(sim) AS s FROM p UNION ALL SELECT j, abs(sim) FROM p), central AS (SELECT item, (sum(s) + 1) / (SELECT count(*) FROM u) AS centrality FROM both_ways GROUP BY item)"
RANGE = "SELECT '{0}' AS encoding, round(min(sim), 6) + 0.0 AS lowest, round(max(sim), 6) + 0.0 AS highest, round(avg(sim), 6) + 0.0 AS mean FROM (WITH {1} SELECT sim FROM p)"
CONTINGENCY = """t AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
a AS (SELECT lang, sum(n) AS n FROM t GROUP BY lang), b AS (SELECT source, sum(n) AS n FROM t GROUP BY source), z AS (SELECT sum(n) AS n FROM t)"""
EIGEN = f"""{U}, {LONG}, s2 AS (SELECT pos, var_pop(x) AS s2 FROM l GROUP BY pos), eigen AS (
  SELECT row_number() OVER (ORDER BY s2 DESC, pos) AS rank, s2 * (SELECT count(*) FROM s2) / (SELECT sum(s2) FROM s2) AS eig FROM s2),
ekc AS (SELECT rank, eig, greatest(pow(1 + sqrt(64.0 / (SELECT count(*) FROM u)), 2) * (64 - coalesce(sum(eig) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (64 - rank + 1), 1.0) AS ref FROM eigen)"""
TOPK = f"""{U}, {LONG}, {SUMS}, pool AS (SELECT ord AS row, 'w' || ord AS word, 'f' || (ord // 2) AS family, ord % 3 = 0 AS tier1, v, n FROM u),
sc AS (SELECT s.factor AS target, row, word, family, tier1, list_dot_product(v, raw) / (n * sqrt(list_dot_product(raw, raw))) AS score FROM pool, s),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, row) AS rank FROM sc) WHERE rank <= 400)"""
GATE = f"""{TOPK}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, family ORDER BY score DESC, row) AS k FROM top) WHERE k = 1),
gate AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, row) AS place FROM one) WHERE place <= 20)"""
SHORT = f"""{U}, {LONG}, {SUMS}, {LOO}, short AS (SELECT ord, factor, rank FROM (SELECT ord, factor, row_number() OVER (PARTITION BY factor ORDER BY sim DESC NULLS LAST, ord) AS rank FROM anchor WHERE factor = construct) WHERE rank <= 5)"""


def phi(part: str, name: str) -> str:
    return f"""{name}l AS (SELECT ord, unnest({part}) AS x, generate_subscripts({part}, 1) - 1 AS f FROM u), {name} AS (SELECT a.f AS f1, b.f AS f2, corr(a.x, b.x) AS r FROM {name}l a JOIN {name}l b USING (ord) GROUP BY ALL)"""


def halves(p: str, name: str) -> str:
    return f"""{name}k AS (SELECT sim, row_number() OVER (ORDER BY i, j) - 1 AS k FROM {p}), {name} AS (
  SELECT CASE WHEN count(*) < 2 THEN 1.0 ELSE 2 * corr(o, e) / (1 + corr(o, e)) END AS reliability
  FROM (SELECT max(CASE WHEN k % 2 = 0 THEN sim END) AS o, max(CASE WHEN k % 2 = 1 THEN sim END) AS e FROM {name}k GROUP BY k // 2) WHERE e IS NOT NULL)"""


def item_fit(name: str = "factor", sign: str = "") -> str:
    """Candidates are the ids divisible by 50, against all items but themselves; name: the construct's name from its factor, sign: - for reverse-keyed ones."""
    every = U.replace("u AS", "raw_items AS", 1) + f", every AS (SELECT * REPLACE ({name} AS factor) FROM raw_items), u AS (SELECT * FROM every), cand AS (SELECT * FROM every WHERE ord % 50 = 0)"
    return f"""WITH {every}, {LONG}, {SUMS}, {LABELS}, {LOO},
rest AS (SELECT cand.ord, u.factor, l.pos, sum(l.x / u.n) AS x FROM cand JOIN u ON u.ord <> cand.ord JOIN l ON l.ord = u.ord GROUP BY ALL),
c AS (SELECT ord, factor, list(x ORDER BY pos) AS c FROM rest GROUP BY ALL),
sims AS (SELECT cand.ord, c.factor AS construct, {sign}list_dot_product(v, w) / (cand.n * sqrt(list_dot_product(w, w))) AS sim_name, {sign}list_dot_product(v, c) / (cand.n * sqrt(list_dot_product(c, c))) AS sim_items FROM cand JOIN c USING (ord) JOIN w ON w.factor = c.factor),
rk AS (SELECT sims.*, row_number() OVER (PARTITION BY ord ORDER BY sim_items DESC, first) AS r FROM sims JOIN (SELECT factor AS construct, min(ord) AS first FROM u GROUP BY factor) USING (construct)),
b AS (SELECT x.ord, x.construct AS best, x.sim_name, x.sim_items, y.construct AS second, x.sim_items - y.sim_items AS gap FROM (SELECT * FROM rk WHERE r = 1) x LEFT JOIN (SELECT * FROM rk WHERE r = 2) y USING (ord)),
usual AS (SELECT factor AS best, avg(sim) AS usual FROM anchor WHERE factor = construct GROUP BY factor),
near AS (SELECT * FROM (SELECT cand.ord, u.ord AS nearest, {sign}list_dot_product(cand.v, u.v) / (cand.n * u.n) AS nearest_sim, row_number() OVER (PARTITION BY cand.ord ORDER BY {sign}list_dot_product(cand.v, u.v) / (cand.n * u.n) DESC, u.ord) AS r FROM cand JOIN u ON u.ord <> cand.ord) WHERE r = 1),
st AS (SELECT *, CASE WHEN usual IS NULL THEN 'about typical' WHEN sim_items >= usual + 0.05 THEN 'stronger than average' WHEN sim_items <= usual - 0.05 THEN 'weaker than average' ELSE 'about typical' END AS strength FROM b LEFT JOIN usual USING (best) JOIN near USING (ord))"""


ITEM_FIT = item_fit()
ITEM_FIT_COLUMNS = f"""ord, best, {r6('sim_name')} AS sim_name, {r6('sim_items')} AS sim_items, second, {r6('gap')} AS gap, strength, nearest, {r6('nearest_sim')} AS nearest_sim,
CASE WHEN nearest_sim >= 0.9 THEN 'redundant' WHEN strength = 'weaker than average' THEN 'weak' WHEN gap < 0.07 THEN 'cross-loads' ELSE 'good' END AS verdict"""
ORDERED = "b AS (SELECT factor, row_number() OVER (ORDER BY CASE factor WHEN '3' THEN 0 WHEN '1' THEN 1 ELSE 2 END, min(ord)) AS block FROM u GROUP BY factor), o AS (SELECT ord, factor, block, row_number() OVER (ORDER BY block, ord) AS place FROM u JOIN b USING (factor))"
AXES = f"""{U}, {LONG}, e AS (SELECT axis, pos, avg(x) FILTER (factor = lo) AS lo, avg(x) FILTER (factor = hi) AS hi FROM l, (VALUES ('first', '0', '1'), ('second', '2', '3')) t(axis, lo, hi) GROUP BY ALL),
x AS (SELECT axis, list(lo ORDER BY pos) AS lo, list(hi ORDER BY pos) AS hi, list(hi - lo ORDER BY pos) AS a FROM e GROUP BY axis),
y AS (SELECT axis, a, sqrt(list_dot_product(a, a)) AS an, list_dot_product(lo, a) / sqrt(list_dot_product(lo, lo) * list_dot_product(a, a)) AS p0, list_dot_product(hi, a) / sqrt(list_dot_product(hi, hi) * list_dot_product(a, a)) AS p1 FROM x),
scores AS (SELECT ord, axis, {r6('(list_dot_product(v, a) / (n * an) - p0) / (p1 - p0)')} AS score FROM u, y)"""
FLAGS = f"""{U}, {LONG}, {SUMS}, {LABELS}, z AS (SELECT factor, raw, w FROM s JOIN w USING (factor)),
d AS (SELECT a.factor AS scale_a, b.factor AS scale_b, list_dot_product(a.raw, b.raw) / sqrt(list_dot_product(a.raw, a.raw) * list_dot_product(b.raw, b.raw)) AS c, list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)) AS l FROM z a JOIN z b ON a.factor < b.factor),
fl AS (SELECT scale_a, scale_b, round(c, 3) AS content_sim, round(l, 3) AS label_sim, round(c - l, 3) AS divergence, CASE WHEN c - l >= 0.2 THEN 'jangle' WHEN c - l <= -0.2 THEN 'jingle' ELSE '-' END AS type FROM d)"""


SQL: dict[str, str] = {
    "unit_norms": f"WITH {U} SELECT ord, code, {r6('n')} AS norm FROM u",
    **{f"{k}_pairs": f"WITH {pairs(k)} SELECT i, j, {r6('sim')} AS sim FROM p" for k in ("atomic", "keyed", "squid", "pearson")},
    "encoding_ranges": " UNION ALL ".join(RANGE.format(k, pairs(k)) for k in ("atomic", "keyed", "squid", "pearson")),
    "redundant_pairs": f"WITH {pairs()} SELECT i, j, round(abs(sim), 3) AS overlap FROM p WHERE abs(sim) >= 0.40",
    "redundant_clusters": f"WITH RECURSIVE {pairs()}, {CLUSTERS} SELECT * FROM clusters",
    "centrality": f"WITH {pairs()}, {CENTRAL} SELECT item, {r6('centrality')} AS centrality FROM central",
    "suggest_remove": f"WITH RECURSIVE {pairs()}, {CLUSTERS}, {CENTRAL} SELECT cluster, item, row_number() OVER (PARTITION BY cluster ORDER BY centrality DESC, item) = 1 AS keep FROM clusters JOIN central USING (item)",
    "anchor_centroid_loo": f"WITH {U}, {LONG}, {SUMS}, {LOO} SELECT ord, factor, construct, {r6('sim')} AS sim FROM anchor",
    "anchor_label": f"WITH {U}, {LABELS} SELECT ord, u.factor, w.factor AS construct, {r6('list_dot_product(v, w) / (n * sqrt(list_dot_product(w, w)))')} AS sim FROM u, w",
    "weak_items": f"WITH {U}, {LONG}, {SUMS}, {LOO} SELECT ord, factor, {r6('sim')} AS own FROM anchor WHERE factor = construct ORDER BY sim NULLS LAST, ord LIMIT 8",
    "projection": f"""WITH {U}, {LONG}, q AS (SELECT pos, avg(x) FILTER (factor = '0') AS lo, avg(x) FILTER (factor = '1') AS hi FROM l GROUP BY pos),
x AS (SELECT list(lo ORDER BY pos) AS lo, list(hi ORDER BY pos) AS hi, list(hi - lo ORDER BY pos) AS a FROM q),
y AS (SELECT a, sqrt(list_dot_product(a, a)) AS an, list_dot_product(lo, a) / sqrt(list_dot_product(lo, lo) * list_dot_product(a, a)) AS p0, list_dot_product(hi, a) / sqrt(list_dot_product(hi, hi) * list_dot_product(a, a)) AS p1 FROM x)
SELECT ord, {r6('list_dot_product(v, a) / (n * an)')} AS projection, {r6('(list_dot_product(v, a) / (n * an) - p0) / (p1 - p0)')} AS scaled FROM u, y""",
    "jinglejangle_flags": f"""WITH {U}, {LONG}, {SUMS}, {LABELS}, z AS (SELECT factor, raw, w FROM s JOIN w USING (factor)),
d AS (SELECT a.factor AS scale_a, b.factor AS scale_b, list_dot_product(a.raw, b.raw) / sqrt(list_dot_product(a.raw, a.raw) * list_dot_product(b.raw, b.raw)) AS c, list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)) AS l FROM z a JOIN z b ON a.factor < b.factor)
SELECT scale_a, scale_b, round(c, 3) AS content_sim, round(l, 3) AS label_sim, round(c - l, 3) AS divergence, CASE WHEN c - l >= 0.2 THEN 'jangle' WHEN c - l <= -0.2 THEN 'jingle' ELSE '-' END AS type FROM d""",
    "item_fit_summary": f"{ITEM_FIT} SELECT {ITEM_FIT_COLUMNS} FROM st",
    "short_form_topn": f"WITH {SHORT} SELECT * FROM short",
    "short_form_dropped": f"WITH {SHORT} SELECT ord, factor FROM u WHERE ord NOT IN (SELECT ord FROM short)",
    "assign_items": f"WITH {U}, {LOADINGS} SELECT ord, factor, {r6('loading')} AS loading FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY abs(loading) DESC, f_ord) AS r FROM fl) WHERE r = 1",
    "contingency_nmi": f"""WITH {CONTINGENCY}, mi AS (SELECT sum(t.n / z.n * ln(t.n * z.n / (a.n * b.n))) AS mi FROM t JOIN a USING (lang) JOIN b USING (source), z),
ha AS (SELECT -sum(a.n / z.n * ln(a.n / z.n)) AS h FROM a, z), hb AS (SELECT -sum(b.n / z.n * ln(b.n / z.n)) AS h FROM b, z)
SELECT {r6('CASE WHEN ha.h > 0 AND hb.h > 0 THEN mi / sqrt(ha.h * hb.h) ELSE 0 END')} AS nmi FROM mi, ha, hb""",
    "contingency_ari": f"""WITH {CONTINGENCY}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS idx, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, (SELECT n * (n - 1) / 2 FROM z) AS tot)
SELECT {r6('(idx - sa * sb / tot) / ((sa + sb) / 2 - sa * sb / tot)')} AS ari FROM x""",
    "daal": f"WITH {U}, {LOADINGS} SELECT factor, theoretical, {r6('avg(abs(loading))')} AS daal FROM fl GROUP BY ALL",
    "omega": f"""WITH {U}, {LOADINGS}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY abs(loading) DESC, f_ord) AS r FROM fl) WHERE r = 1),
oa AS (SELECT factor, CASE WHEN count(*) >= 2 THEN pow(sum(abs(loading)), 2) / (pow(sum(abs(loading)), 2) + sum(1 - loading * loading)) END AS omega_assigned FROM own GROUP BY factor),
dl AS (SELECT factor, theoretical, avg(abs(loading)) AS d FROM fl GROUP BY ALL), mt AS (SELECT factor, theoretical FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY d DESC, theoretical) AS r FROM dl) WHERE r = 1),
ot AS (SELECT factor, theoretical, CASE WHEN count(*) >= 2 THEN pow(sum(abs(loading)), 2) / (pow(sum(abs(loading)), 2) + sum(1 - loading * loading)) END AS omega_theoretical FROM fl JOIN mt USING (factor, theoretical) GROUP BY ALL)
SELECT mt.factor, {r6('omega_assigned')} AS omega_assigned, mt.theoretical AS matched_theoretical, {r6('omega_theoretical')} AS omega_theoretical FROM mt LEFT JOIN oa USING (factor) LEFT JOIN ot USING (factor)""",
    "tucker_phi": f"""WITH {U}, a AS (SELECT ord, unnest(v[1:5]) AS x, generate_subscripts(v[1:5], 1) AS f FROM u), b AS (SELECT ord, unnest(v[6:10]) AS y, generate_subscripts(v[6:10], 1) AS g FROM u)
SELECT 'F' || f AS f1, 'F' || g AS f2, {r6('sum(x * y) / sqrt(sum(x * x) * sum(y * y))')} AS phi FROM a JOIN b USING (ord) GROUP BY f, g""",
    "frobenius_phi": f"WITH {U}, {phi('v[1:5]', 'pa')}, {phi('v[6:10]', 'pb')} SELECT {r6('sum(pa.r * pb.r) / sqrt(sum(pa.r * pa.r) * sum(pb.r * pb.r))')} AS frobenius FROM pa JOIN pb USING (f1, f2)",
    "split_half": f"WITH {pairs()}, {halves('p', 'h')} SELECT {r6('reliability')} AS reliability FROM h",
    "disattenuated": f"""WITH {pairs()}, pe AS (SELECT ord, list_transform(v, lambda x: x - list_avg(v)) AS v FROM u), pn AS (SELECT ord, v, sqrt(list_dot_product(v, v)) AS n FROM pe),
q AS (SELECT a.ord AS i, b.ord AS j, list_dot_product(a.v, b.v) / (a.n * b.n) AS sim FROM pn a JOIN pn b ON a.ord < b.ord), {halves('p', 'hx')}, {halves('q', 'hy')}, r AS (SELECT corr(p.sim, q.sim) AS r FROM p JOIN q USING (i, j))
SELECT {r6('r')} AS r, {r6('CASE WHEN hx.reliability > 0 AND hy.reliability > 0 THEN least(r / sqrt(hx.reliability * hy.reliability), 1.0) END')} AS disattenuated FROM r, hx, hy""",
    "consensus_mode": "SELECT n_chars % 7 + 1 AS n_factors, count(*) AS votes FROM documents WHERE n_chars IS NOT NULL GROUP BY 1 ORDER BY votes DESC, n_factors LIMIT 1",
    "ekc_references": f"WITH {EIGEN} SELECT rank, {r6('eig')} AS eig, {r6('ref')} AS ref FROM ekc",
    "sequential_rule": f"WITH {EIGEN} SELECT greatest(coalesce(min(CASE WHEN eig <= ref THEN rank END) - 1, max(rank)), 1) AS n_factors FROM ekc",
    "kaiser_count": f"WITH {EIGEN} SELECT greatest(count(*) FILTER (eig > 1), 1) AS n_factors FROM eigen",
    "tefi_partition": f"""WITH {pairs()}, c AS (SELECT i, j, abs(sim) AS a FROM p UNION ALL SELECT j, i, abs(sim) FROM p UNION ALL SELECT ord, ord, 1.0 FROM u),
k AS (SELECT factor, count(*) AS m FROM u GROUP BY factor), x AS (SELECT c.i, c.a, y.factor AS gi, z.factor AS gj, m FROM c JOIN u y ON y.ord = c.i JOIN u z ON z.ord = c.j JOIN k ON k.factor = y.factor),
tr AS (SELECT i, CASE WHEN count(*) FILTER (a = 0) = 0 THEN sum(a / (SELECT count(*) FROM u) * ln(a / (SELECT count(*) FROM u))) END AS t FROM x GROUP BY i), tt AS (SELECT -sum(t) AS total FROM tr),
gr AS (SELECT gi, i, CASE WHEN count(*) FILTER (a = 0) = 0 THEN sum(a / m * ln(a / m)) END AS t FROM x WHERE gi = gj GROUP BY gi, i), gg AS (SELECT gi, -sum(t) AS h FROM gr GROUP BY gi), ga AS (SELECT avg(h) AS mean, count(*) AS k FROM gg)
SELECT {r6('(mean - total) + (total - mean * k) * sqrt(k)')} AS tefi FROM ga, tt""",
    "rmsr_pairs": f"WITH {pairs()} SELECT {r6('sqrt(avg(pow(sim - list_dot_product(a.v[1:5], b.v[1:5]), 2)))')} AS rmsr FROM p JOIN u a ON a.ord = i JOIN u b ON b.ord = j",
    "minmax_composite": """WITH d AS (SELECT label AS depth, avg(abs(embedding[1]::DOUBLE)) AS nmi, avg(embedding[2]::DOUBLE) AS tefi FROM embeddings GROUP BY label),
e AS (SELECT *, (nmi - min(nmi) OVER ()) / (max(nmi) OVER () - min(nmi) OVER ()) AS nn, (tefi - min(tefi) OVER ()) / (max(tefi) OVER () - min(tefi) OVER ()) AS tn FROM d)
SELECT depth, round(nmi, 6) + 0.0 AS nmi, round(tefi, 6) + 0.0 AS tefi, round(nn, 6) + 0.0 AS nmi_norm, round(tn, 6) + 0.0 AS tefi_norm, round(0.7 * nn - 0.3 * tn, 6) + 0.0 AS composite FROM e""",
    "pool_topk": f"WITH {TOPK} SELECT target, row, word, family, tier1, {r6('score')} AS score, rank FROM top",
    "pool_gate": f"WITH {GATE} SELECT target, place, word, family, tier1, {r6('score')} AS score FROM gate",
    "pool_pick": f"""WITH {GATE}, tp AS (SELECT target, min(CASE WHEN tier1 AND place <= 5 THEN place END) AS tier_place FROM gate GROUP BY target)
SELECT target, word, family, {r6('score')} AS score, CASE WHEN tier_place IS NOT NULL THEN 'tier1' ELSE 'top1' END AS rule FROM gate JOIN tp USING (target) WHERE place = coalesce(tier_place, 1)""",
    "nli_signed_pairs": f"""WITH x AS (SELECT least(a.item_id, b.item_id) AS i, greatest(a.item_id, b.item_id) AS j, CASE WHEN left(a.text, 3) = left(b.text, 3) THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END - (length(a.text) % 7) / 10.0::DOUBLE AS s FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id)
SELECT i, j, {r6('avg(s)')} AS sim FROM x GROUP BY ALL""",
    "data_corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for k, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][k + 1 :]),
    "response_clean_reverse_score": "SELECT l_returnflag, q, 6 - q AS reversed, count(*) AS n FROM (SELECT l_returnflag, CAST(trunc(l_quantity) AS INTEGER) % 7 AS q FROM lineitem) WHERE q BETWEEN 1 AND 5 GROUP BY ALL",
    "corplot_order": f"""WITH {U}, b AS (SELECT factor, row_number() OVER (ORDER BY CASE factor WHEN '3' THEN 0 WHEN '1' THEN 1 ELSE 2 END, min(ord)) AS block FROM u GROUP BY factor)
SELECT ord, factor, block, row_number() OVER (ORDER BY block, ord) AS place FROM u JOIN b USING (factor)""",
    "null_percentiles": f"WITH {U}, {LONG} SELECT pos AS rank, {r6('quantile_cont(x, 0.95)')} AS q FROM l GROUP BY pos",
    "cd_improvement": """WITH m AS (SELECT label + 1 AS k, median(abs(embedding[1]::DOUBLE)) AS m FROM embeddings GROUP BY label)
SELECT k, round(m, 6) + 0.0 AS median_rmsr, round(m / first_value(m) OVER (ORDER BY k), 6) + 0.0 AS normalized, round((lag(m) OVER (ORDER BY k) - m) / lag(m) OVER (ORDER BY k), 6) + 0.0 AS improvement FROM m""",
    "heatmap": f"WITH {pairs()}, {ORDERED}, q AS (SELECT a.place AS p, b.place AS q, sim FROM p JOIN o a ON a.ord = i JOIN o b ON b.ord = j) SELECT p AS row, q AS col, {r6('sim')} AS sim FROM q UNION ALL SELECT q, p, {r6('sim')} FROM q UNION ALL SELECT place, place, 1.0::DOUBLE FROM o",
    "projection_axes": f"WITH {AXES} SELECT ord, axis, score FROM scores",
    "projection_ends": f"""WITH {AXES}, r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY score, ord) AS lo, row_number() OVER (PARTITION BY axis ORDER BY score DESC, ord) AS hi FROM scores)
SELECT axis, 'low' AS pole, lo AS place, ord, score FROM r WHERE lo <= 5 UNION ALL SELECT axis, 'high', hi, ord, score FROM r WHERE hi <= 5""",
    "flags_ordered": f"WITH {FLAGS} SELECT *, row_number() OVER (ORDER BY abs(divergence) DESC, scale_b, scale_a) AS place FROM fl",
    "pairs_ordered": f"WITH {pairs()}, r AS (SELECT i, j, round(abs(sim), 3) AS overlap FROM p WHERE abs(sim) >= 0.40) SELECT *, row_number() OVER (ORDER BY overlap DESC, j, i) AS place FROM r",
    "gap_bands": f"{ITEM_FIT} SELECT ord, {r6('gap')} AS gap, CASE WHEN gap >= 0.15 THEN 'discriminates well' WHEN gap >= 0.07 THEN 'some cross-loading risk' WHEN gap IS NOT NULL THEN 'ambiguous' END AS discrimination FROM st",
    "item_fit_reversed": f"""{item_fit("'Scale ' || factor", '-')} SELECT {ITEM_FIT_COLUMNS}, t.construct AS target, {r6('t.sim_items')} AS target_sim FROM st JOIN (SELECT ord, construct, sim_items FROM sims WHERE construct = 'Scale 3') t USING (ord)""".replace("round(sim_items, 6)", "round(st.sim_items, 6)"),
    "name_rules": "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9.]+', '-', 'g') AS slug, format('item_{:02d}', p_partkey) AS code, 'Instruct: Given a questionnaire item, retrieve the name of the psychological construct that the item measures' || chr(10) || 'Query: ' || p_name AS query FROM part",
    "like_codes": " UNION ALL ".join(f"SELECT bool_and(NOT regexp_matches({c}, '\\s') AND length({c}) <= 12) AS codes, '{c}' AS of FROM part" for c in ("p_name", "p_brand", "p_type")) + f" UNION ALL (WITH {U} SELECT bool_and(NOT regexp_matches(code, '\\s') AND length(code) <= 12), 'code' FROM u)",
    "generated_codes": """WITH f AS (SELECT DISTINCT c_mktsegment AS factor FROM customer WHERE c_mktsegment IS NOT NULL), c AS (SELECT factor, n, left(upper(factor), n) AS p FROM (SELECT factor, unnest(generate_series(1, length(factor))) AS n FROM f)),
a AS (SELECT p, min(factor) AS factor, min(n) AS n FROM c GROUP BY p HAVING count(*) = 1), s AS (SELECT factor, arg_min(p, n) AS p FROM a GROUP BY factor)
SELECT c_custkey AS ord, coalesce(p, upper(f.factor)) || row_number() OVER (PARTITION BY f.factor ORDER BY c_custkey) AS code FROM customer JOIN f ON c_mktsegment = f.factor LEFT JOIN s ON s.factor = f.factor""",
    "name_matches": """WITH w AS (SELECT lower(left(n_name, 2)) AS wanted FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT n_name || '?' FROM nation),
b AS (SELECT wanted, n_name, CASE WHEN wanted = n_name THEN 0 WHEN lower(wanted) = lower(n_name) THEN 1 WHEN n_name IS NOT NULL THEN 2 END AS kind FROM w LEFT JOIN (SELECT DISTINCT n_name FROM nation) ON starts_with(lower(n_name), lower(wanted))),
k AS (SELECT *, min(kind) OVER (PARTITION BY wanted) AS best FROM b)
SELECT wanted, CASE WHEN count(*) FILTER (kind = best) = 1 THEN min(n_name) FILTER (kind = best) END AS name, count(*) FILTER (kind = best) AS candidates FROM k GROUP BY wanted""",
    "pool_scan": f"""WITH {U}, q AS (SELECT ord AS row, 'w' || ord AS word, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM u WHERE ord >= 100 AND ord < 300),
d AS (SELECT row, word, list_transform(v, lambda x: round(x / CASE WHEN scale > 0 THEN scale ELSE 1 END) * scale) AS v FROM q)
SELECT row, word, round(v[1] / sqrt(list_dot_product(v, v)), 5) + 0.0 AS x0, round(v[2] / sqrt(list_dot_product(v, v)), 5) + 0.0 AS x1 FROM d""",
    "pool_lookup": "SELECT vec_id AS row, 'w' || vec_id AS word, 'f' || (vec_id // 2) AS family, vec_id % 3 = 0 AS tier1 FROM embeddings WHERE vec_id IN (SELECT n_nationkey FROM nation)",
    "family_lookup": "SELECT 'w' || (2 * a.vec_id) AS word, CASE WHEN b.vec_id IS NULL THEN 'w' || (2 * a.vec_id) ELSE 'f' || (b.vec_id // 2) END AS family FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = 2 * a.vec_id",
    "nli_ordered": f"SELECT a.item_id AS i, b.item_id AS j, {r6('CASE WHEN left(a.text, 3) = left(b.text, 3) THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END - (length(a.text) % 7) / 10.0::DOUBLE')} AS sim FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id",
    "responses_cleaned": "SELECT a, 6 - b AS b, count(*) AS n FROM (SELECT CAST(trunc(l_quantity) AS INTEGER) % 7 AS a, l_linenumber % 6 AS b FROM lineitem) WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5 GROUP BY ALL",
    "null_summary": " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg(x), 6) + 0.0 AS mean, round(quantile_cont(x, 0.05), 6) + 0.0 AS q05, round(quantile_cont(x, 0.95), 6) + 0.0 AS q95, count(*) AS n FROM (SELECT embedding[{k}]::DOUBLE AS x FROM embeddings)" for k, m in ((1, "rmsr"), (2, "caf"), (3, "tefi"))),
}
