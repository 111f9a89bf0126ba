"""The queries against plain Python over the whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from facetlens.llm import exchange, mixing, neardup, pages, pii, quality, sharding, substring_dedup, suffix_dedup, tokens
from facetlens.llm.queries import QUERIES, SQL
from facetlens.llm.shingles import shingle_set, sliding_min
from facetlens.llm.suffix_dedup import Family

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall())


def got(spark, sf, name, key="doc_id"):
    return {r[key]: r.asDict() for r in QUERIES[name](spark, sf).collect()}


def test_tokens(spark, sf, texts):
    from tokenizers import Tokenizer

    t, start, have = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, got(spark, sf, "op1_tokens")
    for d, x in texts.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert have[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


PIECES = ["a", "b", "The", "'s", "'re", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "\u2026", "\u00e9", "\u65e5\u672c", "1", "23", "\u00a0", "\x01", "<|endoftext|>", "<|", "\u3000", "\r\n", "'", "-", "\x1f", "\u200b", "\U0001f600", "x.", " \n", "\u00df", "$$$", "(", "\u00ff", "\u00d7", "\u024f", "\u0250"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    made, rng = tokens.Encoder(public_tokenizers.path(name)), np.random.default_rng(8)
    some = ["".join(rng.choice(PIECES if rng.random() < 0.3 else ["foo", "bar", " ", "a", ".", "\n", ","]) for _ in range(rng.integers(0, 25))) for _ in range(4000)]
    assert [x.tolist() for x in made.batch(some)] == [x.tolist() for x in made.library(some)]


def test_suffix(spark, sf, texts):
    have, raw = got(spark, sf, "op2_suffix"), {d: (x or "").encode() for d, x in texts.items()}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert have[d] == {"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": len(re.findall(b"\1+", bytes(gone))), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def family_of(batches):
    f, all_strings = Family(), []
    for texts in batches:
        size = np.array([len(t) - 199 for t in texts])
        begin = np.cumsum(size + 199) - (size + 199)
        at = np.concatenate([b + np.arange(n) for b, n in zip(begin, size)])
        f.add(np.frombuffer(b"".join(texts), np.uint8), at, np.zeros(len(at), bool))
        all_strings += [t[i : i + 200] for t, n in zip(texts, size) for i in range(n)]
    return f, all_strings


def test_family_is_logarithmic_and_finds_all():
    rng = np.random.default_rng(0)
    pool = [rng.choice([0, 97, 98, 255], 260, p=[0.1, 0.4, 0.4, 0.1]).astype(np.uint8).tobytes() for _ in range(40)] + [b"a" * 400, b"\0" * 400, b"ab" * 200]
    cut = lambda t: t[rng.integers(0, 30) : len(t) - rng.integers(0, 30)]
    prefix = [b"same beginning of one hundred and ninety-two bytes".ljust(192, b".") + rng.integers(97, 100, 40).astype(np.uint8).tobytes() for _ in range(30)]
    batches = [[cut(pool[k]) if k < len(pool) else prefix[k - len(pool)] for k in rng.integers(0, len(pool) + len(prefix), 3)] for _ in range(20)]
    f, strings = family_of(batches)
    seen = Counter(strings)
    assert np.concatenate(f.marks).tolist() == [seen[x] > 1 for x in strings]
    assert len(f.levels) <= 12 and sum(len(x.at) for x in f.levels) == len(seen)
    for level in f.levels:
        own = [level.text[a : a + 200].tobytes() for a in level.at.tolist()]
        assert own == sorted(set(own))


def in_process(folder, some, make, answer):
    """A round of questions and answers without a cluster."""
    packs, out = defaultdict(list), defaultdict(list)
    for block, rows, ids, raw in some:
        for bucket, data in make(block, rows, ids, raw, 3):
            packs[bucket].append((block, data))
    for bucket, own in packs.items():
        for block, data in answer(bucket, sorted(own)):
            out[block].append(data)
    folder.mkdir()
    for block, own in out.items():
        (folder / exchange.side_name(block)).write_bytes(b"".join(map(exchange.parts, own)))
    return f"file://{folder}"


def test_hash_collisions_remove_nothing(texts, monkeypatch, tmp_path):
    """With hashes of four bits all candidates collide; bytes and words decide."""
    some = [(f"b{k // 40}", np.arange(k, k + 20), list(range(k, k + 20)), [(x or "").encode() for x in list(texts.values())[k : k + 20]]) for k in range(0, 120, 20)]

    def flagged(name):
        a = in_process(tmp_path / f"{name}1", some, suffix_dedup.minimisers, suffix_dedup.repeated)
        a = in_process(tmp_path / f"{name}2", some, suffix_dedup.segments(a), suffix_dedup.matched())
        b = in_process(tmp_path / f"{name}3", some, substring_dedup.probes, substring_dedup.hits)
        b = in_process(tmp_path / f"{name}4", some, substring_dedup.extend(b), substring_dedup.firsts)
        return [sorted(exchange.marked(exchange.Side(x).of(block), rows, np.arange(len(rows)) * 10**6).tolist()) for x in (a, b) for block, rows, _, _ in some]

    want = flagged("whole")
    for module in (suffix_dedup, substring_dedup):
        monkeypatch.setattr(module, "LOW", np.uint64(15))
        monkeypatch.setattr(module, "mixed", lambda h: h & np.uint64(0x3F))
    assert any(want) and want == flagged("few")


def test_second_batch_meets_the_index(spark, texts, tmp_path):
    old, new = list(texts.items())[:60], list(texts.items())[60:140]
    index = f"file://{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.n_removed for r in suffix_dedup.remove_duplicates(frame(old), index).collect()}
    second = {r.doc_id: r.n_removed for r in suffix_dedup.remove_duplicates(frame(new), index).collect()}
    assert first == {r.doc_id: r.n_removed for r in suffix_dedup.remove_duplicates(frame(old)).collect()}
    both = {r.doc_id: r.n_removed for r in suffix_dedup.remove_duplicates(frame(old + new)).collect()}
    alone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_duplicates(frame(new)).collect()}
    assert second == {d: both[d] for d, _ in new} != alone


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]


def test_substring(spark, sf, texts):
    have, words, first = got(spark, sf, "op8_substring"), {d: WORD.findall(x or "") for d, x in texts.items()}, {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert have[d] == {"doc_id": d, "n_words": len(w), "n_removed": sum(gone), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()}


def test_mixing(spark, sf, texts):
    have = got(spark, sf, "op3_mixing")
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{sf}/documents.parquet'").fetchall())
    size = {d: len(WORD.findall(x or "")) for d, x in texts.items()}
    total = Counter()
    for d in texts:
        total[source[d]] += size[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets(np.array([total[s] for s in names]), np.array([(3, 1, 2)[k % 3] for k in range(len(names))], float), 1.5 * sum(total.values()))))
    assert abs(sum(goal.values()) - 1.5 * sum(total.values())) < 1e-6 * sum(total.values())
    taken = Counter()
    for d, r in have.items():
        assert (r["size"], r["source_size"]) == (size[d], total[source[d]]) and abs(r["target"] - goal[source[d]]) < 1e-6
        assert r["taken"] in (0, size[d], 2 * size[d])
        taken[source[d]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(50, 0.01 * goal[s]) for s in names)


def test_knapsack_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(40):
        l, c = np.unique(rng.integers(1, 30, 4)), None
        c = rng.integers(0, 4, len(l))
        budget = int(rng.integers(1, 60))
        sums = {0}
        for a, n in zip(l, c):
            sums = {s + k * int(a) for s in sums for k in range(n + 1)}
        out = mixing.knapsack(l, c, budget)
        assert (out <= c).all() and abs((l * out).sum() - budget) == min(abs(s - budget) for s in sums)


def test_knapsack_of_widely_spread_lengths():
    assert mixing.knapsack(np.array([2, 1000]), np.array([1, 1]), 900).tolist() == [0, 1]
    assert mixing.fit_counts(np.array([2, 1000]), np.array([1, 1]), 900.0)[1].tolist() == [0, 1]
    rng = np.random.default_rng(12)
    for _ in range(200):
        l = np.unique((10 ** rng.uniform(0, 4, 5)).astype(np.int64))
        c = rng.integers(0, 3, len(l))
        budget = int(10 ** rng.uniform(0, 4))
        sums = {0}
        for a, n in zip(l, c):
            sums = {s + k * int(a) for s in sums for k in range(n + 1)}
        out = mixing.knapsack(l, c, budget)
        assert (out <= c).all() and abs((l * out).sum() - budget) == min(abs(s - budget) for s in sums)


def test_decontamination_equals_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(SQL["op4_decontaminate"])
    names = [x[0] for x in r.description]
    want = {x[0]: dict(zip(names, x)) for x in r.fetchall()}
    assert got(spark, sf, "op4_decontaminate") == want and any(x["contaminated"] for x in want.values())


def test_sharding(spark, sf, texts):
    have = got(spark, sf, "op5_sharding")
    per, group = Counter(), defaultdict(set)
    for d, r in have.items():
        raw = (texts[d] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        per[r["shard"]] += r["size"]
        group[texts[d]].add(r["shard"])
    assert all(len(s) == 1 for s in group.values())
    mean, largest = sum(per.values()) / 16, max(r["size"] for r in have.values())
    assert all(abs(n - mean) <= 1.5 * largest for n in per.values())
    for s in range(16):
        own = sorted(r["slot"] for r in have.values() if r["shard"] == s)
        assert own == list(range(len(own)))


def test_hilbert_steps_to_neighbours():
    p = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = p[np.argsort(sharding.hilbert_index(p, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pages(spark, sf):
    from html import unescape

    have = got(spark, sf, "op7_pages", "page_id")
    for p, h in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", a))
        text = "\n".join(b for b in blocks if b)
        assert (have[p]["text"], have[p]["n_chars"]) == (text, len(text))


def by_the_letter(text):
    """Base spans straight from the rules."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (pii.BASE.index(s[0]), s[1]))


def test_personal_data(spark, sf, texts):
    have = got(spark, sf, "op6_pii")
    for d, x in texts.items():
        base = by_the_letter(x or "")
        row = have[d]
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        spans = row["spans"].split(",") if row["spans"] else []
        assert row["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(spans) and row["n_spans"] == len(spans)
        tokens_in = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', x or "")]
        assert {f"secret:{a}:{b}" for a, b in tokens_in} <= set(spans)
    clean = [d for d, x in texts.items() if not re.search("[0-9@]", x or "")]
    assert clean and all(have[d]["spans"] == "" for d in clean)


def test_base_rules_on_random_strings():
    rng = np.random.default_rng(13)
    for _ in range(4000):
        t = "".join(rng.choice(list("0123456789") + ["1", "4111 1111 1111 1111", ".", ".", "-", " ", "+1", "(", ")", "a", "@", "b.c", "%", "10.0.0.1", "x"], rng.integers(1, 20)))
        assert sorted(pii.base_spans(t), key=lambda s: (pii.BASE.index(s[0]), s[1])) == by_the_letter(t)


def held_out_pages(sf):
    """Weights fitted on pages of other ids, and pages to look at: (html, main text)."""
    from html import unescape

    rows = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet' ORDER BY page_id").fetchall()
    seen = [(pages.text_features(b), int(b.place == pages.SURE)) for p, h in rows if p % 2 for b in pages.blocks_of(h) if b.place in (pages.SURE, pages.BOILER_SURE)]
    clean = lambda b: " ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split())
    return pages.fit_weights(seen), [(h, [x for b in re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", h, re.S)[1]) if (x := clean(b))]) for p, h in rows if not p % 2]


def test_cut_overrules_misleading_names(sf):
    weights, some = held_out_pages(sf)
    right = flipped = total = flags = 0
    for h, want in some:
        h = h.replace("<article>", '<div class="related-work">').replace("</article>", "</div>")
        blocks = pages.blocks_of(h)
        got = pages.main_blocks(blocks, weights)
        own = [np.clip(np.dot(pages.text_features(b), weights), pages.LOW, pages.HIGH) + b.place > 0 for b in blocks]
        flipped += sum((b in got) != o for b, o in zip(blocks, own))
        right += sum((b in got) == (b.text in want) for b in blocks)
        flags += sum((b.place > 0) == (b.text in want) for b in blocks)
        total += len(blocks)
    assert flipped > 0 and right > 0.95 * total > flags


def test_adverts_inside_articles_go(sf):
    weights, some = held_out_pages(sf)
    for h, want in some:
        ad = re.search(r'<div class="ad">.*?</div>', h, re.S)[0]
        h = h.replace(ad, "", 1)
        k = [m.end() for m in re.finditer("</p>", h[: h.index("</article>")])]
        at = k[len(k) // 2] if k else h.index("</article>")
        assert pages.main_text(h[:at] + ad + h[at:], weights).split("\n") == want


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = 6
        score, edges = rng.normal(0, 2, n).tolist(), [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda s: sum(max(0, x) * (not k) + max(0, -x) * k for x, k in zip(score, s)) + sum(c for a, b, c in edges if s[a] != s[b])
        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(cost(pages.cut(score, edges)) - best) < 1e-6


def links(sets, percent):
    post, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        both = Counter(o for s in sets[d] for o in post[s])
        for s in sets[d]:
            post[s].append(d)
        for o, k in both.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def test_neardup(spark, sf, texts):
    sets = {}
    for d, x in texts.items():
        w = WORD.findall((x or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = links(sets, 85)
    assert got(spark, sf, "op9_neardup") == {d: {"doc_id": d, "n_shingles": len(s), "component_id": want[d], "kept": want[d] == d} for d, s in sets.items()}


def test_neardup_of_large_groups(spark, monkeypatch):
    """Groups beyond a node and a block, of texts that drift, so that a group isn't like its leader throughout."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng, rows = np.random.default_rng(4), []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(150)]
        for k in range(150):
            if k % 3 == 0:
                words = list(words)
                words[int(rng.integers(150))] = f"n{g}_{k}"
            own = list(words)
            own[int(rng.integers(150))] = f"x{g}_{k}"
            rows.append((len(rows), " ".join(own)))
    have = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert have == links({d: set(shingle_set(t).tolist()) for d, t in rows}, 85)


def test_quality(spark, sf, texts):
    have = got(spark, sf, "op10_quality")
    for d, x in texts.items():
        w, seen, dup = WORD.findall(x or ""), set(), 0
        for line in (x or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        r = have[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), dup, len(rep), failed)
        assert not (failed and r["kept"])


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    have = got(spark, sf, "op10_quality")
    lab = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    good = [have[d]["kept"] for d, q in lab if q == 1 and not have[d]["base_failed"]]
    bad = [have[d]["kept"] for d, q in lab if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_trees_keep_their_order():
    rng = np.random.default_rng(6)
    x = rng.random((800, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.2)).astype(float)
    t = quality.grow(x, y, np.array([-1, 0]), trees=20)
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3)])
    assert (np.diff(t.raw(grid)) <= 1e-12).all() and ((t.raw(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.9


def test_pipeline(spark, sf, texts):
    out = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    kept = {r["doc_id"] for r in out}
    assert kept and all(r["text"] == texts[r["doc_id"]] for r in out)
    scored, dirty = got(spark, sf, "op10_quality"), got(spark, sf, "op4_decontaminate")
    assert all(scored[d]["kept"] and not dirty[d]["contaminated"] for d in kept)
    assert max(Counter(r["doc_id"] for r in out).values()) <= 2
    comp = {d: r["component_id"] for d, r in got(spark, sf, "op9_neardup").items()}
    assert len({comp[d] for d in kept}) == len(kept)
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
