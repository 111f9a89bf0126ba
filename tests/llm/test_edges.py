"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from facetlens.llm import decontaminate, mixing, neardup, pages, pii, quality, sharding, substring_dedup, suffix_dedup, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot int, node long, id long, label string, bucket int, target double, shard int, n long, kept boolean"
TAIL = (7, 1, 2, 3, "x", 4, 5.0, 6, 7, False)
LONG = " ".join(f"w{k}" for k in range(60_000))
SAME = " ".join(f"s{k}" for k in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, None, "en", "a"), (1, "", None, "a"), (2, " \n\t ", "en", None), (3, "one two", "en", "b"), (4, SAME, "en", "a"), (5, SAME, "de", "b"), (6, SAME + " more", "en", None), (7, LONG, "en", "a"), (8, "same row", "en", "a"), (8, "same row", "en", "a"), (None, "no id at all", "en", "a"), (9, "é日本 \U0001f600 <|endoftext|>  x", "fr", "c"), (10, "aaaa" * 200, "en", "c")]
    return spark.createDataFrame([(d, t, lang, s, len(t) if t else None, *TAIL) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "One  TWO"), (1, None), (2, ""), (None, "same row"), (3, " ".join(f"s{k}" for k in range(30))), (3, "one two")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, None), (4, 1, 0), (3, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")


def rows(df):
    return df.collect()


def test_tokens(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokens.write_records(docs, path)
    got = sorted(rows(tokens.read_records(files)), key=lambda r: r.start)
    assert len(got) == 13 and got[0].doc_id is None
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(13)]
    assert [r.n_tokens for r in got if r.doc_id in (0, 1)] == [1, 1]
    whole = {r.doc_id: r.ids for r in rows(tokens.read_records(files, digest=False))}
    name = files.where("n_records > 1").first().path
    shard = tokens.Shard(name)
    for k in reversed(range(len(shard))):
        doc, ids = shard[k]
        assert doc is None or ids.tolist() == whole[doc]
    assert rows(tokens.read_records(tokens.write_records(none, path))) == []


def test_hot_ids_are_dealt_over_several_shards(spark):
    data = [(None, f"no id {k}") for k in range(60)] + [(5, f"five {k}") for k in range(60)] + [(k, f"t {k}") for k in range(6, 66)]
    files = tokens.write_records(spark.createDataFrame(data, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    assert max(r.n_records for r in rows(files)) < 50
    got = sorted(rows(tokens.read_records(files)), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in data]


def test_corrupt_record_is_seen(tmp_path):
    p = tmp_path / "x.rec"
    data = bytearray(tokens.MAGIC + b"\x02" + tokens.frame(b"\x01" + bytes(8) + b"\x05\x00"))
    p.write_bytes(bytes(data))
    assert [ids.tolist() for _, ids in tokens.records_of(str(p))] == [[5]]
    data[-6] ^= 1
    p.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="corrupt"):
        list(tokens.records_of(str(p)))


def test_suffix(docs, none):
    got = {r.doc_id: r for r in rows(suffix_dedup.remove_duplicates(docs))}
    assert (got[0].n_bytes, got[0].n_removed, got[0].n_spans) == (0, 0, 0)
    assert got[4].n_removed == got[4].n_bytes and got[6].n_removed == len(SAME)
    assert got[10].n_removed == 800 and got[10].n_spans == 1 and got[7].n_removed == 0
    assert rows(suffix_dedup.remove_duplicates(none)) == []


def test_substring(docs, none):
    got = {r.doc_id: r for r in rows(substring_dedup.remove_repeats(docs))}
    assert got[4].n_removed == 0 and got[5].n_removed == 120 and got[6].n_removed == 120 and got[6].kept == "more"
    assert got[0].n_words == 0 and got[7].n_words == 60_000 and None in got
    assert rows(substring_dedup.remove_repeats(none)) == []


def test_mixing(docs, none):
    got = rows(mixing.mix_plan(docs))
    assert len(got) == 13
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sum(x["size"] for x in own) for r in own)
        assert all(0 <= r.taken <= 2 * r["size"] for r in own) and all(r.target <= 2 * r.source_size + 1e-9 for r in own)
    assert sorted(rows(mixing.mix_plan(docs)), key=str) == sorted(got, key=str)
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns and rows(mixing.mix_plan(none)) == [] and rows(mixing.mix(none)) == []
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.times
    found = {}
    for r in rows(copies):
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {d: n for d, n in taken.items() if n}


def test_decontamination(docs, none, items):
    got = {r.doc_id: r for r in rows(decontaminate.contamination(docs, items))}
    assert (got[3].n_hit, got[3].n_items, got[3]["items"]) == (2, 2, ["0", "3"])
    assert got[4].n_hit == 30 and got[8].n_hit == 0 and not got[0].contaminated and got[0].n_words == 0
    assert rows(decontaminate.contamination(none, items)) == []
    assert not any(r.contaminated for r in rows(decontaminate.contamination(docs, items.limit(0))))
    assert {r.doc_id for r in rows(decontaminate.decontaminate(docs, items))} == {0, 1, 2, 7, 8, 9, 10, None}


def test_several_blocks_of_items_give_what_one_gives(spark, docs, items, monkeypatch):
    long = spark.createDataFrame([(7, " ".join(f"s{k}" for k in range(20, 110))), (8, "same row")], "item_id long, text string")
    both = items.unionByName(long)
    want = [sorted(rows(f(docs, both)), key=str) for f in (decontaminate.contamination, decontaminate.decontaminate)]
    monkeypatch.setattr(decontaminate, "WORD_BYTES", decontaminate.TABLE_BYTES // 30)
    blocks = list(decontaminate.item_blocks(both))
    assert len(blocks) > 3 and all(sum(t.count(" ") + 1 for _, t in b) <= 30 for b in blocks)
    assert want == [sorted(rows(f(docs, both)), key=str) for f in (decontaminate.contamination, decontaminate.decontaminate)]


def test_pieces_hold_every_window_once():
    for n in (1, 9, 10, 11, 25, 60):
        words = [f"w{k}" for k in range(n)]
        got = [tuple(p.split()[k : k + min(10, n)]) for p in decontaminate.pieces(" ".join(words), 10, 20) for k in range(len(p.split()) - min(10, n) + 1)]
        assert got == [tuple(words[k : k + min(10, n)]) for k in range(n - min(10, n) + 1)]


def test_files_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} " + "x" * (k % 50 * 20), ("en", "de", None)[k % 3], ("a", "b", "c", "web", None)[k % 5]) for k in range(2000)], "doc_id long, text string, lang string, source string")
    index = sharding.write_shards(df, f"file://{tmp_path}/out")
    assert index.agg({"n_rows": "sum"}).first()[0] == 2000
    for want in ({"source": "web"}, {"lang": "de"}, {"source": "a", "lang": "en", "least": 300, "most": 500}, {"source": "none"}):
        meet = sharding.meeting_files(index, **want).count()
        got = sharding.read_shards(spark, f"file://{tmp_path}/out", **want)
        size = lambda r: len(r.text) + 1
        ok = lambda r: all(getattr(r, c) == want[c] for c in ("source", "lang") if c in want) and want.get("least", 0) <= size(r) <= want.get("most", 10**9)
        assert meet < 0.7 * index.count() and sorted(r.doc_id for r in rows(got)) == [r.doc_id for r in rows(df) if ok(r)]


def test_names_sort_as_their_codes(spark):
    names = ["", "a", "ab", "b", "Z", "\u00e9", "\U0001f600", "abcdefgh", "abcdefg"]
    got = rows(spark.createDataFrame([(n,) for n in names], "n string").select("n", sharding.name_code("n").alias("c")))
    assert [r.c for r in sorted(got, key=lambda r: r.n.encode())] == sorted(r.c for r in got) and all(r.c >= 0 for r in got)


def test_one_id_of_a_large_group_is_divided(spark):
    df = spark.createDataFrame([(1 if k % 2 else None, "same text", "en", "a") for k in range(400)] + [(k, f"other {k}", "en", "a") for k in range(400)], "doc_id long, text string, lang string, source string")
    per = {}
    for r in rows(sharding.shard_plan(df, 4)):
        per[r.shard] = per.get(r.shard, 0) + r["size"]
    assert len(per) == 4 and max(per.values()) < 1.15 * min(per.values())


def test_working_tables_are_removed(spark, docs):
    from facetlens.llm import common

    at = common.written(docs, "gone").inputFiles()
    assert at and common.clean_up(spark) > 0 and common.clean_up(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(at[0])


def test_sharding(docs, none):
    got = rows(sharding.shard_plan(docs, 4))
    assert len(got) == 13
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r["size"]: r.text_crc32 for r in got if r.doc_id in (0, 1)} == {1: 0}
    assert len({r.shard for r in got if r.doc_id in (4, 5)}) == 1 and len({r.shard for r in got if r.doc_id == 8}) == 1
    assert rows(sharding.shard_plan(none)) == [] and rows(sharding.shard(none)) == []
    assert sorted(sharding.shard(docs).columns) == sorted([*docs.columns, "hilbert"])


def test_pii(docs, none, spark):
    got = {r.doc_id: r for r in rows(pii.find_personal(docs))}
    assert got[0].spans == "" and got[0].n_email == 0
    assert rows(pii.find_personal(none)) == []
    text = "mail a.b@c.de, ip 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, +1 (555) 010-9999 @ x@y"
    assert pii.joined(sorted(pii.base_spans(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))) == "email:5:13,ip:33:42,card:49:68,phone:70:87"
    assert list(pii.emails("a" * 50_000 + "@")) == []


CREDENTIALS = ("password", "PASSWD", "pwd", "passphrase", "token", "secret", "apikey", "api_key", "api-key", "access_key", "accesskey", "auth")


@pytest.mark.parametrize("text", ["write to jane.doe (at) mail (dot) org", "jane [ AT ] mail.org", "x" * 500 + " [at] " + "y" * 300 + ".org", "a" * 200 + "7" + "b" * 200, *(f"{n}: abcdefgh" for n in CREDENTIALS)])
def test_every_candidate_is_judged(text):
    assert pii.candidates(text, []) and [s for s, _ in pii.judged(text)] == pii.candidates(text, [])


@pytest.fixture(scope="module")
def weights():
    """Of a corpus without negative examples: card numbers, addresses and tokens, as in the tables."""
    some = [f"mail a{k}.b@c.de from 10.0.0.{k}, token = \"{k:02d}4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e\" +1 (555) 010-99{k:02d}" for k in range(60)]
    rows = [([pii.KINDS.index(s[0]), *v], pii.features(t, s, v)) for t in some for s, v in pii.judged(t)]
    return pii.classifier(rows, pii.em([r[0] for r in rows])[1])


@pytest.mark.parametrize("text", ["call me at 555 867 5309 today, phone", "my ssn 123-45-6789 ok", "john [at] mail [dot] com 1", "my pwd: correcthorsebattery", "john.doe [at] example [dot] com", "password = Tr0ub4dor&3x", "api_key=sk_live_51H8abcDEF123456", "IBAN DE89 3704 0044 0532 0130 00", "tel 030 1234 5678"])
def test_personal_spans_are_found(text, weights):
    assert len(pii.all_spans(text, weights)[1]) == 1


@pytest.mark.parametrize("text", ["ISBN 978-3-16-148410-0 here", "no 978 3 16 148410 0", "version 10.12.33 of", "on 2020-01-02 we", "12.05.2019 war", "token: required", "password: changeme", "secret: none", "DE88 3704 0044 0532 0130 00", "pages 123-456", "in 1999-2003", "some_function_name_v2_final", "figure 12 34"])
def test_others_are_not(text, weights):
    assert pii.all_spans(text, weights)[1] == []


def test_em_measures_labelers():
    rng = np.random.default_rng(11)
    truth = rng.random(6000) < 0.3
    kind = np.where(np.arange(6000) < 1000, 0, 4)  # base spans are personal
    truth[:1000] = True
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.85, 0.95])
    said = np.where(rng.random((6000, 8)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((6000, 8)) < 0.7)
    post, model = pii.em(np.column_stack([kind, said]))
    assert np.abs(model["hit"] - right).max() < 0.06 and np.abs(model["miss"] - right).max() < 0.06
    assert ((post > 0.5) == truth).mean() > 0.95 and abs(model["share"][4] - 0.3) < 0.03


def test_em_sees_all_documents(spark, monkeypatch):
    texts = [f"mail a{k}.b@c.de, password: x{k}y9z8w7v6u5t4, page 12 34" for k in range(30)] + [None, "", "passphrase: abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = [[pii.KINDS.index(s[0]), *v] for t in texts for s, v in pii.judged(t)]
    seen, inner = [], pii.em
    monkeypatch.setattr(pii, "em", lambda table, times: seen.append((table, times)) or inner(table, times))
    assert pii.fit(df, max_docs=2) is not None
    table, times = seen[0]
    assert sorted(np.repeat(table, times, axis=0).tolist()) == sorted(want)
    post, model = inner(table, times)
    each, same = inner(np.array(want))
    assert all(np.allclose(model[k], same[k]) for k in model) and np.allclose(np.repeat(post, times), [p for _, p in sorted(zip(want, each.tolist()))])
    assert all(p > 0.9 for r, p in zip(table, post) if r[0] < len(pii.BASE))


def test_pages(spark):
    html = ["<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>\n three.<p>Four<div class=ad>Buy</div><section id=comments><p>Me too</section></article><footer>c</footer>", None, "", "plain text", "<p>cut off <a href='", "<script>var a='<p>x</p>'</script><p>y</p>", "<!-- <p>no</p> --><p>yes"]
    df = spark.createDataFrame([(k, None, h, 1, "t") for k, h in enumerate(html)], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: r for r in rows(pages.extract(df))}
    assert got[0].text == "T & U\nOne two three.\nFour"
    assert got[1].text == got[2].text == "" and got[3].text == "plain text" and got[1].n_chars == 0
    assert rows(pages.extract(df.limit(0))) == []


def test_pages_of_tag_soup():
    soup = "".join(f"<b>x{k}" for k in range(300))
    for page in (f"<nav>{soup}</nav><article><p>Kept text.</article>", "<article><p>Kept text.<button>More</article>"):
        own = pages.blocks_of(page)[-1]
        assert own.text.startswith("Kept text.") or own.text == "More"
        assert own.place == pages.SURE
    for name in ("button", "select", "svg", "math", "object", "noscript"):
        assert "after" in " ".join(b.text for b in pages.blocks_of(f"<article><p>a<{name}>b<p>after</article>"))
    for name in ("script", "style", "title", "textarea", "iframe"):
        assert "after" not in " ".join(b.text for b in pages.blocks_of(f"<article><p>a<{name}>b<p>after</article>"))
    assert pages.blocks_of("<article><p>let <math><mi>x</mi></math> be")[0].text == "let x be"
    deep = "<div>" + "<i>" * 20
    assert [b.depth for b in pages.blocks_of(f"<p>{'<i>' * 20}one<div>two")] == [22, 2] and pages.blocks_of(deep + "x")[0].text == "x"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div title="hidden gems"><article><p>A</article>', "A"),
        ('<article data-id="menu"><p>A', "A"),
        ('<p class="a>text</p><p class="b">two</p>', "text\ntwo"),
        ('<p class="a>end of it', "end of it"),
        ('<div class="post-comments-off"><article><p>A</p></article></div>', "A"),
        ("plain text only", "plain text only"),
        ("<div id=comments><article><p>c</article></div><article><p>A</article>", "A"),
        ("<form><article><p>A</article></form>", "A"),
        ("<article><header><h1>T</h1></header><p>A<aside>no</aside><footer>no</footer></article>", "T\nA"),
        ('<p title="x <b> y">z</p>', "z"),
        ('<article><p>A</p><div class="ad-banner">x</div><div hidden>y</div><p style="DISPLAY: none">z</p><p>B</p></article>', "A\nB"),
        ("<nav>" + "<b>" * 5000 + "</nav><article><p>A</article>", "A"),
        ("<nav><a>x</a></nav>", ""),
    ],
)
def test_places_of_blocks(html, text):
    assert pages.main_text(html, np.zeros(7)) == text


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {k}, as it stands.</p>" for k in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, "<p>x")], "page_id long, url string, html string")
    got = sorted(rows(pages.extract(df)), key=lambda r: r.n_chars)
    assert [r.text.count("\n") for r in got] == [0, 19_999, 19_999] and got[0].page_id is None


def test_neardup(docs, none):
    got = {r.doc_id: r for r in rows(neardup.components(docs))}
    assert (got[4].component_id, got[5].component_id, got[6].component_id) == (4, 4, 4)
    assert got[0].n_shingles == 0 and got[0].kept and got[3].n_shingles == 1 and got[None].component_id is None and got[None].kept
    assert rows(neardup.components(none)) == []
    assert {r.doc_id for r in rows(neardup.near_dedup(docs))} == {0, 1, 2, 3, 4, 7, 8, 9, 10, None}


def test_quality(docs, none, labels):
    got = {r.doc_id: r for r in rows(quality.quality_scores(docs, labels))}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[4].n_words == 120 and not got[4].base_failed
    assert rows(quality.quality_scores(none, labels)) == [] and rows(quality.quality_filter(none, labels)) == []
    assert {r.doc_id for r in rows(quality.quality_filter(docs, labels.limit(0)))} == {4, 5, 6, 7}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, sf, empty):
    df = none if empty else docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, sf)
        n = out.count()
        assert n <= 2 * df.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns


def test_working_tables_without_a_checkpoint_setting(tmp_path):
    """A session whose configuration sets no checkpoint folder: operators that write working tables run, and clean up."""
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from facetlens.llm.common import clean_up, written
print(s.conf.get("spark.checkpoint.dir", None), written(s.range(3), "t").count(), clean_up(s))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-3:] == ["None", "3", "1"], out.stderr[-2000:]


@pytest.mark.parametrize("stage", range(5))
def test_stages_send_texts_by_bytes(spark, monkeypatch, stage):
    """Before, up to 10,000 whole texts went to a Python worker at once, whatever their length."""
    import corpus_pipeline as cp
    import pyarrow as pa

    session = spark.newSession()
    docs = session.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 20000) AS text")
    monkeypatch.setattr(cp, "table", lambda *_: None)
    for where, name in ((cp.quality, "quality_filter"), (cp.neardup, "near_dedup"), (cp.decon, "decontaminate"), (cp.mixing, "mix"), (cp.sharding, "shard")):
        monkeypatch.setattr(where, name, lambda df, *_: df)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = cp.STAGES[stage][1](session, docs, "").mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 40 and max(r.bytes for r in got) < 1_500_000


@pytest.mark.parametrize(("own", "then"), [("64k", "64k"), ("64MB", str(1 << 20)), ("2147483647", str(1 << 20))])
def test_bounded_batches_keep_a_smaller_bound(spark, own, then):
    from facetlens.llm.common import bounded_batches

    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
    bounded_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == then
