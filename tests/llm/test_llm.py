"""Each operator against a brute-force version and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, html, jaccard, langid, lm, mixing, neardup, quality, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, token string"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn near river".split()


def texts():
    r = random.Random(3)
    many = " ".join(r.choice(BASE) + str(r.randint(0, 400)) for _ in range(300))
    near = many.split(" ")
    near[10] = "changed"
    far = many.split(" ")
    far[::8] = ["zz"] * len(far[::8])
    long = " ".join(f"w{k % 7001}" for k in range(30_000))
    return [None, "", " \t\n", "one two", "One TWO", "one two", many, " ".join(near), " ".join(far), many, long, "héé ñandú 日本 🎉 x", "1234 !!", "<|endoftext|> it's it'll 'T", "a b c d e f a b c d e f a b c d e f", "line one\nline one\nother\n\n\n"]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", None, "b")[k % 3], len(t or ""), k, "x") for k, t in enumerate(texts())]
    rows += [(3, "one two", "en", "a", 7, 99, "x"), (None, "no id here at all", "en", "a", 1, 1, "x"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_words_and_hashes_agree_with_regex():
    import pyarrow as pa

    t = texts()
    w = common.Words(pa.array(t))
    assert w.counts.tolist() == [len(WORD.findall(x or "")) for x in t]
    flat = [x for y in t for x in WORD.findall((y or "").translate(LOW))]
    h = w.hashes().tolist()
    assert len(set(zip(flat, h))) == len(set(flat)) == len(set(h))


@pytest.mark.parametrize("block, sift", [(jaccard.BLOCK, jaccard.SIFT), (200, 2)])
def test_jaccard_components(docs, none, monkeypatch, block, sift):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SIFT", sift)
    got = jaccard.jaccard_components(docs).collect()
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = up[a], up[b]
                up = [new if u == old else u for u in up]
    want = []
    for k, (i, s) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if up[j] == up[k] and rows[j][0] is not None]
        want.append((i, len(s), min(ids) if ids and s else i))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 3, 6}.issubset({r.doc_id for r in kept.collect()}) and 7 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("block, sift, most", [(jaccard.BLOCK, 7, 32_768), (400, 7, 20)])
def test_large_groups_in_blocks(spark, monkeypatch, block, sift, most):
    """A group of near copies in a chain, and another, each cut into many blocks."""
    common.ship(spark)
    for name, x in (("BLOCK", block), ("SIFT", sift), ("MOST", most)):
        monkeypatch.setattr(jaccard, name, x)
    r = random.Random(4)
    rows, text = [], [f"w{k}" for k in range(60)]
    for k in range(60):  # each a few words from the last: far ones share too little
        text[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join([f"v{j}" for j in range(40)] + [f"u{k}"])) for k in range(40)]
    rows += [(200 + k, " ".join([f"v{j}" for j in range(6)] + [f"t{k}_{j}" for j in range(30)])) for k in range(30)]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for i, a in sets:
            for j, b in sets:
                if j < i and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == label and len(set(label.values())) < 60


def test_divide_skip_equals_count():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 60, 400).astype(np.uint64))
    parts = []
    for k in range(60):
        own = base[r.random(len(base)) < r.choice([0.5, 0.9, 0.97])]
        parts.append(np.unique(np.concatenate((own, r.integers(0, 1 << 60, r.integers(1, 60)).astype(np.uint64)))))
    parts.sort(key=len)
    index = jaccard.Index(parts)
    for k, p in enumerate(parts):
        want = {j for j, q in enumerate(parts) if j != k and 100 * len(np.intersect1d(p, q)) >= 75 * len(np.union1d(p, q))}
        assert set(index.search(p, k)) == want
    near = jaccard.may_link(np.array([len(p) for p in parts]), [jaccard.parity(p).tobytes() for p in parts])
    assert all(near[k] for k, p in enumerate(parts) if any(True for _ in index.search(p, k)))


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.tokenize(docs).collect()}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[(r.doc_id, t.decode(ids, skip_special_tokens=False))] == ids
    row = next(r for r in bpe.digests(bpe.tokenize(docs)).collect() if r.doc_id == 13)
    ids = t.encode(texts()[13], add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and row.n_tokens == len(ids)
    assert bpe.tokenize(none).count() == 0


def test_quality_base_rules(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 1, 1), (14, 0, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, t in enumerate(texts()):
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = by[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(docs, labels.where("false")).where("kept = base_failed").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_threshold():
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[2050:2100], bad[1000:1900] = 10, 1
    assert -8 + 16 * 1900 / 4096 <= quality.threshold(good, bad) <= -8 + 16 * 2050 / 4096
    assert quality.threshold(good, np.zeros(quality.BINS, int)) == float("-inf")


def test_language_held_out(spark, none, docs):
    common.ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).all()
    odd = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 12)] == ["und"] * 4
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.drop("lang")).collect()} == {"und"}


def test_html_labelled_pages_and_odd_input(spark):
    common.ship(spark)
    model = html.default_model()
    right = total = wrong = 0
    for page, wanted in html.labelled_pages(200, seed=11):
        got = html.extract(page, model).split("\n")
        right, total, wrong = right + len(set(got) & set(wanted)), total + len(wanted), wrong + len(set(got) - set(wanted))
    assert right / total > 0.97 and wrong / total < 0.03
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b\n c"), (3, "u", "<p>a &amp; b\n c"), (4, "u", "<div>" * 2000 + "deep")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).collect()) == [(1, "", 0), (2, "", 0), (3, "a & b c", 7), (3, "a & b c", 7), (4, "deep", 4)]


def test_html_marginals_equal_enumeration():
    import itertools

    model = html.default_model()
    page = html.Page("<body><nav><a href=x>home</a></nav><article><p>text here</p></article></body>")
    n = len(page.nodes)
    own = [model.own(*f) for f in page.features]
    total, on = 0.0, [0.0] * n
    for states in itertools.product(range(3), repeat=n):
        p = math.exp(model.root[states[0]] + sum(own[k][states[k]] for k in range(n)) + sum(model.edge[states[page.parent[k]]][states[k]] for k in range(1, n)))
        total += p
        for k in range(n):
            on[k] += p * (states[k] == html.CONTENT)
    assert np.allclose(model.marginals(page), [x / total for x in on])


@pytest.mark.parametrize("least", [neardup.LEAST_ROWS, 30])
def test_embeddings(spark, monkeypatch, least):
    common.ship(spark)
    monkeypatch.setattr(neardup, "LEAST_ROWS", least)
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 16)) * np.linspace(3, 0.1, 16)
    v[100:140] = v[0] + 0.05 * r.normal(size=(40, 16))
    v[200] = v[201]
    v[220:260] = v[5]  # copies
    v[270] = 2 * v[5]
    ids = list(range(300))
    rows = [(k, [float(x) for x in v[k]], 1, "x", 1.0) for k in ids]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(300 + k, x, 1, "x", 1.0) for k, x in enumerate(odd)] + [(7, [float(x) for x in v[7]], 1, "x", 1.0)] * 2 + [(None, [float(x) for x in v[7]], 1, "x", 1.0)]
    ids += [7, 7]
    v = np.concatenate((v, v[[7, 7]]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, n double").repartition(3)
    got = neardup.near_duplicates(df, block_rows=64).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.95
    np.fill_diagonal(link, False)
    label = np.array(ids)
    for _ in range(300):
        label = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
    want = [(ids[k], int(link[k].sum()), int(label[k]), bool(label[k] == ids[k])) for k in range(len(ids))]
    want += [(k, 0, k, True) for k in range(300, 305)] + [(305, 1, 305, True), (306, 1, 305, False), (None, 0, None, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_at_the_threshold(spark):
    common.ship(spark)
    a = math.acos(0.95)
    angle = [0.0, a - 1e-9, 2 * a - 3e-9, 10.0, 10.0 + a + 1e-9]
    df = spark.createDataFrame([(k, [math.cos(x), math.sin(x)]) for k, x in enumerate(angle)], "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (2, 0), 2: (1, 0), 3: (0, 3), 4: (0, 4)}


def test_lm_base_and_distribution(docs, none):
    got = lm.score(docs).collect()
    rows = docs.collect()
    tokens = [(r.doc_id, [*WORD.findall((r.text or "").translate(LOW)), "\n"]) for r in rows]
    c = collections.Counter()
    for i, t in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update(t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for i, t in tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert lm.score(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}, total=400).collect()
    n = collections.Counter(r.source for r in got)
    assert set(n) == {"a", "b"} and 240 < n["a"] < 360 and 60 < n["b"] < 145
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys) and mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(docs).collect() == mixing.mix_sources(docs).collect()


def test_warc(spark, tmp_path):
    common.ship(spark)
    full = {"record_id": "r1", "warc_type": "response", "url": "http://www.A.com/x/", "ts": "2024-01-01T00:00:00Z", "status": 200, "headers": {"etag": '"1"', "content-length": "3", "date": "old"}, "payload": b"abc"}
    again = {"record_id": "v1", "warc_type": "revisit", "url": "https://a.com/x#f", "ts": "2024-01-02T00:00:00Z", "status": 304, "headers": {"etag": 'W/"1"', "date": "new", "content-length": "0"}, "payload": b""}
    other = again | {"record_id": "v2", "headers": {"etag": '"2"'}}
    early = again | {"record_id": "v3", "ts": "2023-01-01T00:00:00Z"}
    bare = again | {"record_id": "v4", "headers": {}}
    assert list(warc.parse_warc(b"junk WARC/1.1\r\nContent-Length: x\r\n\r\n")) == [] and list(warc.parse_warc(b"WAR" * 5)) == []
    data = warc.write_warc([full, again, other, early, bare])
    assert [x["payload"] for x in warc.parse_warc(data)] == [b"abc", b"", b"", b"", b""]
    assert len(list(warc.parse_warc(data[:-9]))) >= 4 and list(warc.parse_warc(b"")) == []
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = {r.record_id: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "x.warc.gz"))).collect()}
    assert [got[k].outcome for k in ("v1", "v2", "v3", "v4")] == ["resolved", "mismatch", "no_base", "unverified"]
    assert got["v1"].headers == {"etag": 'W/"1"', "date": "new", "content-length": "3"} and got["v1"].base_id == "r1"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("doc_id")
    known = langid.identify(docs.join(good, "doc_id", "left_semi")).where("lang_pred <> 'und'").select("doc_id")
    left = docs.join(known, "doc_id", "left_semi")
    one = {r.doc_id for r in jaccard.jaccard_components(left).where("doc_id = component_id or n_shingles = 0").collect()}
    copies = collections.Counter(r.doc_id for r in mixing.mix_sources(left.where(left.doc_id.isin(list(one)))).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in got) == copies and all(r.n_tokens == len(r.ids) for r in got)


def test_mixing_reaches_targets_of_small_sources(spark):
    df = spark.range(20_010).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "small").otherwise("large").alias("source"))
    n = collections.Counter(r.source for r in mixing.mix_sources(df, {"small": 1.0, "large": 1.0}).collect())
    assert all(abs(n[x] - 10_005) < 5 * math.sqrt(10_005) for x in ("small", "large"))  # a mean of 1000.5 and one of 0.5
    n = collections.Counter(r.source for r in mixing.mix_sources(df).collect())  # weights by the root: a mean of 43.8
    assert abs(n["small"] - 20_010 * math.sqrt(10) / (math.sqrt(10) + math.sqrt(20_000))) < 5 * math.sqrt(437)


def test_language_stage_rejects_what_the_filters_do_not_know(spark):
    common.ship(spark)
    r, docs = random.Random(2), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(-1 - k, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 9))) for _ in range(60)), None) for k in range(20)]
    noise += [(-50, "Это совсем другой язык и другая письменность", None), (-51, "这是另一种语言。" * 5, None)]
    got = langid.keep_known(docs.union(spark.createDataFrame(noise, docs.schema)))
    known = docs.join(langid.identify(docs).where("lang_pred <> 'und'").select("doc_id"), "doc_id", "left_semi").count()
    assert got.where("doc_id < 0").count() == 0 and got.count() == known
    assert langid.keep_known(docs.drop("lang")).count() == 0


def test_html_goes_on_after_odd_declarations_and_open_heads():
    model = html.default_model()
    around = "<nav><a href=x>home</a></nav>"
    article = "<article><p>" + "first words of a text. " * 9 + "</p>%s<p>" + "last words of a text. " * 9 + "</p></article>"
    whole = html.extract("<html><head><title>t</title></head><body>" + around + article % "" + "</body></html>", model)
    assert "first" in whole and "last" in whole
    for odd in ("<![ endif]-->", "<![foo bar]>", "<![endif]>", "<![]>"):
        assert html.extract("<html><head><title>t</title></head><body>" + around + article % odd + "</body></html>", model) == whole
    for start in ("<html><head><title>t</title><body>", "<html><head><title>t</title>", "<head><meta charset=x><noscript><style>x</style><body>", "<head><title>a <b> c</title><body>"):
        assert html.extract(start + around + article % "" + "</body></html>", model) == whole
    assert html.Page("<head><title>t</title>plain words").texts == ["plain words"]
    assert html.Page("<p>a &#" + "9" * 5000 + "; &#" + "0" * 5000 + "65; b &#8364; &#0000000000; c &#00000000065;").texts == ["a \ufffd A b \u20ac \ufffd c A"]
    assert html.Page("<p>see <svg><title>no</title><text>label</text></svg> and <math><mi>x</mi></math> here").texts[-1].endswith("and x here")
