"""Language, quality rules and the whole pipeline against slow versions, on tables with odd rows."""

import collections
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, langid, mixing, quality

from . import twins

SF = "/root/testdata/sf0.001"


def odd_rows():
    long = " ".join(f"word{k % 977} of a long text" for k in range(20_000))
    return [(10_000, None, "en", "a"), (10_001, "", "fr", None), (10_002, "1234 !! ##", "en", "b"), (10_003, long, None, "a"), (10_004, long, "en", "c"), (None, "A row without an id that has more than ten words in it", "en", "a"), (10_005, "\t \n", None, None), (10_005, "again the same id with another text of more than ten words", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += odd_rows() + rows[:7]
    return spark.createDataFrame([(*r, 5, k, "x", 1.0) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __id long, llr string, score double").repartition(3)


def test_quality_equals_a_slow_version(spark, docs):
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(None, 1), (10_000, 1), (10_002, None), (10_003, 0), (10_003, 1)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = twins.judged(rows, labels)
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda i, t: (i is None, i or 0, len(t or ""))
    wanted = sorted((key(i, t)[:2], twins.base(t)[:5], kept, round(s, 7)) for (i, t), (s, kept) in zip(rows, want))
    assert sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.kept, round(r.llr, 7)) for r in got) == wanted
    assert any(k for _, k in want) and not all(k or twins.base(t)[5] for (_, t), (_, k) in zip(rows, want))  # some go by the ratio


def test_language_equals_exact_sets(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    sets, totals = twins.profiles(rows)
    got = collections.defaultdict(list)
    for r in langid.identify(docs).collect():
        got[r.doc_id].append((r.lang_pred, r.score, r.held_out))
    same = 0
    for i, t, _ in rows:
        lang, score = twins.language(t, sets, totals)
        near = [x for x in got[i] if x[0] == lang and abs(x[1] - score) < 0.03]
        same += bool(near)
        assert all(x[2] == (twins.crc(i, 4) == 2) for x in got[i])
    assert same == len(rows)


def test_language_without_letters_is_not_learned(spark):
    common.ship(spark)
    df = spark.createDataFrame([(k, "some words here", "en") for k in range(8)] + [(20 + k, "12 34", "zz") for k in range(8)], "doc_id long, text string, lang string")
    assert langid.train(df).langs == ["en"]
    kept = langid.keep_known(df.withColumns({"hits": F.lit(1), "lang_pred": F.lit("x"), "score": F.lit(2)}))
    assert kept.columns == ["doc_id", "text", "lang", "hits", "lang_pred", "score"] and kept.count() == 8
    assert langid.keep_known(df.limit(0)).count() == 0


def test_a_vocabulary_of_another_kind_is_refused(tmp_path):
    spec = json.load(open(bpe.default_path()))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"end_of_word_suffix": None}}, {"model": spec["model"] | {"type": "Unigram"}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.load(str(path))


def slow_pipeline(docs, labels):
    """(doc_id, ids) of what each stage leaves; docs (id, text, lang, source) with ids apart."""
    from tokenizers import Tokenizer

    rows = [r for r, (_, kept) in zip(docs, twins.judged([r[:2] for r in docs], labels)) if kept]
    sets, totals = twins.profiles([r[:3] for r in rows])
    shares = collections.defaultdict(list)
    rate = lambda t, s: (sum(n for g, n in twins.language_grams(t).items() if g in s), sum(twins.language_grams(t).values()))
    for i, t, lang, _ in rows:
        if lang in sets and twins.crc(i, 4) != 2:
            hit, tried = rate(t, sets[lang])
            if tried:
                shares[lang].append(int(1000 * hit / tried))
    bound = {k: 0.0 for k in sets}
    for lang, own in shares.items():
        own.sort()
        bound[lang] = langid.KEEP_SHARE * own[next(k for k in range(len(own)) if k + 1 >= langid.KEEP_OUT * len(own))] / 1000
    known = []
    for r in rows:
        if twins.language(r[1], sets, totals)[0] == "und":
            continue
        for lang, s in sets.items():
            hit, tried = rate(r[1], s)
            least = tried * bound[lang]
            if hit >= least - 2 * math.sqrt(least * (1 - bound[lang])):
                known.append(r)
                break
    up, found = twins.components([r[:2] for r in known])
    one = {}
    for k, r in enumerate(known):
        group = up[k] if found[k] else -1 - k
        if group not in one or r[0] < one[group][0]:
            one[group] = r
    left = list(one.values())
    n = collections.Counter(r[3] or "" for r in left)
    mass = sum(math.sqrt(x) for x in n.values())
    t = Tokenizer.from_file(bpe.default_path())
    out = collections.Counter()
    for i, text, _, source in left:
        s = source or ""
        copies = twins.poisson(twins.uniform(f"mix|{i}"), math.sqrt(n[s]) / mass * len(left) / n[s])
        if copies:
            out[(i, hashlib.sha256(" ".join(map(str, t.encode(text, add_special_tokens=False).ids)).encode()).hexdigest())] = copies
    return out


def test_pipeline_equals_a_slow_version(spark, tmp_path):
    common.ship(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(i, t, lang, s) for i, t, lang, s in odd_rows()[:5]] + [(20_000, rows[3][1], "en", "a"), (20_001, "Это другой язык и другая письменность, в ней больше десяти слов, да", None, "a")]
    r = random.Random(1)
    near = [(21_000 + k, t + " " + " ".join(r.choice("abc") for _ in range(3)), lang, s) for k, (_, t, lang, s) in enumerate(rows[:40]) if t]
    rows += near
    df = spark.createDataFrame([(*x, len(x[1] or ""), 1.0, "x") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, rate double, __id string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    labels = [(x.doc_id, x.quality) for x in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = slow_pipeline(rows, labels)
    got = collections.Counter((x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert len(want) > 50 and got == want


def test_each_stage_on_odd_rows(spark, docs, tmp_path):
    """Nulls, repeated rows, clashing and extra columns, and an empty table; every stage but the last keeps the columns."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            assert (n == 0) == (rows is not docs), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name


def test_stages_do_not_change_what_they_keep(spark, docs):
    whole = collections.Counter(map(tuple, docs.collect()))
    for out in (langid.keep_known(docs), mixing.mix_sources(docs).drop("copy_no", "n_copies", "shuffle_key")):
        assert set(map(tuple, out.collect())) <= set(whole)
