"""Markup, archives and mixing on odd rows, against slow versions."""

import collections
import io
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, html, mixing, warc

ARTICLE = "<p>" + "first words of a text. " * 9 + "</p><p>" + "last words of a text. " * 9 + "</p>"


@pytest.mark.parametrize("page", ['<nav><a href=x>home</a></nav><article class="post tag-news">%s</article>', '<nav><a href=x>home</a></nav><article class="post-12 post type-post hentry category-ads tag-menu">%s</article>', '<nav class=navbar><a href=x>home</a></nav><div class="post-body">%s</div><div class="site-footer">home</div>', '<header>home</header><div class="story-text">%s</div><div id="cookie-banner">home</div><div class="comment-list"><div class=comment><p>home of a reader</p></div></div>', "<html><head><title>t</title><body><nav>home</nav><main id=main>%s</main><footer>home</footer>"])
def test_article_whatever_it_is_called(page):
    got = html.extract(page % ARTICLE, html.default_model())
    assert got.count("first words") == 9 and got.count("last words") == 9 and "home" not in got


def test_long_and_deep_pages_take_linear_time():
    model = html.default_model()
    for kind in ("<div>%s", "<p>a<div>b%s", "<b>%s", "<section></article><li>x%s"):
        took = []
        for n in (4000, 16_000):
            began = time.process_time()
            html.extract(kind.replace("%s", "") * n + "end", model)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, kind
    many = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html.extract(many, model).count("word") == 20_000


def test_sums_of_nested_elements_equal_those_by_walking_up():
    r = random.Random(1)
    for _ in range(30):
        page = html.Page("".join(r.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "some text ", "<b>", "x<br>"]) for _ in range(60)))
        want, linked = [0] * len(page.nodes), [0] * len(page.nodes)
        for leaf in page.at:
            k = leaf
            while k >= 0:
                want[k] += page.nodes[leaf].text if k != leaf else len(page.texts[page.at.index(leaf)])
                linked[k] += page.nodes[leaf].linked
                k = page.parent[k]
        assert [n.text for n in page.nodes] == want and [n.linked for n in page.nodes] == linked


def test_pages_with_other_columns_and_none(spark):
    common.ship(spark)
    df = spark.createDataFrame([(1, "<p>a</p>", "u", "t", 5), (None, None, None, None, None)], "page_id long, html string, url string, text string, n_chars int")
    got = html.extract_pages(df).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", "a", 1), (None, None, "", 0)]
    assert html.extract_pages(df.limit(0)).count() == 0
    deep = spark.createDataFrame([(1, "u", "<div>" * 20_000 + "deep " * 200_000)], "page_id long, url string, html string")
    assert html.extract_pages(deep).first().n_chars == 999_999


# --- archives ------------------------------------------------------------------------------------------------

SCHEMA = "record_id string, warc_type string, url string, ts timestamp, status int, etag string, last_modified string, digest string, headers map<string,string>, span int, base string"


def resolved(rows):
    """Each revisit against all responses, one by one."""
    out = []
    for r in rows:
        if r["warc_type"] != "revisit":
            continue
        able = [b for b in rows if b["warc_type"] == "response" and b["status"] == 200 and None not in (b["url"], b["ts"], r["url"], r["ts"]) and b["url"] == r["url"] and b["ts"] < r["ts"]]
        base = max(able, key=lambda b: (b["ts"], b["record_id"], b["etag"] or ""), default=None)
        said = "no_base"
        if base:
            said = "unverified"
            for k in ("etag", "last_modified", "digest"):
                if r[k] and base[k]:
                    said = "resolved" if r[k].removeprefix("W/") == base[k].removeprefix("W/") else "mismatch"
                    break
        out.append((r["record_id"], said, base and base["record_id"]))
    return sorted(out, key=str)


def test_revisits_equal_a_search_of_all_responses(spark):
    r = random.Random(6)
    import datetime as dt

    rows = []
    for k in range(400):
        rows.append({
            "record_id": f"r{r.randint(0, 300)}", "warc_type": r.choice(["response", "revisit", "revisit", "metadata", None]), "url": r.choice(["a.io/x", "a.io/x", "a.io/y", f"b.io/{k % 9}", None]),
            "ts": r.choice([None, dt.datetime(1999, 1, 1)] + [dt.datetime(2024, 1, 1 + r.randint(0, 20))] * 9), "status": r.choice([200, 200, 304, None]), "etag": r.choice([None, '"1"', 'W/"1"', '"2"']),
            "last_modified": r.choice([None, "x", "y"]), "digest": r.choice([None, "d"]), "headers": r.choice([None, {"date": "d", "content-length": "1"}]), "span": 1, "base": "x",
        })
    once = {(x["record_id"], x["warc_type"]): x for x in rows}.values()  # a record has one content; rows repeat
    rows = [*once, *[x for x in once if r.random() < 0.3]]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(x.record_id, x.outcome, x.base_id) for x in got], key=str) == resolved(rows)
    assert all((x.outcome == "resolved") == (x.status == 200) == (x.headers is not None) for x in got)
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_old_capture_leaves_the_spans_even(spark):
    log = spark.range(6400).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit("response").alias("warc_type"), F.lit("hot.io/").alias("url"), F.when(F.col("id") == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))).alias("ts"), F.lit(200).alias("status"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"))
    both = log.union(log.where("id % 2 = 1").withColumns({"warc_type": F.lit("revisit")})) if "id" in log.columns else log.union(log.withColumn("warc_type", F.lit("revisit")))
    out = warc.resolve_revisits(both)
    assert out.where("outcome = 'resolved'").count() == 6399  # each but the first has the one before it
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(curl" in plan


class Trickle(io.BytesIO):
    """Gives a few bytes at a time, and counts how much is asked for at once."""

    def read(self, n=-1):
        assert 0 < n <= warc.CHUNK
        return super().read(min(n, 1013))


def test_archives_are_read_forward_in_bounded_memory():
    rows = [{"record_id": f"r{k}", "warc_type": "response", "url": "http://a.io/", "ts": "2024-01-01T00:00:00Z", "status": 200, "headers": {"x": "y"}, "payload": bytes([k % 256]) * (k * 37 % 5000)} for k in range(300)]
    packed = warc.write_warc(rows)
    assert [x["payload"] for x in warc.parse_warc(Trickle(packed))] == [x["payload"] for x in rows] == [x["payload"] for x in warc.parse_warc(packed)]
    plain = b"".join(warc.unpacked(io.BytesIO(packed)))
    assert [x["payload"] for x in warc.parse_warc(Trickle(b"junk" + plain))] == [x["payload"] for x in rows]
    assert len(list(warc.parse_warc(plain[: len(plain) // 2]))) < 300 and len(list(warc.parse_warc(packed[: len(packed) // 2]))) > 100
    broken = packed[:5000] + b"\x00" * 50 + packed[5000:]
    assert 0 < len(list(warc.parse_warc(broken))) < 300
    took = []
    for n in (2000, 8000):
        big = warc.write_warc(rows[:1] * n)
        began = time.process_time()
        assert sum(1 for _ in warc.parse_warc(big)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


# --- mixing --------------------------------------------------------------------------------------------------


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 600:
        k += 1
        p = p * rate / k
        total += p
    return k


def test_counts_equal_a_slow_inversion(spark):
    import hashlib

    rows = [(k, "text" * 50_000 if k == 3 else None if k == 4 else "t", [None, "", "a", "b", "c c"][k % 5], k, "s", 1.0, 2.0, 7) for k in range(300)] + [(None, "x", "a", 0, "s", 1.0, 2.0, 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __source long, `__N` string, __rate double, __w double, copy_no int")
    weight = {"": 1.0, "a": 5.0, "b": 0.5}
    n = collections.Counter(r[2] or "" for r in rows)
    u = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52
    want = collections.Counter()
    for r in rows:
        s = r[2] or ""
        want[(r[0], r[2])] += poisson(u(f"mix|{'' if r[0] is None else r[0]}"), weight.get(s, 0.0) / 6.5 * len(rows) / n[s])
    by_column = F.when(F.col("source") == "", 1.0).when(F.col("source") == "a", 5.0).when(F.col("source") == "b", 0.5)
    for given in (weight, by_column):
        out = mixing.mix_sources(df, given)
        got = out.collect()
        assert collections.Counter((r.doc_id, r.source) for r in got) == +want
        assert out.columns == [*df.drop("copy_no").columns, "copy_no", "n_copies", "shuffle_key"]
        assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert mixing.mix_sources(df.limit(0), weight).count() == 0 and mixing.mix_sources(df, {}).count() == 0


def test_a_row_beside_two_thousand_reaches_its_weight(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("many").alias("source"))
    n = collections.Counter(r.source for r in mixing.mix_sources(df, {"one": 1.0, "many": 1.0}).collect())
    assert all(abs(n[x] - 1000) < 5 * math.sqrt(1000) for x in ("one", "many"))
