"""URL rules against a search of all sets of tokens, and examples against labelled documents."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, urls

UPPER = re.compile("[A-Z]+")
LOW = lambda t: UPPER.sub(lambda m: m[0].lower(), t)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return LOW(host), re.match("[^?#]*", rest[len(host) :])[0]


def tokens(url):
    host, path = parts(url)
    words = [("h:", w) for w in re.split(r"[\W_]+", host)] + [("p:", w) for w in re.split(r"[\W_]+", LOW(path))]
    return {k + w for k, w in words if any(c.isalpha() for c in w)}


def listed(url):
    host, path = parts(url)
    fits = [(len(h) + len(p), said) for said, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1] if fits else None


def judged(pages, labels, support, sure):
    """All subsets of all baskets, counted one by one."""
    baskets = [(tokens(u), x) for u, x in labels if tokens(u)]
    least = max(support * len(baskets), urls.LEAST)
    count = {}
    for items, label in baskets:
        for size in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), size):
                count.setdefault(s, {}).setdefault(label, 0)
                count[s][label] += 1
    rules = [(n / sum(c.values()), said, set(s)) for s, c in count.items() for said, n in c.items() if n >= least - 1e-9 and n / sum(c.values()) >= sure]
    out = {}
    for i, u in pages:
        fits = [(c, said == "block") for c, said, s in rules if s <= tokens(u)]
        best = max((c for c, _ in fits), default=None)
        out[i] = (listed(u) or (None if best is None else {("block" if x else "allow") for c, x in fits if c == best}) or "allow", best)
    return out


def test_verdicts_equal_those_of_all_token_sets(spark):
    common.ship(spark)
    r = random.Random(8)
    hosts = ["bad.io", "shop.bad.io", "fine.io", "blog.fine.io", "x.net", "a.example.net", "example.com", "www.org"]
    url = lambda: f"http{r.choice(['', 's'])}://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr', 'sale'])}/{r.choice(['', 'win', 'read', '12'])}{r.choice(['', '?q=1', '#t'])}"
    pages = [(k, url()) for k in range(300)]
    labels = [(u, "block" if "bad" in u and r.random() < 0.96 or "win" in u and r.random() < 0.7 else "allow") for u in (url() for _ in range(400))]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.filter_urls(df, labels=spark.createDataFrame(labels, "url string, label string"), min_support=0.02).collect()
    want = judged(pages, labels, 0.02, 0.9)
    for x in got:
        said, best = want[x.page_id]
        assert x.verdict == said or x.verdict in said
        assert x.rule is not None or (x.mined_confidence or 0) == pytest.approx(best or 0)
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}


def test_list_and_odd_urls(spark):
    common.ship(spark)
    rows = [(1, "https://A.Example.NET/en/1?x"), (2, "http://x.net"), (3, "http://x.net/a"), (4, "ftp://example.com/de/"), (5, "http://www.org/fr/#t"), (6, None), (7, "no scheme"), (8, "http://evilnet/"), (9, "http://x.example.com/en/"), (9, "http://x.example.com/en/"), (10, "http://a.io/" + "word/" * 20_000), (11, "://"), (12, "")]
    df = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows], "page_id long, url string, id string, items string, rule int")
    got = {x.page_id: x for x in urls.filter_urls(df).collect()}
    for i, u in rows:
        assert (got[i].host, got[i].path) == parts(u)
    assert [got[k].rule for k in (1, 2, 3, 4, 5, 8)] == ["example.net/en/", None, "net/", "example.com/de/", "org/fr/", None]
    assert [got[k].verdict for k in (1, 3, 4, 5)] == ["allow", "block", "block", "allow"] and all(got[k].verdict == "allow" for k in (6, 7, 11, 12))
    assert urls.filter_urls(df).count() == len(rows) and urls.filter_urls(df.limit(0)).count() == 0


def test_tokens_that_stand_together_are_one(spark):
    common.ship(spark)
    long = "http://spam.io/" + "/".join(f"w{chr(97 + k)}" for k in range(22))  # 22 words that always occur together: 4 million sets
    labels = [(long + f"/{k}", "block") for k in range(50)] + [(f"http://good{k % 5}.io/x", "allow") for k in range(100)]
    df = spark.createDataFrame([(1, long + "/99"), (2, "http://good1.io/x"), (3, "http://else.org/")], "page_id long, url string")
    got = {x.page_id: x.verdict for x in urls.filter_urls(df, labels=spark.createDataFrame(labels, "url string, label string"), min_support=0.05).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_one_of_the_tokens_that_stand_together_is_enough(spark):
    common.ship(spark)
    labels = [(f"http://spam.io/win/prize/{k}", "block") for k in range(30)] + [(f"http://good.net/read/{k}", "allow") for k in range(60)]
    pages = [(1, "http://new.shop/prize/1"), (2, "http://new.shop/win/"), (3, "http://spam.shop/"), (4, "http://new.shop/read/"), (5, "http://new.shop/")]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, label string"), min_support=0.05).collect()
    want = judged(pages, labels, 0.05, 0.9)
    assert all(x.verdict in want[x.page_id][0] and x.mined_confidence == want[x.page_id][1] for x in got)
    assert [x.verdict for x in sorted(got)] == ["block"] * 3 + ["allow"] * 2


def test_a_rule_on_just_enough_examples_holds(spark):
    common.ship(spark)
    n, held = 25, 22  # 8 / n * (n / held) * held is more than 8
    odd = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    labels = [(f"http://spam/{k}", "block") for k in range(urls.LEAST)] + [(f"http://good/{k}", "allow") for k in range(held - urls.LEAST)] + [(f"http://x{odd(k)}/", "allow") for k in range(n - held)]
    got = urls.filter_urls(spark.createDataFrame([(1, "http://spam/")], "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, label string")).drop("host").first()
    assert (got.verdict, got.mined_confidence) == ("block", 1.0)


def test_both_verdicts_count_and_held_out_urls_are_foretold(spark):
    common.ship(spark)
    labels = [(f"http://bad.io/x{k}", "block") for k in range(0, 95)] + [("http://bad.io/safe", "allow")] * 5 + [("http://fine.io/safe", "allow")] * 20
    df = spark.createDataFrame([(1, "http://bad.io/safe"), (2, "http://bad.io/other"), (3, "http://else.io/")], "page_id long, url string")
    got = {x.page_id: (x.verdict, x.mined_confidence) for x in urls.filter_urls(df, labels=spark.createDataFrame(labels, "url string, label string"), min_support=0.01).collect()}
    assert got[1] == ("allow", 1.0) and got[2] == ("block", pytest.approx(0.95)) and got[3][0] == "allow"
    r = random.Random(4)
    seen = [(f"http://{r.choice(['cheap', 'win', 'news', 'blog'])}{r.choice(['', '-best', '-one'])}.example{r.choice(['', 's'])}.io/{k}", k) for k in range(800)]
    labelled = [(u, "block" if "win" in u or "cheap" in u else "allow") for u, _ in seen]
    got = urls.filter_urls(spark.createDataFrame([(k, u) for u, k in seen[400:]], "page_id long, url string"), labels=spark.createDataFrame(labelled[:400], "url string, label string")).collect()
    assert all(x.verdict == dict((k, y) for (_, k), (_, y) in zip(seen, labelled))[x.page_id] for x in got)


def test_examples_come_from_labelled_documents(spark):
    text = "Some words, & more <words>. Über 10!"
    docs = spark.createDataFrame([(1, text), (2, "other text"), (3, "other  text"), (4, None), (5, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0), (5, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    html = "<nav>menu</nav><article class=x><h1>Head</h1><p>Some words, &amp; more <b>&lt;words&gt;.</b><p>Über 10!</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "u1", html), (2, "u2", "<body>other text"), (3, "u3", None), (4, "u4", "<p>not known"), (5, None, html), (6, "u6", "<main>other<script>x</script> text</main>")], "page_id long, url string, html string")
    got = sorted(map(tuple, urls.page_labels(pages, docs, labels).collect()))
    assert got == [("u1", "allow"), ("u2", "block"), ("u6", "block")]
    assert urls.page_labels(pages.limit(0), docs, labels).count() == 0
