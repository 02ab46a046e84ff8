"""URL filters (native): lists of hosts and paths, then association rules mined by FP-growth and matched by inverted index.

Examples are the URLs whose page carries a labelled document. Only DataFrame functions and JVM code run; there is no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the fixed list; a rule fits its host and all subdomains where the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Up to so many rules or tokens are sent to all tasks; more are joined.
SENT = 200_000
#: A rule holds on so many examples at least, whatever the share asked for is of a small table.
LEAST = 8
#: A document's row is repeated so often, so that pages that all carry one document are not joined in one task.
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_columns(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Longest counts the characters of host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_col == F.lit(h)) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(host_col: Column, path_col: Column) -> Column:
    """The distinct words of host and path, each with the part that it stands in; numbers carry no meaning and are left out."""
    host_words = F.transform(F.split(host_col, r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("h:"), x))
    path_words = F.transform(F.split(F.translate(path_col, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(host_words, path_words), lambda x: x.rlike(r"^.:.*\p{L}")))


def page_labels(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages whose article is a labelled document's text: ``block`` if any such document is toxic or of low quality, else ``allow``.

    Texts are compared by their letters and digits, whole: a page's are those of its article or main element, or of all of it, without
    its heading, scripts, styles and markup. Null texts and those without a letter or digit are nobody's.
    """
    plain = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    signs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    article = F.regexp_extract("html", r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    bare = F.regexp_replace(F.when(article != "", article).otherwise(F.col("html")), r"(?is)<(script|style|h1|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", "")
    for sign, meant in signs:
        bare = F.replace(bare, F.lit(sign), F.lit(meant))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) <= 0) | (F.coalesce(F.col("toxic"), F.lit(0)) > 0)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    # texts become hashes before they are moved
    texts = documents.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(plain(F.col("text"))).alias("key"))
    said = texts.join(known, "doc_id").groupBy("key").agg(F.max("bad").alias("bad")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shown = pages.where("url is not null").select("url", F.md5(plain(bare)).alias("key"), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int").alias("salt"))
    return shown.join(said, ["key", "salt"]).select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))


def frequent_apart(baskets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((items, label) with the tokens on ``least`` rows or more, (token, name) of those): tokens that always stand together go by the first of them.

    What always stands together tells the same, and would make a set of items of every choice among it. A URL may hold some of them
    alone, so each token keeps the name that it goes by: one of them is as good as another wherever a rule asks for the name.
    """
    each = baskets.select("label", F.explode("items").alias("token"), F.xxhash64("items").cast("decimal(38,0)").alias("h"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least)
    first = found.groupBy("n", "h").agg(F.min("token").alias("name"))
    names = common.written(found.join(first, ["n", "h"]).select("token", "name"))
    kept = names.where("token = name").select("token")
    few = kept.count() <= SENT  # tokens of a basket / least share at most
    rows = baskets.withColumn("row", F.monotonically_increasing_id())
    left = rows.select("row", "label", F.explode("items").alias("token")).join(F.broadcast(kept) if few else kept, "token")
    return left.groupBy("row", "label").agg(F.collect_set("token").alias("items")).select("items", "label"), names


def mine(labelled: DataFrame, min_support: float, min_confidence: float, partitions: int) -> tuple[DataFrame, DataFrame]:
    """((rule_id, antecedent, verdict, confidence, support), (token, name)) from (items array, label), written; antecedents hold names.

    Rules have one label as their consequent. A rule goes if leaving out one token gives a rule with the same verdict and at least its
    confidence, which holds whenever it does.
    """
    baskets = common.written(labelled.select("items", "label"))
    n = baskets.count()
    least = max(LEAST, math.ceil(min_support * n - 1e-9))  # a whole number: LEAST / n * n may be more than LEAST
    apart, names = frequent_apart(baskets, least)
    sets = common.written(apart.select(F.array_union("items", F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items")))
    held = max(1, sets.count())  # baskets without a frequent token hold no rule, but count
    share = n / held
    # half a row less, so that what is rounded up there is least itself
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / held), minConfidence=min_confidence, numPartitions=partitions).fit(sets)
    said = F.col("consequent")[0]
    found = model.associationRules.where(said.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    found = found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(said, len(LABEL) + 1, 99).alias("verdict"), "confidence", (F.col("support") / share).alias("support"))
    found = common.written(found.withColumn("rule_id", F.xxhash64("antecedent", "verdict")))
    shorter = found.select("rule_id", "confidence", F.explode(F.transform("antecedent", lambda x: F.xxhash64(F.array_remove("antecedent", x), F.col("verdict")))).alias("part"))
    covered = shorter.join(found.select(F.col("rule_id").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("rule_id").distinct()
    return common.written(found.join(covered, "rule_id", "left_anti")), names


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    labels: DataFrame | None = None,
    min_support: float = 0.001,
    min_confidence: float = 0.9,
) -> DataFrame:
    """(id, host, path, rule, verdict, mined_confidence) for each row.

    ``labels`` (url, label) are the examples to mine, label ``block`` or ``allow``; without them the URLs that a list rule decides, with its
    verdict. A list rule decides first; else the mined rule with the highest confidence, then the longest, of either verdict, that
    the URL's tokens hold (``block`` where both tie); else ``allow``. Rows with equal ids are judged each. Null or odd URLs have empty
    host and path, no tokens, and are allowed; null labels and those of null URLs are left out. An empty table gives an empty result.
    Other columns of the input are not read.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select("id", "host", "path", rule.alias("rule"), said.alias("listed"), tokens(F.col("host"), F.col("path")).alias("items"))
    if labels is None:
        learn = base.where(F.col("listed").isNotNull()).select("items", F.col("listed").alias("label"))
    else:
        u = F.col("url")
        learn = labels.where("url is not null and label is not null").select(tokens(host(u), path(u)).alias("items"), F.col("label").cast("string").alias("label"))
    learn = learn.where(F.size("items") > 0)
    mined, names = mine(learn, min_support, min_confidence, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the inverted index: a row for each name of each rule; support bounds it, whatever the input's size
    index = mined.select("rule_id", F.size("antecedent").alias("need"), "confidence", "verdict", F.explode("antecedent").alias("name"))
    names = F.broadcast(names) if names.count() <= SENT else names
    index = F.broadcast(index) if index.count() <= SENT else index
    # equal token sets are judged once: many pages of one host share them
    sets = base.where(F.col("rule").isNull() & (F.size("items") > 0)).select(F.array_sort("items").alias("items")).distinct().withColumn("set_id", F.xxhash64("items"))
    # a name once, however many of its tokens a set holds
    held = sets.select("set_id", F.explode("items").alias("token")).join(names, "token").select("set_id", "name").distinct()
    hits = held.join(index, "name").groupBy("set_id", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence"), F.first("verdict").alias("mined"))
    best = hits.where("n = need").groupBy("set_id").agg(F.max(F.struct("confidence", "need", (F.col("mined") == "block").alias("strict"), "rule_id", "mined")).alias("best"))
    best = best.select("set_id", F.col("best.mined").alias("mined"), F.col("best.confidence").alias("mined_confidence"))
    open_ = F.col("rule").isNull() & (F.size("items") > 0)
    out = lambda df, said, sure: df.select(F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"), sure.alias("mined_confidence"))
    # what the list decides needs no join: a null key would gather it in one task
    done = out(base.where(~open_), F.coalesce("listed", F.lit("allow")), F.lit(None).cast("double"))
    asked = base.where(open_).withColumn("set_id", F.xxhash64(F.array_sort("items"))).join(best, "set_id", "left")
    return done.unionByName(out(asked, F.coalesce("mined", F.lit("allow")), F.col("mined_confidence")))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "documents", "labels"))
    return filter_urls(pages, labels=page_labels(pages, documents, labels)).drop("mined_confidence")
