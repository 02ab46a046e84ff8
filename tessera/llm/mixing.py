"""Mixing sources to target weights by Poisson replication with hash seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Up to so many sources the rate table is sent to every executor; beyond, it is joined.
BROADCAST_SOURCES = 10_000
#: The largest mean that is inverted at once.
PART = 256.0
#: Rows of a partition of the result, about.
ROWS = 50_000


def uniform(seed: str, *parts: Column) -> Column:
    """A double in [0, 1) from 52 bits of md5, the same on every engine."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column) -> Column:
    """The inverse of the Poisson distribution function: how many k have P(X <= k) <= u. Rates are PART at most."""
    top = F.greatest(rate, F.lit(16.0))
    steps = F.sequence(F.lit(1), F.ceil(top + 14 * F.sqrt(top) + 20).cast("int"))  # beyond, less than 2**-52 is left
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("cdf"), F.lit(0).alias("n"))

    def step(s, k):
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(steps, start, step, lambda s: s["n"])).otherwise(0)


def copies(seed: str, ident: Column, rate: Column) -> Column:
    """A Poisson count of any mean. One over PART, whose exp(-rate) is 0 in time, is the sum of counts of equal parts, each by its own hash."""
    parts = F.ceil(rate / PART).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, k: s + poisson_count(uniform(seed + "/part", ident, k), rate / parts))
    return F.when(rate > PART, many).otherwise(poisson_count(uniform(seed, ident), rate))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | Column | None = None,
    *,
    temperature: float = 0.5,
    total: float | None = None,
    seed: str = "mix",
    source_col: str = "source",
    id_col: str = "doc_id",
    max_rate: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as a Poisson count says, with copy_no, n_copies and shuffle_key added, in global random order.

    A source's mean count is weight * total / its rows. ``weights`` are relative: by name (sources not named weigh 0), or a column over
    the source's name, called ``source``; without them a source weighs rows ** temperature. ``total`` rows are expected out, by default
    as many as come in. With a max_rate no mean exceeds it, and the sources that it cuts stay below their targets; by default there is
    none, whatever the rates. A null source and the source '' are one, named ''. Rows are told apart by id alone, so equal ids repeat
    alike; a null id counts as the text ''. Texts are not looked at. An empty table gives an empty table. Columns named copy_no,
    n_copies or shuffle_key are replaced; others may have any name. The order is that of the partitions and of the rows in them:
    written, it is the order of the files by name, and a Spark reader, which takes files as it likes, keeps it within each file.
    """
    docs = docs.drop("copy_no", "n_copies", "shuffle_key")
    source, count, weight, rate, salt, where = fresh(docs, "__source", "__n", "__w", "__rate", "__salt", "__part")
    key = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    counts = docs.groupBy(key.alias(source)).agg(F.count("*").cast("double").alias(count))
    n_sources = counts.count()
    if weights is None:
        weighed = counts.withColumn(weight, F.pow(count, F.lit(float(temperature))))
    elif isinstance(weights, Column):
        weighed = counts.withColumnRenamed(source, "source").withColumn(weight, F.coalesce(weights.cast("double"), F.lit(0.0))).withColumnRenamed("source", source)
    else:
        named = F.create_map([F.lit(x) for kv in weights.items() for x in kv])[F.col(source)].cast("double") if weights else F.lit(0.0)
        weighed = counts.withColumn(weight, F.coalesce(named, F.lit(0.0)))
    sums = weighed.agg(F.sum(weight), F.sum(count)).first()
    want, mass = float(total if total is not None else (sums[1] or 0.0)), float(sums[0] or 0.0)
    mean = F.col(weight) / F.lit(mass or 1.0) * F.lit(want) / F.col(count)
    rates = weighed.select(source, (mean if max_rate is None else F.least(F.lit(float(max_rate)), mean)).alias(rate))
    if n_sources <= BROADCAST_SOURCES:
        rated = docs.withColumn(source, key).join(F.broadcast(rates), source)
    else:  # a hot source is dealt out over 64 salts; its one row of rates is repeated
        dealt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(64)).cast("int")
        many = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(63))))
        rated = docs.withColumn(source, key).withColumn(salt, dealt).join(many, [source, salt])
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    out = rated.withColumn("n_copies", copies(seed, ident, F.col(rate))).where("n_copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", uniform(seed + "/order", ident, F.col("copy_no")))
    # keys are uniform, so ranges of equal width hold equal shares: rows go to them at once, without a pass that samples bounds
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-want // ROWS)))
    out = out.withColumn(where, F.floor(F.col("shuffle_key") * parts).cast("int")).repartitionById(parts, F.col(where))
    return out.sortWithinPartitions("shuffle_key", F.col(f"`{id_col}`"), "copy_no").select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", "n_copies", "shuffle_key")


#: The query's target weights: 1 to 4 by the hash of a source's name, so that unequal targets hold whatever the sources are called.
TARGETS = "1 + cast(conv(substring(md5(source), 1, 4), 16, 10) AS int) % 4"


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.expr(TARGETS))


#: For rates up to PART; beyond, counts are sums of parts.
ORACLE = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS s, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1),
weights AS (SELECT s, n, CAST(1 + CAST('0x' || substr(md5(s), 1, 4) AS INTEGER) % 4 AS DOUBLE) AS w FROM counts),
rates AS (SELECT s, w / (SELECT sum(w) FROM weights) * (SELECT sum(n) FROM weights) / n AS rate FROM weights),
steps AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < 500
),
drawn AS (
  SELECT d.*, coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS ident,
         CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d
),
counted AS (
  SELECT d.doc_id, d.ident, CAST((SELECT count(*) FROM steps t WHERE t.s = d.s AND t.cdf <= d.u) AS INTEGER) AS n_copies FROM drawn d
),
copies AS (SELECT doc_id, ident, n_copies, unnest(range(1, n_copies + 1))::INTEGER AS copy_no FROM counted WHERE n_copies > 0)
SELECT c.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no, c.n_copies,
       CAST(CAST('0x' || substr(md5('mix/order|' || c.ident || '|' || CAST(c.copy_no AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS shuffle_key
FROM copies c JOIN documents d USING (doc_id)
"""
