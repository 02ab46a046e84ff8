"""Catalogue operators: availability, duplicates, search, aggregates, windows and merges. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import tags, text
from ..sources.scratch import cut
from ..sources.tables import bridge, items, table, upsert

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The catalogue in SQL.
ITEMS = """(SELECT p_partkey AS item_id, p_name AS title, p_brand AS author, p_type AS album, p_size AS tempo, p_retailprice AS price,
 printf('happy:0.%02d,sad:0.%02d,danceable:0.%02d,party:0.%02d', p_size * 2 - 1, p_partkey * 7 % 100, p_partkey * 13 % 100, p_partkey * 29 % 100) AS tags FROM part)"""
PAIRS = f"(SELECT item_id, title, author, album, tempo, split_part(kv, ':', 1) AS label, CAST(split_part(kv, ':', 2) AS DOUBLE) AS score FROM (SELECT *, unnest(string_split(tags, ',')) AS kv FROM {ITEMS} i) u)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS)
        return f

    return add


# --- filters, semi and anti joins ----------------------------------------------------------------------------


@query("SELECT item_id, title FROM $ITEMS i WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = item_id AND l_suppkey = 3) OR item_id % 50 = 0")
def availability_semi(spark: SparkSession, sf_dir: str):
    """On the server, or of the default library under an old id."""
    here = bridge(spark, sf_dir).where("server_id = 3").select("item_id", F.lit(True).alias("here")).distinct()
    return items(spark, sf_dir).join(here, "item_id", "left").where("here or item_id % 50 = 0").select("item_id", "title")


@query("SELECT item_id, author FROM $ITEMS i WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = item_id AND l_quantity > 45)")
def orphans_anti(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item_id"))
    return items(spark, sf_dir).join(have, "item_id", "left_anti").select("item_id", "author")


@query("SELECT s_suppkey AS server_id, count(l.l_partkey) AS mapped, (SELECT count(*) FROM part) - count(DISTINCT l.l_partkey) AS unmapped FROM supplier LEFT JOIN lineitem l ON l_suppkey = s_suppkey GROUP BY 1")
def unmapped_by_server(spark, sf_dir):
    per = bridge(spark, sf_dir).groupBy("server_id").agg(F.count("item_id").alias("mapped"), F.countDistinct("item_id").alias("u"))
    total = table(spark, sf_dir, "part").count()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server_id"))
    return s.join(per, "server_id", "left").select("server_id", F.coalesce("mapped", F.lit(0)).alias("mapped"), (F.lit(total) - F.coalesce("u", F.lit(0))).alias("unmapped"))


@query("SELECT l_suppkey AS server_id, l_partkey AS item_id, count(*) AS files, min(l_orderkey * 10 + l_linenumber) AS first_id FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return bridge(spark, sf_dir).groupBy("server_id", "item_id").agg(F.count("*").alias("files"), F.min("provider_id").alias("first_id")).where("files > 1")


@query("SELECT server_id, count(*) AS groups, sum(files)::BIGINT AS files FROM (SELECT l_suppkey AS server_id, l_partkey, count(*) AS files FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x GROUP BY 1")
def dup_groups_per_server(spark, sf_dir):
    return dup_groups(spark, sf_dir).groupBy("server_id").agg(F.count("*").alias("groups"), F.sum("files").alias("files"))


@query("SELECT l_suppkey AS server_id, l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS provider_id FROM lineitem WHERE (l_suppkey, l_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2)")
def dup_expand(spark, sf_dir):
    b = bridge(spark, sf_dir)
    many = b.groupBy("server_id", "item_id").count().where("count > 2").select("server_id", "item_id")
    return b.join(many, ["server_id", "item_id"], "left_semi")


@query("""WITH d AS (SELECT l_suppkey AS server_id, l_partkey AS item_id, list_sort(list(l_quantity)) AS q, max(l_quantity) - min(l_quantity) AS gap, count(*) AS n, count(DISTINCT l_returnflag) AS folders FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT server_id, item_id, n, CASE WHEN folders < n THEN 'false' WHEN gap <= 1.0 THEN 'real' ELSE 'unsure' END AS verdict, CASE WHEN gap <= 1.0 THEN q[1] END AS length FROM d""")
def dup_classify(spark, sf_dir):
    """Files of one folder can't be one recording; lengths that agree make a real group with their least as its length."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_partkey").alias("item_id")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("folders")).where("n > 1")
    near = F.col("hi") - F.col("lo") <= 1.0
    return d.select("server_id", "item_id", "n", F.when(F.col("folders") < F.col("n"), "false").when(near, "real").otherwise("unsure").alias("verdict"), F.when(near, F.col("lo")).alias("length"))


@query("""WITH per AS (SELECT l_suppkey AS s, count(*) AS rows_total, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1),
all_rows AS (SELECT s_suppkey AS server_id, coalesce(rows_total, 0) AS rows_total, coalesce(u, 0) AS uniq FROM supplier LEFT JOIN per ON s = s_suppkey)
SELECT 'server' AS kind, server_id, rows_total, uniq, rows_total - uniq AS duplicates FROM all_rows
UNION ALL SELECT 'overlap', NULL, NULL, (SELECT count(DISTINCT l_partkey) FROM lineitem) - sum(uniq)::BIGINT, NULL FROM all_rows
UNION ALL SELECT 'orphan', NULL, NULL, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)), NULL""")
def server_metrics(spark, sf_dir):
    """Rows, unique and duplicate items of each server, and derived rows: what servers share (negative), what none has."""
    b = bridge(spark, sf_dir)
    per = b.groupBy("server_id").agg(F.count("*").alias("rows_total"), F.countDistinct("item_id").alias("uniq"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server_id")).join(per, "server_id", "left").na.fill(0, ["rows_total", "uniq"])
    none = F.lit(None).cast("long")
    one = s.select(F.lit("server").alias("kind"), "server_id", "rows_total", "uniq", (F.col("rows_total") - F.col("uniq")).alias("duplicates"))
    every = b.agg(F.countDistinct("item_id").alias("n"))
    overlap = s.agg(F.sum("uniq").alias("t")).crossJoin(every).select(F.lit("overlap").alias("kind"), none.alias("server_id"), none.alias("rows_total"), (F.col("n") - F.col("t")).alias("uniq"), none.alias("duplicates"))
    orphan = items(spark, sf_dir).join(b, "item_id", "left_anti").agg(F.count("*").alias("uniq")).select(F.lit("orphan").alias("kind"), none.alias("server_id"), none.alias("rows_total"), "uniq", none.alias("duplicates"))
    return one.unionByName(overlap).unionByName(orphan)


@query("SELECT item_id, title, author, tempo FROM $ITEMS i WHERE (tags LIKE '%happy:0.9%' OR item_id * 13 % 100 >= 50) AND tempo BETWEEN 10 AND 40 AND lower(album) LIKE '%small%' AND item_id * 7 % 100 < 30 AND author NOT IN ('Brand#11', 'Brand#22')")
def catalogue_search(spark, sf_dir):
    """OR within a dimension, AND across: scores, ranges, contained text, excluded scores and authors."""
    i = items(spark, sf_dir)
    good = tags.has_at_least(F.col("tags"), "happy", 0.9) | tags.has_at_least(F.col("tags"), "danceable", 0.5)
    return i.where(good & F.col("tempo").between(10, 40) & F.lower("album").contains("small") & ~tags.has_at_least(F.col("tags"), "sad", 0.3) & ~F.col("author").isin("Brand#11", "Brand#22")).select("item_id", "title", "author", "tempo")


@query("SELECT item_id, title, score FROM (SELECT item_id, title, CASE WHEN lower(title) LIKE '%ring%' THEN 3 ELSE 0 END + CASE WHEN lower(author) LIKE '%ring%' THEN 2 ELSE 0 END + CASE WHEN lower(album) LIKE '%ring%' THEN 1 ELSE 0 END + CASE WHEN lower(title) LIKE '%1%' THEN 3 ELSE 0 END + CASE WHEN lower(author) LIKE '%1%' THEN 2 ELSE 0 END + CASE WHEN lower(album) LIKE '%1%' THEN 1 ELSE 0 END AS score, lower(title || ' ' || author || ' ' || album) AS k FROM $ITEMS i) x WHERE k LIKE '%ring%' AND k LIKE '%1%' ORDER BY score DESC, item_id LIMIT 50")
def token_search(spark, sf_dir):
    """Every token in title, author or album; weights 3, 2, 1 for where; top 50."""
    i = items(spark, sf_dir).withColumn("k", text.search_key(F.col("title"), F.col("author"), F.col("album")))
    score, found = F.lit(0), F.lit(True)
    for token in ("ring", "1"):
        found &= F.col("k").contains(token)
        for col, w in (("title", 3), ("author", 2), ("album", 1)):
            score = score + F.when(F.lower(col).contains(token), w).otherwise(0)
    return i.where(found).select("item_id", "title", score.alias("score")).orderBy(F.desc("score"), "item_id").limit(50)


@query("SELECT item_id, title, author FROM $ITEMS i WHERE author ILIKE 'brand#1%' ORDER BY author NULLS LAST, album NULLS LAST, title NULLS LAST, item_id LIMIT 25 OFFSET 50")
def browse_page(spark, sf_dir):
    i = items(spark, sf_dir).where(F.col("author").ilike("brand#1%"))
    return i.orderBy(F.asc_nulls_last("author"), F.asc_nulls_last("album"), F.asc_nulls_last("title"), "item_id").offset(50).limit(25).select("item_id", "title", "author")


@query("SELECT item_id, substr(md5(title || '|' || author || '|' || album || '|' || tempo), 1, 16) AS fp FROM $ITEMS i")
def sync_manifest(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", text.content_hash(F.col("title"), F.col("author"), F.col("album"), F.col("tempo")).alias("fp"))


@query("WITH a AS (SELECT item_id, md5(title) AS fp FROM $ITEMS i WHERE item_id % 10 <> 0), b AS (SELECT item_id, md5(CASE WHEN item_id % 7 = 0 THEN 'x' ELSE title END) AS fp FROM $ITEMS i WHERE item_id % 11 <> 0) SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN b.item_id IS NULL THEN 'delete' WHEN a.item_id IS NULL THEN 'add' ELSE 'update' END AS change FROM a FULL JOIN b ON a.item_id = b.item_id WHERE a.fp IS DISTINCT FROM b.fp")
def manifest_diff(spark, sf_dir):
    i = items(spark, sf_dir)
    a = i.where("item_id % 10 <> 0").select("item_id", F.md5("title").alias("fa"))
    b = i.where("item_id % 11 <> 0").select("item_id", F.md5(F.when(F.col("item_id") % 7 == 0, "x").otherwise(F.col("title"))).alias("fb"))
    return a.join(b, "item_id", "full_outer").where(~F.col("fa").eqNullSafe(F.col("fb"))).select("item_id", F.when(F.col("fb").isNull(), "delete").when(F.col("fa").isNull(), "add").otherwise("update").alias("change"))


# --- aggregates ----------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (tempo < 13) AS slow, count(*) FILTER (tempo >= 13 AND tempo < 26) AS medium, count(*) FILTER (tempo >= 26 AND tempo < 40) AS fast, count(*) FILTER (tempo >= 40) AS very_fast, round(avg(tempo), 1) AS mean_tempo, min(tempo) AS lowest, max(tempo) AS highest FROM $ITEMS i")
def tempo_profile(spark, sf_dir):
    t = F.col("tempo")
    return items(spark, sf_dir).agg(F.count_if(t < 13).alias("slow"), F.count_if((t >= 13) & (t < 26)).alias("medium"), F.count_if((t >= 26) & (t < 40)).alias("fast"), F.count_if(t >= 40).alias("very_fast"), F.round(F.avg("tempo"), 1).alias("mean_tempo"), F.min("tempo").alias("lowest"), F.max("tempo").alias("highest"))


@query("SELECT label, count(*) AS n, round(sum(score), 6) AS total FROM $PAIRS p WHERE score >= 0.5 GROUP BY label ORDER BY n DESC, label LIMIT 15")
def tag_histogram(spark, sf_dir):
    pairs = items(spark, sf_dir).select(F.explode(tags.parse(F.col("tags"))).alias("label", "score"))
    return pairs.where("score >= 0.5").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total")).orderBy(F.desc("n"), "label").limit(15)


@query("SELECT label, count(*) AS n FROM (SELECT item_id, max(label) AS label FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS m FROM $PAIRS p) x WHERE score = m AND m > 0 GROUP BY item_id HAVING count(*) = 1) y GROUP BY label")
def dominant_label_hist(spark, sf_dir):
    """Label of the highest score; ties count for none."""
    return items(spark, sf_dir).select(tags.top(F.col("tags")).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT item_id, score AS happy FROM $PAIRS p WHERE label = 'happy' AND score >= 0.8")
def tag_threshold_search(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", tags.score(F.col("tags"), "happy").alias("happy")).where("happy >= 0.8")


@query("SELECT author, label, round(sum(score) / count(*), 6) AS mean_score FROM $PAIRS p GROUP BY 1, 2")
def tag_mean_by_group(spark, sf_dir):
    pairs = items(spark, sf_dir).select("author", F.explode(tags.parse(F.col("tags"))).alias("label", "score"))
    return pairs.groupBy("author", "label").agg(F.round(F.sum("score") / F.count("*"), 6).alias("mean_score"))


@query("SELECT count(*) AS albums FROM (SELECT DISTINCT coalesce(nullif(CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN NULL ELSE 'VA' END, ''), author), album FROM $ITEMS i) x")
def album_identity_count(spark, sf_dir):
    artist = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.lit(None)).otherwise("VA")
    return items(spark, sf_dir).select(F.coalesce(F.nullif(artist, F.lit("")), "author").alias("a"), "album").distinct().agg(F.count("*").alias("albums"))


@query("SELECT author, md5(string_agg(item_id::VARCHAR, ',' ORDER BY item_id)) AS signature, count(*) AS n FROM $ITEMS i GROUP BY 1")
def artist_signature(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return items(spark, sf_dir).groupBy("author").agg(F.md5(ids).alias("signature"), F.count("*").alias("n"))


@query("SELECT q AS queue, coalesce(n, 0) AS backlog FROM (VALUES ('O'), ('P'), ('Q')) AS d(q) LEFT JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) c ON s = q")
def queue_backlog(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("queue")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("O",), ("P",), ("Q",)], "queue string").join(n, "queue", "left").select("queue", F.coalesce("n", F.lit(0)).alias("backlog"))


@query("SELECT l_partkey AS item_id, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) AS mask FROM lineitem GROUP BY 1")
def feature_mask(spark, sf_dir):
    m = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.bit_or(m).alias("mask"))


@query("SELECT author, round(quantile_cont(tempo::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(tempo::DOUBLE, 0.9), 6) AS p90 FROM $ITEMS i GROUP BY 1")
def percentiles(spark, sf_dir):
    t = F.col("tempo").cast("double")
    return items(spark, sf_dir).groupBy("author").agg(F.round(F.percentile(t, 0.5), 6).alias("p50"), F.round(F.percentile(t, 0.9), 6).alias("p90"))


@query("SELECT p_type AS album, p_brand AS top_author, n FROM (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) x WHERE r = 1")
def dominant_by_tally(spark, sf_dir):
    n = items(spark, sf_dir).groupBy("album", "author").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("album").orderBy(F.desc("n"), "author"))).where("r = 1").select("album", F.col("author").alias("top_author"), "n")


@query("SELECT s_nationkey AS nation, count(*) AS n, array_to_string((list(s_name ORDER BY s_name))[1:5], '; ') AS sample FROM supplier GROUP BY 1")
def unmatched_samples(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("s_name")), 1, 5), "; ").alias("sample"))


# --- windows and merges --------------------------------------------------------------------------------------


@query("SELECT o_custkey AS owner, o_orderkey AS task, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) x WHERE r = 1")
def distinct_on_latest(spark, sf_dir):
    """Latest state of each key: one aggregate, no window."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return last.select("owner", F.col("m.o_orderkey").alias("task"), F.col("m.o_orderstatus").alias("status"))


@query("SELECT o_custkey AS owner, o_orderkey AS task FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) x WHERE r <= 3")
def history_trim(spark, sf_dir):
    r = F.dense_rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate")))
    return table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 3").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("task"))


@query("WITH b AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1.5 END AS price, 'new' AS status FROM orders WHERE o_orderkey % 5 = 0) SELECT coalesce(b.k, d.k) AS k, CASE WHEN d.k IS NULL THEN b.price ELSE coalesce(d.price, b.price) END AS price, CASE WHEN d.k IS NULL THEN b.status ELSE d.status END AS status FROM b FULL JOIN d ON b.k = d.k")
def upsert_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    delta = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(1.5).alias("price"), F.lit("new").alias("status"))
    return upsert(base, delta, ["k"], ("price",))


@query("SELECT o_orderpriority AS queue, o_orderkey AS task, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') x WHERE r <= 10")
def claim_order(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("place", r).where("place <= 10").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("task"), "place")


RANKED = "(SELECT *, row_number() OVER (ORDER BY price DESC, item_id) AS rk FROM $ITEMS i WHERE tempo > 30)"


@query(f"SELECT item_id, author, rk FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY rk) AS a FROM {RANKED} r) x ORDER BY greatest(a, 2), rk LIMIT 100")
def cap_relax(spark, sf_dir):
    """The cap per author rises until enough are found: in closed form, order by how high the cap must be."""
    top = W.partitionBy("author").orderBy(F.desc("price"), "item_id")
    i = items(spark, sf_dir).where("tempo > 30").withColumn("a", F.row_number().over(top)).where("a <= 100")  # a rank over the limit is never chosen
    best = i.orderBy(F.greatest("a", F.lit(2)), F.desc("price"), "item_id").limit(100)
    best = best.select("item_id", "author", "price")
    # ranks of the hundred chosen rows: how many are before each, counted where they lie instead of in one ordered task
    other = items(spark, sf_dir).where("tempo > 30").select(F.col("price").alias("p"), F.col("item_id").alias("o"))
    before = other.join(F.broadcast(best), (F.col("p") > F.col("price")) | ((F.col("p") == F.col("price")) & (F.col("o") <= F.col("item_id"))))
    return before.groupBy("item_id", "author").agg(F.count("*").alias("rk"))


@query("WITH a AS (SELECT item_id, row_number() OVER (ORDER BY price DESC, item_id) AS r FROM $ITEMS i ORDER BY r LIMIT 100), b AS (SELECT item_id, row_number() OVER (ORDER BY tempo DESC, item_id) AS r FROM $ITEMS i ORDER BY r LIMIT 100) SELECT item_id, round(sum(1 - (r - 1) / 100.0::DOUBLE), 6) AS score, count(*) AS hits FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY 1 ORDER BY hits DESC, score DESC, item_id LIMIT 50")
def rank_fusion(spark, sf_dir):
    i = items(spark, sf_dir)
    ranked = lambda *o: i.orderBy(*o).limit(100).withColumn("r", F.row_number().over(W.orderBy(*o))).select("item_id", "r")
    both = ranked(F.desc("price"), "item_id").union(ranked(F.desc("tempo"), "item_id"))
    out = both.groupBy("item_id").agg(F.round(F.sum(1 - (F.col("r") - 1) / 100.0), 6).alias("score"), F.count("*").alias("hits"))
    return out.orderBy(F.desc("hits"), F.desc("score"), "item_id").limit(50)


@query("SELECT item_id, author, round_no FROM (SELECT item_id, author, row_number() OVER (PARTITION BY author ORDER BY price DESC, item_id) AS round_no FROM $ITEMS i) x ORDER BY round_no, author, item_id LIMIT 60")
def round_robin(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("author").orderBy(F.desc("price"), "item_id"))
    return items(spark, sf_dir).select("item_id", "author", r.alias("round_no")).where("round_no <= 60").orderBy("round_no", "author", "item_id").limit(60)


@query("""WITH s AS (SELECT i.item_id, happy, party FROM (SELECT item_id, max(score) FILTER (label = 'happy') AS happy, max(score) FILTER (label = 'party') AS party FROM $PAIRS p GROUP BY 1) i),
n AS (SELECT count(*) FILTER (happy >= 0.95 AND party >= 0.95) AS a, count(*) FILTER (happy >= 0.8 AND party >= 0.8) AS b, count(*) FILTER (happy >= 0.6 AND party >= 0.6) AS c FROM s),
t AS (SELECT CASE WHEN a >= 50 THEN 0.95 WHEN b >= 50 THEN 0.8 WHEN c >= 50 THEN 0.6 ELSE 0.2 END::DOUBLE AS t FROM n)
SELECT item_id, happy, party, t AS threshold FROM s, t WHERE happy >= t AND party >= t""")
def relax_threshold(spark, sf_dir):
    """Thresholds fall until 50 rows are found: all steps are counted in one pass."""
    i = items(spark, sf_dir).select("item_id", tags.score(F.col("tags"), "happy").alias("happy"), tags.score(F.col("tags"), "party").alias("party"))
    low = F.least("happy", "party")
    steps = (0.95, 0.8, 0.6)
    counts = i.agg(*[F.count_if(low >= s).alias(f"n{k}") for k, s in enumerate(steps)]).first()
    t = next((s for k, s in enumerate(steps) if counts[k] >= 50), 0.2)
    return i.where(low >= t).withColumn("threshold", F.lit(t))


@query("WITH s AS (SELECT *, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS a, (tempo - min(tempo) OVER ()) / (max(tempo) OVER () - min(tempo) OVER ())::DOUBLE AS b, CASE WHEN author = 'Brand#12' THEN 1 ELSE 0 END + CASE WHEN album LIKE '%STANDARD%' THEN 1 ELSE 0 END AS hits FROM $ITEMS i WHERE tempo > 5) SELECT item_id, hits, round((a + b) / 2, 6) AS score FROM s ORDER BY hits DESC, round((a + b) / 2, 6) DESC, item_id LIMIT 40")
def soft_rerank(spark, sf_dir):
    i = items(spark, sf_dir).where("tempo > 5")
    m = i.agg(F.min("price").alias("p0"), F.max("price").alias("p1"), F.min("tempo").alias("t0"), F.max("tempo").alias("t1"))
    x = i.crossJoin(F.broadcast(m))  # one row
    a, b = (F.col("price") - F.col("p0")) / (F.col("p1") - F.col("p0")), (F.col("tempo") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    hits = F.when(F.col("author") == "Brand#12", 1).otherwise(0) + F.when(F.col("album").contains("STANDARD"), 1).otherwise(0)
    return x.select("item_id", hits.alias("hits"), F.round((a + b) / 2, 6).alias("score")).orderBy(F.desc("hits"), F.desc("score"), "item_id").limit(40)


@query("SELECT item_id, genre FROM (SELECT vec_id AS item_id, label AS genre, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings) x WHERE r <= 7")
def stratified_quota(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("genre"))
    r = F.row_number().over(W.partitionBy("genre").orderBy(F.md5(F.col("item_id").cast("string")), "item_id"))
    return e.withColumn("r", r).where("r <= 7").drop("r")


@query("WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM $ITEMS i) SELECT item_id FROM r WHERE k IN (SELECT CAST(floor(j * (n - 1) / 24.0::DOUBLE) AS BIGINT) FROM range(25) t(j), (SELECT max(n) AS n FROM r) m)")
def linspace_sample(spark, sf_dir):
    """25 rows at even steps of the order. Places come from counts of ranges of ids, so that no task numbers all rows."""
    i = items(spark, sf_dir).select("item_id")
    n = i.count()
    span = i.withColumn("part", F.floor(F.col("item_id") / 1000))
    base = span.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    k = F.row_number().over(W.partitionBy("part").orderBy("item_id")) - 1 + F.col("before")
    wanted = sorted({int(j * (n - 1) / 24.0) for j in range(25)}) if n else []
    return span.join(base, "part").select("item_id", k.alias("k")).where(F.col("k").isin(wanted)).select("item_id")


@query("SELECT item_id, min(pos) AS pos FROM (SELECT item_id, row_number() OVER (ORDER BY price DESC, item_id) AS pos FROM $ITEMS i UNION ALL SELECT item_id, 1000000 + row_number() OVER (ORDER BY tempo DESC, item_id) FROM $ITEMS i) u GROUP BY 1 ORDER BY pos LIMIT 80")
def ordered_union(spark, sf_dir):
    i = items(spark, sf_dir)
    ranked = lambda base, *o: i.orderBy(*o).limit(80).select("item_id", (F.lit(base) + F.row_number().over(W.orderBy(*o))).alias("pos"))
    both = ranked(0, F.desc("price"), "item_id").union(ranked(1_000_000, F.desc("tempo"), "item_id"))
    return both.groupBy("item_id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(80)


@query("""WITH old AS (SELECT c_custkey AS o, lower(c_name) AS n, c_nationkey AS k, right(c_name, 2) AS t FROM customer), new AS (SELECT s_suppkey AS w, lower(s_name) AS n, s_nationkey AS k, right(s_name, 2) AS t FROM supplier),
c AS (SELECT o, w, 1 AS tier FROM old JOIN new ON old.n = new.n UNION ALL SELECT o, w, 2 FROM old JOIN new ON old.t = new.t AND old.k = new.k UNION ALL SELECT o, w, 3 FROM old JOIN new ON old.t = new.t),
a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY tier, w) AS r FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tier, o) AS q FROM a WHERE r = 1)
SELECT o AS old_id, w AS new_id, tier FROM b WHERE q = 1""")
def tier_match(spark, sf_dir):
    """Tiers of equi-joins; the best tier per old row, then a new id is claimed once, by the best."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old_id"), F.lower("c_name").alias("n"), F.col("c_nationkey").alias("k"), F.expr("right(c_name, 2)").alias("t"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("new_id"), F.lower("s_name").alias("n"), F.col("s_nationkey").alias("k"), F.expr("right(s_name, 2)").alias("t"))
    found = None
    for tier, keys in enumerate((["n"], ["t", "k"], ["t"]), 1):
        # the smallest new id of a key is all that a tier can yield
        one = new.groupBy(*keys).agg(F.min("new_id").alias("new_id"))
        got = old.join(one, keys).select("old_id", "new_id", F.lit(tier).alias("tier"))
        found = got if found is None else found.unionByName(got)
    best = found.groupBy("old_id").agg(F.min(F.struct("tier", "new_id")).alias("m")).select("old_id", "m.tier", "m.new_id")
    return best.groupBy("new_id").agg(F.min(F.struct("tier", "old_id")).alias("m")).select("m.old_id", "new_id", "m.tier")


# --- text ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) >= 250 AS long_enough, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_chars, length(text) AS chars FROM documents")
def text_quality(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(t) >= 250).alias("long_enough"), F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")).cast("long").alias("ascii_chars"), F.length(t).cast("long").alias("chars"))


@query("SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\\p{L}')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '\\p{L}'))::DOUBLE ELSE 0 END, 6) AS latin FROM documents")
def script_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.ratio_of(F.col("text"), "[A-Za-z]"), 6).alias("latin"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '\\s+-\\s.*$', ''), '\\s+', ' ', 'g')) AS title, translate(lower(author), ' -/''#', '') AS author FROM (SELECT item_id, title || ' (Live) [x] - Remaster' AS t, author FROM $ITEMS i) x")
def normalize_meta(spark, sf_dir):
    i = items(spark, sf_dir)
    return i.select("item_id", text.clean_title(F.concat("title", F.lit(" (Live) [x] - Remaster"))).alias("title"), F.translate(text.match_key(F.col("author")), "#", "").alias("author"))


@query("SELECT page_id, array_to_string(p[greatest(1, len(p) - 2):], '/') AS tail FROM (SELECT page_id, list_filter(string_split(lower(url), '/'), lambda x: x <> '') AS p FROM pages) x")
def path_tail(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_tail(F.col("url")).alias("tail"))


@query("SELECT a.s_suppkey AS a_id, b.s_suppkey AS b_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey AND len(list_intersect(list_distinct([substr('  ' || lower(a.s_name) || ' ', i::BIGINT, 3) for i in range(1, length(a.s_name) + 2)]), list_distinct([substr('  ' || lower(b.s_name) || ' ', i::BIGINT, 3) for i in range(1, length(b.s_name) + 2)]))) / len(list_distinct([substr('  ' || lower(a.s_name) || ' ', i::BIGINT, 3) for i in range(1, length(a.s_name) + 2)] || [substr('  ' || lower(b.s_name) || ' ', i::BIGINT, 3) for i in range(1, length(b.s_name) + 2)]))::DOUBLE >= 0.8")
def trigram_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("cell"))
    return alike(s, 0.8)


def alike(rows: DataFrame, least: float) -> DataFrame:
    """(a_id, b_id) of the rows (id, name, cell) of one cell whose trigrams are alike, exact: only names that share a rare trigram are compared.

    Sets of n and of m trigrams with ``least`` of their union in common have least * n and least * m of them in common. In one order of all
    trigrams, the n - ceil(least * n) + 1 first of one and as many of the other then meet. Equal names are compared once.
    """
    rows = rows.where("cell is not null and name is not null")
    # a trigram as one whole number
    code = lambda x: F.shiftleft(F.ascii(x).cast("long"), 42) + F.shiftleft(F.ascii(F.substring(x, 2, 1)).cast("long"), 21) + F.ascii(F.substring(x, 3, 1))
    names = rows.select("cell", "name").distinct().select("cell", "name", F.explode(F.transform(text.trigrams(F.col("name")), code)).alias("gram"))
    order = names.groupBy("gram").agg(F.count("*").alias("many"))
    sets = names.join(order, "gram").groupBy("cell", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("many", "gram"))), lambda x: x["gram"]).alias("t"))
    n = F.size("t")
    first = cut(sets.select("cell", "name", "t", F.explode(F.slice("t", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))).alias("gram")))
    a, b = (first.select("cell", "gram", F.col("name").alias(f"{s}n"), F.col("t").alias(f"{s}t")) for s in "ab")
    n, m, both = F.size("at"), F.size("bt"), F.size(F.array_intersect("at", "bt"))
    pairs = a.join(b, ["cell", "gram"]).where("an < bn").where(F.least(n, m) >= least * F.greatest(n, m) - 1e-9)
    pairs = pairs.where(both / (n + m - both) >= least).select("cell", "an", "bn").distinct()
    one, two = (rows.select("cell", F.col("name").alias(f"{s}n"), F.col("id").alias(f"{s}_id")) for s in "ab")
    other = pairs.join(one, ["cell", "an"]).join(two, ["cell", "bn"]).where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
    same = one.join(two.withColumnRenamed("bn", "an"), ["cell", "an"]).where("a_id < b_id").select("a_id", "b_id")
    return other.unionByName(same)


# --- events --------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT to_timestamp(s * 43200) ::TIMESTAMP AS start, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 43200) AS BIGINT) - k AS s FROM events, range(2) t(k)) x GROUP BY 1")
def sliding_counts(spark, sf_dir):
    """A day's window every half day."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, s")
def sessions_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("w")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view' OR event_type = 'click'")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
