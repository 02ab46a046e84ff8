"""Library upkeep and shaping of results: pages, guards, cascades, allocation, schedules, histories. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import schedule, tags, text, vec
from ..sources.tables import bridge, items, table, vectors
from .relational import ITEMS, PAIRS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS)
        return f

    return add


# --- scans and predicates ------------------------------------------------------------------------------------


def keyset_page_of(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The ``n`` rows after a key: the predicate reaches the scan, so later pages cost what the first does."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(n)


@query("SELECT item_id, title FROM $ITEMS i WHERE item_id > 120 ORDER BY item_id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str):
    return keyset_page_of(items(spark, sf_dir).select("item_id", "title"), "item_id", 120, 50)


@query("SELECT vec_id AS item_id, len(embedding) AS dim FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) u WHERE x IS NULL OR NOT isfinite(x)) AND len(embedding) = 64")
def finite_vectors(spark, sf_dir):
    """Vectors of the right size without null or non-finite components."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where(vec.finite(F.col("v")) & (F.size("v") == 64)).select("item_id", F.size("v").cast("long").alias("dim"))


@query("SELECT p_partkey AS item_id, CASE WHEN v.vec_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l.k IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN d.doc_id IS NOT NULL THEN 4 ELSE 0 END AS done FROM part LEFT JOIN embeddings v ON vec_id = p_partkey LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) l ON k = p_partkey LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = p_partkey")
def work_map(spark, sf_dir):
    """What of each item's analysis is there, as bits."""
    has = lambda df, col, name: df.select(F.col(col).alias("item_id")).distinct().withColumn(name, F.lit(True))
    i = items(spark, sf_dir).select("item_id")
    i = i.join(has(table(spark, sf_dir, "embeddings"), "vec_id", "a"), "item_id", "left").join(has(table(spark, sf_dir, "lineitem").where("l_quantity > 40"), "l_partkey", "b"), "item_id", "left")
    i = i.join(has(table(spark, sf_dir, "documents"), "doc_id", "c"), "item_id", "left")
    return i.select("item_id", sum((F.when(F.col(c), bit).otherwise(0) for c, bit in (("a", 1), ("b", 2), ("c", 4))), F.lit(0)).alias("done"))


@query("SELECT item_id, title FROM $ITEMS i WHERE (abs((tempo * 2 - 1) / 100.0::DOUBLE - (SELECT (tempo * 2 - 1) / 100.0::DOUBLE FROM $ITEMS s WHERE item_id = 5)) + abs(item_id * 7 % 100 / 100.0::DOUBLE - 0.35) + abs(item_id * 13 % 100 / 100.0::DOUBLE - 0.65)) / 3 <= 0.2001 AND item_id <> 5")
def mood_distance(spark, sf_dir):
    """Mean absolute difference over labels to a seed; the seed is one row, read once."""
    i = items(spark, sf_dir)
    seed = i.where("item_id = 5").select(F.col("tags").alias("seed"))
    return i.where("item_id <> 5").crossJoin(F.broadcast(seed)).where(tags.gap(F.col("tags"), F.col("seed"), ["happy", "sad", "danceable"]) <= 0.2001).select("item_id", "title")


def unless_emptied(df: DataFrame, keep: Column) -> DataFrame:
    """The rows to keep; all rows if none would be left."""
    return df.where(keep) if df.where(keep).limit(1).count() else df


@query("SELECT 'some' AS pool, item_id FROM $ITEMS i WHERE author NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT 'all', item_id FROM $ITEMS j")
def exclusion_guard(spark, sf_dir):
    """Excluded authors go unless that empties the pool."""
    i = items(spark, sf_dir)
    some = unless_emptied(i, ~F.col("author").isin("Brand#11", "Brand#12")).select(F.lit("some").alias("pool"), "item_id")
    return some.unionByName(unless_emptied(i, F.col("author") == "nobody").select(F.lit("all").alias("pool"), "item_id"))


@query("SELECT item_id, regexp_matches(lower(title), '(^| )(ring|promo|intro|skit|outro)( |$)') AS demoted FROM $ITEMS i ORDER BY demoted, price DESC, item_id LIMIT 200")
def demote_titles(spark, sf_dir):
    """Titles with a marker word come last."""
    bad = F.lower("title").rlike("(^| )(ring|promo|intro|skit|outro)( |$)")
    return items(spark, sf_dir).select("item_id", bad.alias("demoted"), "price").orderBy("demoted", F.desc("price"), "item_id").limit(200).drop("price")


# --- joins and merges ----------------------------------------------------------------------------------------


@query("WITH a AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE author END AS owner FROM $ITEMS i), b AS (SELECT owner, count(*) AS n FROM a GROUP BY 1) SELECT a.item_id, b.n FROM a JOIN b ON a.owner IS NOT DISTINCT FROM b.owner")
def null_safe_join(spark, sf_dir):
    """A null owner meets the null owner."""
    a = items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 5 != 0, F.col("author")).alias("owner"))
    b = a.groupBy(F.col("owner").alias("o")).agg(F.count("*").alias("n"))
    return a.join(b, a.owner.eqNullSafe(b.o)).select("item_id", "n")


@query("SELECT l_suppkey AS server_id, l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS provider_id FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT l_returnflag) < count(*))")
def split_false_merges(spark, sf_dir):
    """All rows of groups with two files in one folder are unmapped."""
    false = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("f")).where("n > 1 and f < n")
    return bridge(spark, sf_dir).join(false, ["server_id", "item_id"], "left_anti")


@query("""WITH m AS (SELECT l_suppkey AS server_id, l_orderkey * 10 + l_linenumber AS provider_id, l_discount < 0.01 * (l_suppkey % 11) AS fetched FROM lineitem)
SELECT server_id, count(*) AS mapped, count(*) FILTER (fetched) AS fetched, CASE WHEN count(*) FILTER (fetched) < 0.5 * count(*) THEN 0 ELSE count(*) FILTER (NOT fetched) END AS pruned FROM m GROUP BY 1""")
def prune_guard(spark, sf_dir):
    """Mappings that a fetch lacks go, unless it holds under half of what is mapped."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("server_id"), (F.col("l_discount") < 0.01 * (F.col("l_suppkey") % 11)).alias("here"))
    n = m.groupBy("server_id").agg(F.count("*").alias("mapped"), F.count_if("here").alias("fetched"))
    return n.withColumn("pruned", F.when(F.col("fetched") < 0.5 * F.col("mapped"), 0).otherwise(F.col("mapped") - F.col("fetched")))


@query("""WITH gone AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47))
SELECT p_partkey AS item_id FROM gone WHERE (SELECT count(*) FROM gone) <= 0.5 * (SELECT count(*) FROM part)""")
def clean_library(spark, sf_dir):
    """Items on no server; none at all if they are over half of the catalogue."""
    i = items(spark, sf_dir).select("item_id")
    gone = i.join(table(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("item_id")), "item_id", "left_anti")
    return gone if gone.count() <= 0.5 * i.count() else gone.limit(0)


@query("""WITH s AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_returnflag <> 'N' THEN l_shipmode END AS mode, l_quantity AS q FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS l_shipmode FROM lineitem) x)
SELECT k AS item_id, arg_max(q, o) AS quantity, arg_max(mode, o) FILTER (mode IS NOT NULL) AS mode FROM s GROUP BY 1""")
def stage_metadata(spark, sf_dir):
    """The last row of each key; of a nullable field the last value that is not null."""
    x = table(spark, sf_dir, "lineitem")
    mode = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N"), F.col("l_returnflag"))
    s = x.select(F.col("l_partkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), mode.alias("m"), F.col("l_quantity").alias("q"))
    return s.groupBy("item_id").agg(F.max_by("q", "o").alias("quantity"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("o"))).alias("mode"))


@query("SELECT l_suppkey AS server_id, count(*) AS n, md5(string_agg(p::VARCHAR, ',' ORDER BY p)) AS files FROM (SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem JOIN $ITEMS i ON item_id = l_partkey WHERE tempo > 40 GROUP BY l_suppkey, l_partkey) x GROUP BY 1")
def playlist_by_server(spark, sf_dir):
    """A list's items as each server's own ids; what a server lacks is left out."""
    want = items(spark, sf_dir).where("tempo > 40").select("item_id")
    one = bridge(spark, sf_dir).join(want, "item_id", "left_semi").groupBy("server_id", "item_id").agg(F.min("provider_id").alias("p"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x.cast("string")), ",")
    return one.groupBy("server_id").agg(F.count("*").alias("n"), F.md5(ids).alias("files"))


#: (seed, what was typed): one is exact, one differs in case and signs, one is part of a title, two are misspelt.
TYPED = ((1, "small ring"), (2, "SMALL-RING"), (3, "idge"), (4, "smal gizmo"), (5, "rad widgat"), (6, "zzzz"))


@query("""WITH t(seed, typed) AS (VALUES (1, 'small ring'), (2, 'SMALL-RING'), (3, 'idge'), (4, 'smal gizmo'), (5, 'rad widgat'), (6, 'zzzz')), n AS (SELECT DISTINCT p_name AS title, lower(translate(p_name, ' -/''', '')) AS k FROM part),
c AS (SELECT seed, title, CASE WHEN lower(title) = lower(typed) THEN 1 WHEN contains(k, lower(translate(typed, ' -/''', ''))) THEN 2 WHEN lower(title)[1] = lower(typed)[1] AND 100 * (1 - levenshtein(lower(title), lower(typed)) / greatest(length(title), length(typed))::DOUBLE) >= 75 THEN 3 END AS tier,
 levenshtein(lower(title), lower(typed)) AS d FROM t, n)
SELECT seed, title, tier FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY tier, CASE WHEN tier = 3 THEN d ELSE length(title) END, title) AS r FROM c WHERE tier IS NOT NULL) x WHERE r = 1""")
def resolve_seeds(spark, sf_dir):
    """Exact, then the shortest title that holds what was typed, then the closest that starts alike; the few seeds go to all titles."""
    t = F.broadcast(spark.createDataFrame(TYPED, "seed int, typed string"))
    n = items(spark, sf_dir).select("title").distinct()
    a, b = F.lower("title"), F.lower("typed")
    d = F.levenshtein(a, b)
    near = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (100 * (1 - d / F.greatest(F.length("title"), F.length("typed"))) >= 75)
    tier = F.when(a == b, 1).when(F.contains(text.match_key(F.col("title")), text.match_key(F.col("typed"))), 2).when(near, 3)
    c = n.join(t, tier.isNotNull()).withColumn("tier", tier)
    best = c.groupBy("seed").agg(F.min(F.struct("tier", F.when(F.col("tier") == 3, d).otherwise(F.length("title")).alias("o"), "title")).alias("m"))
    return best.select("seed", "m.title", "m.tier")


@query("""WITH w AS (SELECT c_custkey AS k, lower(c_name) AS n FROM customer), v AS (SELECT DISTINCT k, substr(n, 1, 1) AS p, n FROM w), s AS (SELECT s_suppkey AS sk, 'customer#' || substr(s_name, 10) AS n FROM supplier)
SELECT s.sk, v.k FROM s JOIN v ON substr(s.n, 1, 1) = v.p AND right(s.n, 2) = right(v.n, 2) AND 100 * (1 - levenshtein(s.n, v.n) / greatest(length(s.n), length(v.n))::DOUBLE) >= 95""")
def fuzzy_blocked_join(spark, sf_dir):
    """Blocks of the first letter and the last two signs; within a block, edit distance of the names that share a piece."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("n")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), F.concat(F.lit("customer#"), F.substring("s_name", 10, 99)).alias("m"))
    return s.join(close_names(s, c), "m").join(c, "n").select("sk", "k")


def close_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(m, n) of the distinct names of both that begin and end alike and of which 95 % are equal by edit distance, exact.

    At L signs of the longer name that is L / 20 edits at most, so a name of l has l // 19: of one piece more than that, one is unharmed
    and stands in the other name, moved by so many places at most. Most names have no edit to give and meet as they are.
    """
    key = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -2, 2))
    edits = lambda size: F.floor(size / 19).cast("int")
    n = right.select("n").distinct().where("n <> ''").withColumn("size", F.length("n")).withColumn("e", edits(F.col("size")))
    # piece j is from j * size / (e + 1) up to the next one
    start = lambda j: F.floor(j * F.col("size") / (F.col("e") + 1)).cast("int")
    held = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("e")))).select("n", key("n").alias("b"), "size", "j", F.substring("n", start(F.col("j")) + 1, start(F.col("j") + 1) - start(F.col("j"))).alias("piece"))
    m = left.select("m").distinct().where("m <> ''").withColumn("own", F.length("m"))
    # of sizes l with |l - own| <= l // 19: own * 19 / 20 at least, own * 19 / 18 at most
    m = m.withColumn("size", F.explode(F.sequence(F.floor(F.col("own") * 0.95).cast("int"), F.ceil(F.col("own") * 19 / 18).cast("int")))).withColumn("e", edits(F.col("size")))
    m = m.where(F.abs(F.col("size") - F.col("own")) <= F.col("e")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("e"))))
    m = m.withColumn("at", F.explode(F.sequence(start(F.col("j")) - F.col("e"), start(F.col("j")) + F.col("e")))).where("at >= 0")
    asked = m.select("m", key("m").alias("b"), "size", "j", F.substring("m", F.col("at") + 1, start(F.col("j") + 1) - start(F.col("j"))).alias("piece"))
    close = 100 * (1 - F.levenshtein("n", "m") / F.greatest(F.length("n"), F.length("m"))) >= 95
    return asked.join(held, ["b", "size", "j", "piece"]).select("m", "n").distinct().where(close)


# --- aggregates and vectors ----------------------------------------------------------------------------------


@query("WITH t AS (SELECT vec_id, label, vec_id % 3 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT label AS genre, dim, round(CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END, 6) AS x FROM t GROUP BY 1, 2")
def weighted_centroids(spark, sf_dir):
    """Weighted mean of each group's vectors; the plain mean where weights add up to nothing."""
    t = vectors(spark, sf_dir).select("genre", (F.col("item_id") % 3).alias("w"), F.posexplode("v").alias("dim", "x"))
    return t.groupBy("genre", F.col("dim").cast("long").alias("dim")).agg(F.round(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("x")) / F.sum("w")).otherwise(F.avg("x")), 6).alias("x"))


@query("""WITH n AS (SELECT p_type AS source, count(*) AS c FROM part GROUP BY 1), a AS (SELECT source, c, greatest(1, floor(100.0 * c / sum(c) OVER ()))::BIGINT AS q FROM n),
r AS (SELECT item_id, album AS source, row_number() OVER (PARTITION BY album ORDER BY price DESC, item_id) AS place FROM $ITEMS i)
SELECT item_id, source FROM (SELECT item_id, r.source, place > q AS extra, place FROM r JOIN a USING (source)) x ORDER BY extra, place, source LIMIT 100""")
def proportional_allocation(spark, sf_dir):
    """Each source's share of 100 places, at least one; what is left goes to the next of each in turn."""
    i = items(spark, sf_dir).withColumnRenamed("album", "source")
    n = i.groupBy("source").agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"))
    q = n.crossJoin(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.floor(100.0 * F.col("c") / F.col("t"))).alias("q"))
    r = i.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("price"), "item_id"))).where("place <= 100")
    return r.join(F.broadcast(q), "source").orderBy(F.col("place") > F.col("q"), "place", "source").limit(100).select("item_id", "source")


@query("""WITH p AS (SELECT vec_id, unnest(embedding[1:4])::DOUBLE AS x, unnest([0, 1, 2, 3]) AS axis FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, axis) AS r FROM p),
w AS (SELECT a.vec_id, a.axis FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2 AND a.x - b.x >= 0.02)
SELECT axis, count(*) AS votes, round(count(*) / (SELECT count(*) FROM w)::DOUBLE, 6) AS share, round(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS coverage FROM w GROUP BY 1""")
def axis_votes(spark, sf_dir):
    """Each row votes for its largest component if that leads by a margin."""
    top = F.sort_array(F.transform(F.slice("v", 1, 4), lambda x, k: F.struct(x.alias("x"), (-k).alias("k"))), asc=False)
    all_rows = vectors(spark, sf_dir).select(top.alias("t"))
    axis = F.when(F.col("t")[0]["x"] - F.col("t")[1]["x"] >= 0.02, -F.col("t")[0]["k"])
    n = all_rows.groupBy(axis.alias("axis")).agg(F.count("*").alias("votes"))
    sums = n.agg(F.sum("votes").alias("a"), F.sum(F.when(F.col("axis").isNotNull(), F.col("votes"))).alias("v"))
    return n.where("axis is not null").crossJoin(F.broadcast(sums)).select("axis", "votes", F.round(F.col("votes") / F.col("v"), 6).alias("share"), F.round(F.col("votes") / F.col("a"), 6).alias("coverage"))


@query("""WITH c AS (SELECT vec_id, unnest(embedding) > 0 AS s, unnest(range(len(embedding))) AS p FROM embeddings), o AS (SELECT unnest(range(-12, 13)) AS shift),
m AS (SELECT a.vec_id, shift, count(*) AS n, count(*) FILTER (a.s = b.s) AS same FROM c a JOIN o ON true JOIN c b ON b.vec_id = a.vec_id + 1 AND b.p = a.p + shift GROUP BY 1, 2 HAVING count(*) >= 40)
SELECT vec_id AS item_id, round(max(same / n::DOUBLE), 6) AS match FROM m GROUP BY 1""")
def aligned_match(spark, sf_dir):
    """The best share of equal signs of two fingerprints over shifts of up to 12 with 40 places or more in common; an item and the next."""
    sign = F.transform("v", lambda x: x > 0)
    a = vectors(spark, sf_dir).select("item_id", sign.alias("a"))
    b = vectors(spark, sf_dir).select((F.col("item_id") - 1).alias("item_id"), sign.alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(vec.best_aligned(F.col("a"), F.col("b"), 12, 40), 6).alias("match")).where("match is not null")


@query("SELECT l_partkey % 12 AS a, l_suppkey % 12 AS b, count(*) AS n, min(least((a * 7 - b * 7 + 144) % 12, (b * 7 - a * 7 + 144) % 12)) AS fifths, min(least((a - b + 12) % 12, (b - a + 12) % 12)) AS steps FROM lineitem GROUP BY 1, 2")
def key_distances(spark, sf_dir):
    """Distance of two keys on the circle of fifths and in semitones."""
    x = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 12).alias("a"), (F.col("l_suppkey") % 12).alias("b")).agg(F.count("*").alias("n"))
    return x.select("a", "b", "n", schedule.ring(F.col("a") * 7, F.col("b") * 7).alias("fifths"), schedule.ring(F.col("a"), F.col("b")).alias("steps"))


# --- texts, dates, schedules ---------------------------------------------------------------------------------


@query("SELECT doc_id, md5(array_to_string((list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '<[^<>]*>', ' ', 'g'), '\\[[0-9]+:[0-9.]+\\]', ' ', 'g'), '[ \\t\\r\\n]+'), lambda x: x <> ''))[1:300], ' ')) AS clean FROM documents")
def sanitize_words(spark, sf_dir):
    """Without markup and time stamps, 300 words at most: the feature's own limit."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^<>]*>", " "), r"\[[0-9]+:[0-9.]+\]", " ")
    words = F.filter(F.split(bare, r"[ \t\r\n]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.slice(words, 1, 300), " ")).alias("clean"))


@query("SELECT doc_id, try_cast(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1) AS INTEGER) AS first_year, try_cast(regexp_extract(lower(text), '([0-9]{2,3}) ?bpm', 1) AS INTEGER) AS bpm, regexp_matches(lower(text), '(^|[^a-z])(slow|calm|quiet)([^a-z]|$)') AS calm FROM documents")
def text_hints(spark, sf_dir):
    """Year, tempo and energy named in a text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract(t, "(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)", 1).try_cast("int").alias("first_year"),
        F.regexp_extract(F.lower(t), "([0-9]{2,3}) ?bpm", 1).try_cast("int").alias("bpm"), F.lower(t).rlike("(^|[^a-z])(slow|calm|quiet)([^a-z]|$)").alias("calm"),
    )


@query("WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS s, o_orderdate AS t FROM orders) SELECT k, try_cast(regexp_extract(s, '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1) AS INTEGER) AS year, date_diff('day', t::DATE, DATE '2024-02-01') AS age FROM d")
def parse_dates(spark, sf_dir):
    """The year of a date written in several ways; days since."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    d = F.col("o_orderdate")
    said = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, "n/a").otherwise(F.date_format(d, "yyyy-MM-dd'T'00:00:00"))
    return o.select(F.col("o_orderkey").alias("k"), text.year(said).alias("year"), F.datediff(F.lit("2024-02-01").cast("date"), d.cast("date")).cast("long").alias("age"))


@query("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 3 AND 20 AND (day(ts) IN (1, 15) OR dayofweek(ts) BETWEEN 1 AND 5)")
def cron_hits(spark, sf_dir):
    """Moments that a schedule fits; of day of month and day of week one is enough if both are named."""
    return table(spark, sf_dir, "events").where(schedule.cron("*/15 3-20 1,15 * 1-5", F.col("ts"))).select("event_id")


@query("SELECT p_partkey AS item_id, slug || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, row_number() OVER (PARTITION BY trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), p_brand ORDER BY p_partkey) AS r FROM part) x")
def unique_slugs(spark, sf_dir):
    """A name in plain signs, with a number where an author used it before."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    i = items(spark, sf_dir).withColumn("slug", slug)
    r = F.row_number().over(W.partitionBy("slug", "author").orderBy("item_id"))
    return i.withColumn("r", r).select("item_id", F.concat("slug", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("slug"))


# --- tasks and histories -------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS task, o_custkey AS owner FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def task_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("owner"))


@query("SELECT o_orderkey AS task, coalesce(n, 0) AS steps, coalesce(last, o_orderdate) AS ended FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def collapse_history(spark, sf_dir):
    """A finished task becomes one row; its steps leave their count and last moment."""
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task"), "o_orderdate")
    return o.join(steps, "task", "left").select("task", F.coalesce("n", F.lit(0)).alias("steps"), F.coalesce("last", "o_orderdate").alias("ended"))


@query("SELECT user_id AS worker, max(ts) AS seen, count(*) FILTER (event_type = 'error') AS attempts, CASE WHEN count(*) FILTER (value > 50) % 4 < 3 THEN 'requeue' ELSE 'fail' END AS fate FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-29 12:00:00'")
def reclaim_orphans(spark, sf_dir):
    """Workers silent beyond the grace: their task is queued anew, or fails after too many attempts."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "error").alias("attempts"), F.count_if(F.col("value") > 50).alias("n"))
    return e.where(F.col("seen") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).select("worker", "seen", "attempts", F.when(F.col("n") % 4 < 3, "requeue").otherwise("fail").alias("fate"))


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def retention_sweep(spark, sf_dir):
    """What the last seven days hold; the newest moment comes from a one-row aggregate."""
    e = table(spark, sf_dir, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return e.crossJoin(F.broadcast(last)).where("ts >= since").groupBy("event_type").agg(F.count("*").alias("kept"))


@query("SELECT owner FROM (SELECT o_custkey AS owner, max(o_orderdate) AS d FROM orders GROUP BY 1) x ORDER BY d DESC, owner LIMIT 40")
def recent_names(spark, sf_dir):
    """Distinct names, the latest first: one aggregate and a top-k."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max("o_orderdate").alias("d"))
    return o.orderBy(F.desc("d"), "owner").limit(40).select("owner")


@query("SELECT item_id FROM $ITEMS i ORDER BY md5('sample|' || item_id), item_id LIMIT 100")
def hash_sample(spark, sf_dir):
    """The rows with the smallest hashes: the same sample however the table is split."""
    return items(spark, sf_dir).select("item_id").orderBy(F.md5(F.concat(F.lit("sample|"), F.col("item_id").cast("string"))), "item_id").limit(100)
