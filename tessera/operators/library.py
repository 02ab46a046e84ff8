"""Upkeep of a catalogue held by several servers: mappings, matches, queues, histories, trees. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import tags, text, vec
from ..sources.scratch import cut
from ..sources.tables import bridge, items, table, vectors
from .relational import ITEMS, PAIRS
from .similarity import ANGLE, SEED, VECTORS, centroids, neighbours, seed_vector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Rows of a cell and a size that one task compares with as many others.
CONFIRM_ROWS = 2048


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS).replace("$SEED", SEED).replace("$NORM", "sqrt(list_inner_product(v, v))").replace("$V", VECTORS)
        return f

    return add


# --- joins ---------------------------------------------------------------------------------------------------


@query("SELECT item_id, (SELECT array_to_string(list(DISTINCT l_suppkey ORDER BY l_suppkey), ',') FROM lineitem WHERE l_partkey = item_id) AS servers FROM $ITEMS i WHERE tempo > 25")
def servers_of_items(spark, sf_dir):
    """A set of values for each row, as a column: distinct pairs first, then one short list a key."""
    pairs = bridge(spark, sf_dir).select("item_id", "server_id").distinct()
    lists = pairs.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("server_id")), lambda x: x.cast("string")), ",").alias("servers"))
    return items(spark, sf_dir).where("tempo > 25").select("item_id").join(lists, "item_id", "left")


@query("""WITH missing AS (SELECT item_id, author, album FROM $ITEMS i WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = item_id AND l_quantity > 48)),
groups AS (SELECT DISTINCT author, album FROM missing ORDER BY author, album LIMIT 12) SELECT item_id FROM missing JOIN groups USING (author, album)""")
def backfill_groups(spark, sf_dir):
    """All items without a file in the first dozen albums that have such items."""
    i = items(spark, sf_dir).select("item_id", "author", "album")
    missing = i.join(bridge_over(spark, sf_dir, 48), "item_id", "left_anti")
    groups = missing.select("author", "album").distinct().orderBy("author", "album").limit(12)
    return missing.join(F.broadcast(groups), ["author", "album"]).select("item_id")


def bridge_over(spark, sf_dir, least) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > least).select(F.col("l_partkey").alias("item_id"))


@query("SELECT p_partkey AS item_id, k::INT AS place, string_split(p_name, ' ')[k + 1] AS word FROM part, LATERAL (SELECT unnest(range(len(string_split(p_name, ' ')))) AS k) o")
def lateral_words(spark, sf_dir):
    """A row's own table beside it: the places of its words."""
    return items(spark, sf_dir).select("item_id", F.posexplode(F.split("title", " ")).alias("place", "word"))


@query("""WITH o AS (SELECT * FROM $ITEMS i WHERE item_id % 2 = 0), n AS (SELECT * FROM $ITEMS i WHERE item_id % 2 = 1),
c AS (SELECT o.item_id, n.item_id AS new_id, (o.tempo % 3 = n.tempo % 3 AND o.tempo % 10 = n.tempo % 10) AS same, row_number() OVER (PARTITION BY o.item_id ORDER BY (o.tempo % 3 = n.tempo % 3 AND o.tempo % 10 = n.tempo % 10) DESC, n.item_id) AS r FROM o JOIN n ON lower(o.title) = lower(n.title) AND o.author = n.author)
SELECT item_id, new_id, same FROM c WHERE r = 1""")
def disc_track_tiebreak(spark, sf_dir):
    """Of the files with an item's title and author the one with its disc and track, else the first: one candidate for each disc and track is enough."""
    i = items(spark, sf_dir).select("item_id", F.lower("title").alias("t"), "author", (F.col("tempo") % 3).alias("disc"), (F.col("tempo") % 10).alias("track"))
    old, new = i.where("item_id % 2 = 0"), i.where("item_id % 2 = 1")
    exact = new.groupBy("t", "author", "disc", "track").agg(F.min("item_id").alias("exact"))
    first = new.groupBy("t", "author").agg(F.min("item_id").alias("first"))
    both = old.join(first, ["t", "author"]).join(exact, ["t", "author", "disc", "track"], "left")
    return both.select("item_id", F.coalesce("exact", "first").alias("new_id"), F.col("exact").isNotNull().alias("same"))


@query("""SELECT a.item_id AS a_id, b.item_id AS b_id, a.genre AS cell FROM (SELECT vec_id AS item_id, label AS genre, p_size AS s FROM embeddings JOIN part ON p_partkey = vec_id) a JOIN (SELECT vec_id AS item_id, label AS genre, p_size AS s FROM embeddings JOIN part ON p_partkey = vec_id) b ON a.genre = b.genre AND a.item_id < b.item_id AND abs(a.s - b.s) <= 1""")
def cell_pairs(spark, sf_dir):
    """Pairs of a cell whose lengths are at most one apart: joined by cell and length, so a cell is no key of its own."""
    v = vectors(spark, sf_dir).select("item_id", F.col("genre").alias("cell")).join(items(spark, sf_dir).select("item_id", "tempo"), "item_id")
    near = v.select(F.col("item_id").alias("b_id"), "cell", F.explode(F.array(F.col("tempo") - 1, F.col("tempo"), F.col("tempo") + 1)).alias("tempo"))
    return v.withColumnRenamed("item_id", "a_id").join(near, ["cell", "tempo"]).where("a_id < b_id").select("a_id", "b_id", "cell")


# --- aggregates ----------------------------------------------------------------------------------------------


@query("SELECT genre AS cell, count(*) AS members, round(sqrt(list_inner_product(any_value(c), any_value(c))), 6) AS norm FROM $V t JOIN (SELECT genre AS g, list(x ORDER BY pos) AS c FROM (SELECT genre, pos, avg(x) AS x FROM (SELECT genre, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM $V t) e GROUP BY 1, 2) p GROUP BY genre) m ON g = genre GROUP BY 1")
def cell_centroids(spark, sf_dir):
    """The cells of a group of rows by how many of them they hold, with their centres."""
    df = vectors(spark, sf_dir)
    n = df.groupBy("genre").agg(F.count("*").alias("members"))
    return n.join(centroids(df, "genre"), "genre").select(F.col("genre").alias("cell"), "members", F.round(vec.norm(F.col("v")), 6).alias("norm"))


@query("""WITH n AS (SELECT album, count(*) AS n FROM $ITEMS i GROUP BY 1) SELECT p.album, label, round(sum(score), 6) AS total, count(*) FILTER (score > 0.3) AS present FROM $PAIRS p JOIN n ON n.album = p.album GROUP BY p.album, label, n.n HAVING count(*) FILTER (score > 0.3) >= 0.6 * n.n""")
def cluster_descriptors(spark, sf_dir):
    """Labels that describe a cluster: their sum, and in how many members they are; 0.6 of them at least."""
    i = items(spark, sf_dir)
    n = i.groupBy("album").agg(F.count("*").alias("n"))
    said = i.select("album", F.explode(tags.parse(F.col("tags"))).alias("label", "score")).groupBy("album", "label").agg(F.round(F.sum("score"), 6).alias("total"), F.count_if(F.col("score") > 0.3).alias("present"))
    return said.join(F.broadcast(n), "album").where("present >= 0.6 * n").drop("n")


#: Means and deviations that fitness terms are held against, and their weights.
FITNESS = {"diversity": (2.0, 0.5, 2.0), "purity": (1.0, 0.25, 1.0)}


@query("""WITH t AS (SELECT item_id, album, first(label ORDER BY score DESC, label) AS top FROM $PAIRS p GROUP BY 1, 2), c AS (SELECT album, top, count(*) AS n FROM t GROUP BY 1, 2),
g AS (SELECT album, sum(n) AS n, max(n) AS best, count(*) AS kinds FROM c GROUP BY 1), s AS (SELECT ln(1 + count(DISTINCT album || top)) AS d FROM c), p AS (SELECT ln(1 + sum(best)) AS p FROM g)
SELECT round(d, 6) AS diversity, round(p, 6) AS purity, round(2.0 * (d - 2.0) / 0.5 + 1.0 * (p - 1.0) / 0.25, 6) AS fitness FROM s, p""")
def playlist_fitness(spark, sf_dir):
    """Diversity (kinds of playlists) and purity (members with their playlist's best label), as log1p held against constants."""
    best = F.array_min(F.transform(F.map_entries(tags.parse(F.col("tags"))), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("l"))))["l"]
    c = items(spark, sf_dir).groupBy("album", best.alias("top")).agg(F.count("*").alias("n"))
    g = c.groupBy("album").agg(F.max("n").alias("best"), F.count("*").alias("kinds"))
    s = g.agg(F.log1p(F.sum("kinds")).alias("d"), F.log1p(F.sum("best")).alias("p"))
    z = lambda name, col: FITNESS[name][2] * (F.col(col) - FITNESS[name][0]) / FITNESS[name][1]
    return s.select(F.round("d", 6).alias("diversity"), F.round("p", 6).alias("purity"), F.round(z("diversity", "d") + z("purity", "p"), 6).alias("fitness"))


# --- order, samples, sets ------------------------------------------------------------------------------------


@query("SELECT item_id FROM $ITEMS i ORDER BY md5('7|' || item_id), item_id LIMIT 40")
def random_order(spark, sf_dir):
    """A random order by seed: the same on every run and cluster."""
    return items(spark, sf_dir).select("item_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("item_id").cast("string"))), "item_id").limit(40)


@query("SELECT item_id, author FROM (SELECT item_id, author, row_number() OVER (PARTITION BY author ORDER BY md5('s|' || item_id), item_id) AS r FROM $ITEMS i) x WHERE r <= 5")
def random_sample(spark, sf_dir):
    """Five of each author, drawn by seed; the rank limit prunes within each task before the shuffle."""
    r = F.row_number().over(W.partitionBy("author").orderBy(F.md5(F.concat(F.lit("s|"), F.col("item_id").cast("string"))), "item_id"))
    return items(spark, sf_dir).select("item_id", "author").withColumn("r", r).where("r <= 5").drop("r")


@query("""WITH g AS (SELECT label, vec_id % 5 AS part, list(x ORDER BY pos) AS c FROM (SELECT label, vec_id % 5 AS vec_id, pos, avg(x) AS x FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) e GROUP BY 1, 2, 3) p GROUP BY 1, 2)
SELECT genre, a, b, round(d, 6) AS dist FROM (SELECT x.label AS genre, x.part AS a, y.part AS b, 1 - list_inner_product(x.c, y.c) / sqrt(list_inner_product(x.c, x.c)) / sqrt(list_inner_product(y.c, y.c)) AS d, row_number() OVER (PARTITION BY x.label ORDER BY 1 - list_inner_product(x.c, y.c) / sqrt(list_inner_product(x.c, x.c)) / sqrt(list_inner_product(y.c, y.c)) DESC, x.part, y.part) AS r FROM g x JOIN g y ON x.label = y.label AND x.part < y.part) z WHERE r = 1""")
def farthest_pairs(spark, sf_dir):
    """The two playlists of each genre that lie farthest apart, by their centres: a handful of rows a genre."""
    df = vectors(spark, sf_dir).select("genre", (F.col("item_id") % 5).alias("part"), "v")
    x = df.select("genre", "part", F.posexplode("v").alias("at", "x")).groupBy("genre", "part", "at").agg(F.avg("x").alias("x"))
    c = x.groupBy("genre", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("v"))
    pairs = c.select("genre", F.col("part").alias("a"), F.col("v").alias("va")).join(c.select("genre", F.col("part").alias("b"), F.col("v").alias("vb")), "genre").where("a < b")
    far = pairs.select("genre", "a", "b", vec.angular(F.col("va"), F.col("vb")).alias("d")).groupBy("genre").agg(F.min(F.struct((-F.col("d")).alias("d"), "a", "b")).alias("m"))
    return far.select("genre", "m.a", "m.b", F.round(-F.col("m.d"), 6).alias("dist"))


def _near(k: int) -> str:
    return f"(SELECT item_id FROM (SELECT t.item_id, 1 - list_inner_product(t.v, q.v) / sqrt(list_inner_product(t.v, t.v)) / sqrt(list_inner_product(q.v, q.v)) AS d FROM $V t, (SELECT v FROM $V z WHERE item_id = {k}) q WHERE t.item_id <> {k}) x ORDER BY d, item_id LIMIT 100)"


@query(f"SELECT (SELECT count(*) FROM (SELECT item_id FROM {_near(0)} a INTERSECT SELECT item_id FROM {_near(1)} b) i) AS shared, (SELECT count(*) FROM (SELECT item_id FROM {_near(0)} a UNION SELECT item_id FROM {_near(1)} b) u) AS together")
def neighbour_overlap(spark, sf_dir):
    """How many neighbours two items share, and have together."""
    df = vectors(spark, sf_dir)
    near = lambda k: neighbours(df.where(F.col("item_id") != k), seed_vector(df, k), 100).select("item_id")
    n = near(0).union(near(1)).groupBy("item_id").count()
    return n.agg(F.count_if(F.col("count") == 2).alias("shared"), F.count("*").alias("together"))


# --- queues and incremental runs -----------------------------------------------------------------------------


@query("SELECT task, queue, priority FROM (SELECT o_orderkey AS task, o_orderstatus AS queue, 0 AS priority FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), 'N', 1 FROM customer WHERE c_acctbal < 0) x")
def append_jobs(spark, sf_dir):
    """New tasks behind the last: numbers come from the places of a few ordered rows, after the largest there is."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0] or 0
    new = numbered(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"), "c_custkey")
    return o.select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("queue"), F.lit(0).alias("priority")).unionByName(new.select((F.col("n") + last).alias("task"), F.lit("N").alias("queue"), F.lit(1).alias("priority")))


def numbered(df: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Rows numbered from 1 in order of a whole-number key, without one task that holds them all: places in ranges, and the counts before them."""
    part = df.withColumn("part", F.floor(F.col(key) / width))
    counts = part.groupBy("part").agg(F.count("*").alias("c"))
    group = counts.withColumn("group", F.floor(F.col("part") / width))
    within = F.coalesce(F.sum("c").over(W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = group.groupBy("group").agg(F.sum("c").alias("g"))  # a row for each width x width keys
    before = groups.withColumn("g", F.coalesce(F.sum("g").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = group.withColumn("w", within).join(F.broadcast(before), "group").select("part", (F.col("w") + F.col("g")).alias("before"))
    n = F.row_number().over(W.partitionBy("part").orderBy(key)) + F.col("before")
    return part.join(base, "part").withColumn("n", n).drop("part", "before")


@query("SELECT l_orderkey AS parent, l_linenumber AS child, l_quantity AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'O'")
def reaped_children(spark, sf_dir):
    """Open children of finished parents: what a reap removes and hands back."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    open_ = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return open_.join(done, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.col("l_quantity").alias("cost"))


@query("WITH w AS (SELECT max(o_orderdate) - INTERVAL 90 DAY AS w FROM orders) SELECT o_custkey AS owner, count(*) AS added, max(o_orderdate) AS seen FROM orders, w WHERE o_orderdate > w.w GROUP BY 1")
def since_watermark(spark, sf_dir):
    """Only what came after the stored mark; the mark is one row, and the new one is the result's latest moment."""
    o = table(spark, sf_dir, "orders")
    mark = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 90 DAYS")).alias("w"))
    return o.join(F.broadcast(mark), F.col("o_orderdate") > F.col("w")).groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("added"), F.max("o_orderdate").alias("seen"))


@query("""WITH a AS (SELECT author, md5(string_agg(item_id::VARCHAR, ',' ORDER BY item_id)) AS h FROM $ITEMS i WHERE item_id % 97 <> 3 GROUP BY 1), b AS (SELECT author, md5(string_agg(item_id::VARCHAR, ',' ORDER BY item_id)) AS h FROM $ITEMS i GROUP BY 1)
SELECT author, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'gone' ELSE 'changed' END AS why FROM a FULL JOIN b USING (author) WHERE a.h IS DISTINCT FROM b.h""")
def refit_changed(spark, sf_dir):
    """Groups whose content's hash changed since the last fit: the only ones to fit again."""
    i = items(spark, sf_dir).select("author", "item_id")
    ids = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ","))
    a, b = i.where("item_id % 97 <> 3").groupBy("author").agg(ids.alias("ha")), i.groupBy("author").agg(ids.alias("hb"))
    both = a.join(b, "author", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
    return both.select("author", F.when(F.col("ha").isNull(), "new").when(F.col("hb").isNull(), "gone").otherwise("changed").alias("why"))


@query("""WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_custkey AS owner, o_orderstatus = 'O' AS active, o_orderstatus = 'P' AS blocked, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 4)::INT ELSE 0 END AS retries FROM last WHERE r = 1 AND (o_orderstatus <> 'F' OR o_orderkey % 4 < 3)""")
def queue_guards(spark, sf_dir):
    """Of each owner's latest task whether it runs or blocks, and how often it was tried; what was tried too often is left out."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m")).select("owner", "m.*")
    s, tried = F.col("o_orderstatus"), (F.col("o_orderkey") % 4).cast("int")
    return last.where((s != "F") | (tried < 3)).select("owner", (s == "O").alias("active"), (s == "P").alias("blocked"), F.when(s == "F", tried).otherwise(0).alias("retries"))


# --- moves between servers -----------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_suppkey AS server_id, l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS provider_id FROM lineitem), m AS (SELECT * FROM f WHERE provider_id % 3 = 0),
c AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.server_id = f.server_id AND m.item_id = f.item_id)),
g AS (SELECT server_id, item_id, min(provider_id) AS provider_id FROM c GROUP BY 1, 2)
SELECT server_id, count(*) AS aligned, min(provider_id) AS first_id, (SELECT count(*) FROM m WHERE m.server_id = g.server_id) AS mapped FROM g GROUP BY 1""")
def alignment_sweep(spark, sf_dir):
    """What a server has and no mapping names is matched to the catalogue, one file an item, beside what was mapped."""
    f = bridge(spark, sf_dir)
    m = f.where("provider_id % 3 = 0")
    left = f.join(m.select("server_id", "item_id"), ["server_id", "item_id"], "left_anti").join(items(spark, sf_dir).select("item_id"), "item_id", "left_semi")
    new = left.groupBy("server_id", "item_id").agg(F.min("provider_id").alias("provider_id")).groupBy("server_id").agg(F.count("*").alias("aligned"), F.min("provider_id").alias("first_id"))
    return new.join(m.groupBy("server_id").agg(F.count("*").alias("mapped")), "server_id", "left").select("server_id", "aligned", "first_id", F.coalesce("mapped", F.lit(0)).alias("mapped"))


def relabelled(df: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """A table with its ids rewritten by (old_id, new_id); ids without a new one stay."""
    return df.join(renames, df[column] == renames.old_id, "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


RENAMES = "(SELECT p_partkey AS old_id, p_partkey + 1000000 AS new_id FROM part WHERE p_partkey % 3 = 0)"


def renames(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).where("item_id % 3 = 0").select(F.col("item_id").alias("old_id"), (F.col("item_id") + 1_000_000).alias("new_id"))


@query(f"SELECT server_id, item_id, count(*) AS files FROM (SELECT l_suppkey AS server_id, coalesce(new_id, l_partkey) AS item_id FROM lineitem LEFT JOIN {RENAMES} r ON old_id = l_partkey) x GROUP BY 1, 2")
def relabel_ids(spark, sf_dir):
    return relabelled(bridge(spark, sf_dir), "item_id", renames(spark, sf_dir)).groupBy("server_id", "item_id").agg(F.count("*").alias("files"))


@query(f"""WITH n AS (SELECT coalesce(new_id, p_partkey) AS item_id FROM part LEFT JOIN {RENAMES} r ON old_id = p_partkey), b AS (SELECT coalesce(new_id, l_partkey) AS item_id FROM lineitem LEFT JOIN {RENAMES} r ON old_id = l_partkey)
SELECT 'items' AS what, (SELECT count(*) FROM part) AS before, (SELECT count(*) FROM n) AS after, (SELECT count(*) FROM n) - (SELECT count(DISTINCT item_id) FROM n) AS wrong UNION ALL
SELECT 'mappings', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE item_id NOT IN (SELECT item_id FROM n)) UNION ALL
SELECT 'vectors', (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM n))""")
def verify_migration(spark, sf_dir):
    """Row counts before and after, ids that became equal, and references that lead nowhere; the vectors were not rewritten."""
    r, i, b, v = renames(spark, sf_dir), items(spark, sf_dir).select("item_id"), bridge(spark, sf_dir).select("item_id"), vectors(spark, sf_dir).select("item_id")
    n, m = relabelled(i, "item_id", r), relabelled(b, "item_id", r)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    line = lambda what, old, new, wrong: count(old, "before").crossJoin(count(new, "after")).crossJoin(wrong).select(F.lit(what).alias("what"), "before", "after", "wrong")
    lost = lambda df: count(df.join(n, "item_id", "left_anti"), "wrong")
    return line("items", i, n, n.agg((F.count("*") - F.countDistinct("item_id")).alias("wrong"))).union(line("mappings", b, m, lost(m))).union(line("vectors", v, v, lost(v)))


@query("""WITH auto AS (SELECT c_custkey AS old_id, s_suppkey AS new_id FROM customer JOIN supplier ON right(c_name, 2) = right(s_name, 2) AND c_nationkey = s_nationkey), manual AS (SELECT c_custkey AS old_id, 1 AS new_id FROM customer WHERE c_custkey % 50 = 0), off AS (SELECT c_custkey AS old_id FROM customer WHERE c_custkey % 30 = 0)
SELECT old_id, min(new_id) AS new_id, bool_or(hand) AS by_hand FROM (SELECT old_id, new_id, true AS hand FROM manual UNION ALL SELECT old_id, new_id, false FROM auto WHERE old_id NOT IN (SELECT old_id FROM manual) AND old_id NOT IN (SELECT old_id FROM off)) x GROUP BY 1""")
def build_mapping(spark, sf_dir):
    """Matches found, with those set by hand in their place and those undone by hand left out."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda name: F.expr(f"right({name}, 2)").alias("t")
    first = s.groupBy(key("s_name"), F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("new_id"))
    auto = c.select(F.col("c_custkey").alias("old_id"), key("c_name"), F.col("c_nationkey").alias("k")).join(first, ["t", "k"]).select("old_id", "new_id")
    manual = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("old_id"), F.lit(1).cast("long").alias("new_id"))
    off = c.where("c_custkey % 30 = 0").select(F.col("c_custkey").alias("old_id"))
    return manual.withColumn("by_hand", F.lit(True)).unionByName(auto.join(manual, "old_id", "left_anti").join(off, "old_id", "left_anti").withColumn("by_hand", F.lit(False)))


@query("SELECT s_nationkey AS scope, min(s_suppkey) AS default_id, count(*) AS servers, count(*) FILTER (s_acctbal > 0) AS enabled FROM supplier GROUP BY 1")
def server_registry(spark, sf_dir):
    """The servers of each scope: how many, how many are on, and which is the default."""
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("scope")).agg(F.min("s_suppkey").alias("default_id"), F.count("*").alias("servers"), F.count_if(F.col("s_acctbal") > 0).alias("enabled"))


@query("SELECT item_id, title, tempo FROM $ITEMS i WHERE author = 'Brand#13' ORDER BY title, item_id")
def artist_tracks(spark, sf_dir):
    return items(spark, sf_dir).where("author = 'Brand#13'").orderBy(F.asc_nulls_last("title"), "item_id").select("item_id", "title", "tempo")


# --- pools and ladders ---------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT item_id FROM (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 60), s AS (SELECT label FROM $PAIRS p WHERE item_id = 0 ORDER BY score DESC, label LIMIT 3),
k AS (SELECT item_id FROM c WHERE EXISTS (SELECT 1 FROM $PAIRS p WHERE p.item_id = c.item_id AND label IN (SELECT label FROM s) AND score >= 0.85) OR item_id NOT IN (SELECT p_partkey FROM part))
SELECT item_id FROM k WHERE (SELECT count(*) FROM k) >= 0.4 * (SELECT count(*) FROM c) UNION ALL SELECT item_id FROM c WHERE (SELECT count(*) FROM k) < 0.4 * (SELECT count(*) FROM c)""")
def genre_postfilter(spark, sf_dir):
    """Neighbours that share one of the seed's three best labels; all of them if under 0.4 would be left."""
    df, i = vectors(spark, sf_dir), items(spark, sf_dir).select("item_id", "tags")
    c = neighbours(df.where("item_id <> 0"), seed_vector(df, 0), 60).select("item_id")
    seed = i.where("item_id = 0").select(F.explode(tags.parse(F.col("tags"))).alias("label", "score")).orderBy(F.desc("score"), "label").limit(3)
    labels = [r.label for r in seed.collect()]  # three
    shares = F.lit(False)
    for x in labels:
        shares |= tags.has_at_least(F.col("tags"), x, 0.85)
    return kept_unless_few(c.join(i, "item_id", "left"), shares | F.col("tags").isNull(), 0.4).select("item_id")


def kept_unless_few(df: DataFrame, keep: Column, share: float) -> DataFrame:
    """The rows to keep; all rows if fewer than a share of them would be left."""
    n = df.agg(F.count_if(F.coalesce(keep, F.lit(False))).alias("kept"), F.count("*").alias("n")).first()
    return df.where(keep) if n.kept >= share * n.n else df


@query("""WITH t(asked, name) AS (VALUES (1, 'brand#12'), (2, 'BRAND-#13'), (3, '14'), (4, 'brnd#15'), (5, 'zzz')), a AS (SELECT DISTINCT author FROM $ITEMS i),
c AS (SELECT asked, author, CASE WHEN lower(translate(author, ' -/''', '')) = lower(translate(name, ' -/''', '')) THEN 1 WHEN regexp_matches(author, '(?i)(^|[^a-z0-9])' || name || '([^a-z0-9]|$)') THEN 2 WHEN 100 * (1 - levenshtein(lower(author), lower(name)) / greatest(length(author), length(name))::DOUBLE) >= 75 THEN 3 END AS rung FROM t, a)
SELECT asked, author, rung FROM (SELECT *, min(rung) OVER (PARTITION BY asked) AS m FROM c) x WHERE rung = m""")
def artist_ladder(spark, sf_dir):
    """Authors for a name as typed: equal but for signs, else with it as a whole word, else alike; the first rung that finds any."""
    asked = spark.createDataFrame([(1, "brand#12"), (2, "BRAND-#13"), (3, "14"), (4, "brnd#15"), (5, "zzz")], "asked int, name string")
    a = items(spark, sf_dir).select("author").distinct()
    whole = F.regexp_like("author", F.concat(F.lit(r"(?i)(^|[^a-z0-9])\Q"), "name", F.lit(r"\E([^a-z0-9]|$)")))
    alike = 100 * (1 - F.levenshtein(F.lower("author"), F.lower("name")) / F.greatest(F.length("author"), F.length("name"))) >= 75
    rung = F.when(text.match_key(F.col("author")) == text.match_key(F.col("name")), 1).when(whole, 2).when(alike, 3)
    c = a.join(F.broadcast(asked), rung.isNotNull()).withColumn("rung", rung)  # the few names typed go to all authors
    best = c.groupBy("asked").agg(F.min("rung").alias("rung"))
    return c.join(F.broadcast(best), ["asked", "rung"]).select("asked", "author", "rung")


@query("""WITH ch AS (SELECT 'happy' AS channel, item_id FROM $PAIRS p WHERE label = 'happy' AND score >= 0.9 UNION ALL SELECT 'party', item_id FROM $PAIRS p WHERE label = 'party' AND score >= 0.9 UNION ALL SELECT 'few', item_id FROM $ITEMS i WHERE item_id IN (1, 2, 3)),
g AS (SELECT ch.channel, ch.item_id, tempo BETWEEN 46 AND 50 AS pass FROM ch JOIN $ITEMS i USING (item_id)), n AS (SELECT channel, count(*) FILTER (pass) AS k FROM g GROUP BY 1)
SELECT channel, item_id FROM g JOIN n USING (channel) WHERE pass OR k = 0""")
def channel_gate(spark, sf_dir):
    """Each channel's rows that pass the hard filter; a channel that it would empty stays as it is."""
    i = items(spark, sf_dir)
    rows = lambda name, where: i.where(where).select(F.lit(name).alias("channel"), "item_id", F.col("tempo").between(46, 50).alias("ok"))
    g = rows("happy", tags.has_at_least(F.col("tags"), "happy", 0.9)).union(rows("party", tags.has_at_least(F.col("tags"), "party", 0.9))).union(rows("few", F.col("item_id").isin(1, 2, 3)))
    n = g.groupBy("channel").agg(F.count_if("ok").alias("k"))  # a row a channel
    return g.join(F.broadcast(n), "channel").where("ok or k = 0").select("channel", "item_id")


@query(f"WITH c AS (SELECT item_id FROM (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 80) SELECT item_id, title, author, tempo FROM $ITEMS i WHERE item_id IN (SELECT item_id FROM c)")
def pool_features(spark, sf_dir):
    df = vectors(spark, sf_dir)
    pool = neighbours(df.where("item_id <> 0"), seed_vector(df, 0), 80).select("item_id")
    return items(spark, sf_dir).join(F.broadcast(pool), "item_id", "left_semi").select("item_id", "title", "author", "tempo")


@query("SELECT label AS cell, count(*) AS members, round(sum(embedding[1]::DOUBLE), 6) AS first_sum FROM embeddings WHERE vec_id % 7 = 0 GROUP BY 1")
def vectors_by_cell(spark, sf_dir):
    """Some ids' vectors, gathered cell by cell."""
    wanted = vectors(spark, sf_dir).where("item_id % 7 = 0")
    return wanted.groupBy(F.col("genre").alias("cell")).agg(F.count("*").alias("members"), F.round(F.sum(F.col("v")[0]), 6).alias("first_sum"))


@query(f"""WITH c AS (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0), k AS (SELECT c.item_id, d, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(author)) ORDER BY d, c.item_id) AS r FROM c JOIN $ITEMS i ON i.item_id = c.item_id WHERE d <= 0.95)
SELECT item_id, round(d, 6) AS dist, floor((row_number() OVER (ORDER BY d, item_id) - 1) / 50)::INT AS bucket FROM k WHERE r = 1 ORDER BY d, item_id LIMIT 120""")
def radius_candidates(spark, sf_dir):
    """What a walk starts from: rows within a radius, one a title and author, in buckets of 50 by distance."""
    df = vectors(spark, sf_dir)
    d = df.where("item_id <> 0").select("item_id", vec.angular(F.col("v"), vec.literal(seed_vector(df, 0))).alias("d")).where("d <= 0.95")
    named = d.join(items(spark, sf_dir).select("item_id", F.lower(F.trim("title")).alias("t"), F.lower(F.trim("author")).alias("a")), "item_id")
    once = named.groupBy("t", "a").agg(F.min(F.struct("d", "item_id")).alias("m")).select("m.*").orderBy("d", "item_id").limit(120)
    place = F.row_number().over(W.orderBy("d", "item_id"))  # 120 rows
    return once.select("item_id", F.round("d", 6).alias("dist"), F.floor((place - 1) / 50).cast("int").alias("bucket"))


@query("SELECT p_brand AS author, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM (SELECT p_brand, (1 + p_size)::DOUBLE AS w, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM part JOIN embeddings ON vec_id = p_partkey) t GROUP BY 1")
def projection_centroids(spark, sf_dir):
    """Where a group lies on the map: the weighted mean of its members' stored coordinates."""
    c = vectors(spark, sf_dir).select("item_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")).join(items(spark, sf_dir).select("item_id", "author", (F.col("tempo") + 1).alias("w")), "item_id")
    mean = lambda k: F.round(F.sum(F.col("w") * F.col(k)) / F.sum("w"), 6).alias(k)
    return c.groupBy("author").agg(mean("x"), mean("y"))


@query("SELECT 'server' AS scope, p_partkey AS item_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 4) UNION ALL SELECT 'all', p_partkey FROM part")
def catalogue_or_all(spark, sf_dir):
    """A server's items; the whole catalogue where a server has none."""
    i = items(spark, sf_dir).select("item_id")

    def of(server):
        here = i.join(bridge(spark, sf_dir).where(F.col("server_id") == server).select("item_id"), "item_id", "left_semi")
        return here if here.head(1) else i

    return of(4).select(F.lit("server").alias("scope"), "item_id").union(of(-1).select(F.lit("all").alias("scope"), "item_id"))


TREE = "(SELECT 'r' || r_regionkey AS child, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def tree_edges(spark, sf_dir) -> DataFrame:
    e = lambda name, child, c, parent, p: table(spark, sf_dir, name).select(F.concat(F.lit(child), F.col(c).cast("string")).alias("child"), F.concat(F.lit(parent), F.col(p).cast("string")).alias("parent") if p else F.lit("root").alias("parent"))
    return e("region", "r", "r_regionkey", "", None).union(e("nation", "n", "n_nationkey", "r", "n_regionkey")).union(e("supplier", "s", "s_suppkey", "n", "s_nationkey"))


@query(f"WITH RECURSIVE t AS (SELECT child, 1 AS depth FROM {TREE} e WHERE parent = 'r1' UNION ALL SELECT e.child, depth + 1 FROM {TREE} e JOIN t ON e.parent = t.child) SELECT child, depth FROM t")
def subtree(spark, sf_dir):
    """All that hangs below a node, level by level."""
    tree_edges(spark, sf_dir).createOrReplaceTempView("tree_edges")
    return spark.sql("WITH RECURSIVE t(child, depth) AS (SELECT child, 1 FROM tree_edges WHERE parent = 'r1' UNION ALL SELECT e.child, t.depth + 1 FROM tree_edges e JOIN t ON e.parent = t.child) SELECT child, depth FROM t")


@query(f"""WITH RECURSIVE up AS (SELECT child, parent FROM {TREE} e WHERE child IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000) UNION SELECT e.child, e.parent FROM {TREE} e JOIN up ON e.child = up.parent)
SELECT DISTINCT child, parent FROM up""")
def pruned_tree(spark, sf_dir):
    """The tree without folders that hold nothing present: presence climbs from the leaves, a level a join."""
    edges = tree_edges(spark, sf_dir)
    now = edges.join(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child")), "child", "left_semi")
    out = now
    for _ in range(2):  # leaves, their folders, their folders' folders: the depth of the tree
        now = edges.join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        out = out.unionByName(now)
    return out


@query("""WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding::DOUBLE[] AS av, b.embedding::DOUBLE[] AS bv, x.p_size AS asize, y.p_size AS bsize, x.p_type AS af, y.p_type AS bf FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id JOIN part x ON x.p_partkey = a.vec_id JOIN part y ON y.p_partkey = b.vec_id),
s AS (SELECT *, abs(asize - bsize) <= 1 AS len, af <> bf AS folder, 1 - list_inner_product(av, bv) / sqrt(list_inner_product(av, av)) / sqrt(list_inner_product(bv, bv)) <= 0.9 AS near FROM p)
SELECT count(*) FILTER (len) AS by_length, count(*) FILTER (len AND folder) AS by_folder, count(*) FILTER (len AND folder AND near) AS by_vector FROM s""")
def confirm_order(spark, sf_dir):
    """How many proposed pairs each test leaves, the cheapest first: length, folder, vector. Only what passed the others has its vectors compared."""
    i = items(spark, sf_dir).select("item_id", F.col("tempo").cast("long").alias("size"), F.col("album").alias("folder"))
    rows = vectors(spark, sf_dir).where("genre is not null").select("item_id", F.col("genre").alias("cell"), "v").join(i, "item_id").where("size is not null")
    return confirmed(rows, 0.9)


def confirmed(rows: DataFrame, most: float) -> DataFrame:
    """Counts of the pairs of rows (item_id, cell, size, folder, v) of one cell: sizes one apart at most; of these, other folders; of these, near by angle.

    Rows of a cell and size are dealt to blocks of CONFIRM_ROWS. Blocks meet in pairs, and a task leaves three counts of its pairs of rows.
    """
    rows = cut(rows.select("item_id", "cell", "size", F.coalesce(F.xxhash64("folder"), F.lit(0)).alias("folder"), F.col("folder").isNull().alias("none"), F.when(vec.finite(F.col("v")), F.col("v")).alias("v")))
    n = rows.groupBy("cell", "size").agg(F.ceil(F.count("*") / CONFIRM_ROWS).cast("int").alias("blocks"))
    own = rows.join(F.broadcast(n), ["cell", "size"]).withColumn("block", F.pmod(F.xxhash64("item_id"), "blocks").cast("int")).drop("blocks")
    # a row goes to each pair of blocks that its own is in: its own size with itself and with one more, and one less with its own
    beside = lambda step: n.select("cell", (F.col("size") - step).alias("size"), F.col("blocks").alias("others"))
    each = lambda side, size, left, right: F.struct(F.lit(side).alias("side"), size.alias("low"), left.alias("a"), right.alias("b"))
    size, block, other = F.col("size"), F.col("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    at = lambda step: own.join(F.broadcast(beside(step)), ["cell", "size"]).withColumn("other", other)
    same = at(0)
    dealt = [
        same.where("block <= other").withColumn("to", each(0, size * 2, block, F.col("other"))), same.where("block >= other").withColumn("to", each(1, size * 2, F.col("other"), block)),
        at(1).withColumn("to", each(0, size * 2 + 1, block, F.col("other"))), at(-1).withColumn("to", each(1, size * 2 - 1, F.col("other"), block)),
    ]
    all_ = dealt[0].unionByName(dealt[1]).unionByName(dealt[2]).unionByName(dealt[3])

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        one, two = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        dim = next((len(x) for x in table.column("v") if x.is_valid), 1)

        def parts(t):
            held = t.column("v").combine_chunks()
            v = np.zeros((t.num_rows, dim))
            v[np.asarray(held.is_valid())] = held.flatten().to_numpy().reshape(-1, dim)
            with np.errstate(all="ignore"):
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))  # what has no direction is near nothing
            return t.column("item_id").to_numpy(), t.column("folder").to_numpy(), t.column("none").to_numpy(), v

        (i, f, no, v), (j, g, none, w) = parts(one), parts(two)
        within = len(i) and len(j) and table.column("low")[0].as_py() % 2 == 0 and table.column("a")[0].as_py() == table.column("b")[0].as_py()
        pairs = (i[:, None] < j) if within else (i[:, None] != j)
        other = pairs & (f[:, None] != g) & ~no[:, None] & ~none
        with np.errstate(all="ignore"):
            near = other & (1 - v @ w.T <= most)
        return pa.table({"by_length": [int(pairs.sum())], "by_folder": [int(other.sum())], "by_vector": [int(near.sum())]})

    counts = all_.select("cell", "to.*", "item_id", "folder", "none", "v").groupBy("cell", "low", "a", "b").applyInArrow(meet, "by_length long, by_folder long, by_vector long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return counts.agg(total("by_length"), total("by_folder"), total("by_vector"))
