"""Searches as they are asked for: neighbours with all their filters, re-ranked indexes, compositions, paths, maps. Each has its SQL beside it where SQL can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import tags, vec
from ..sources import index as store
from ..sources.scratch import cut, scratch
from ..sources.tables import bridge, items, table, vectors
from .greedy import keep_apart
from .relational import ITEMS, PAIRS
from .similarity import ANGLE, CENTROIDS, SEED, VECTORS, block_neighbours, centroids, neighbours, seed_vector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: An author's share of a result, and how many rows a search without caps may ask for.
AUTHOR_CAP, UNCAPPED = 3, 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS).replace("$SEED", SEED).replace("$NORM", "sqrt(list_inner_product(v, v))").replace("$V", VECTORS)
        return f

    return add


def over_fetch(n: int, *, dedupe: bool = True, mood: bool = False, tight: bool = False) -> int:
    """How many neighbours to fetch so that n are left: a fixed policy, with room for what filters drop, and the item itself."""
    if mood:
        return n + max(20, (8 if tight else 4) * n) + 1
    if dedupe:
        return n + max(20, 3 * n) + 1
    return n + max(3, int(0.2 * n)) + 1


def reranked(df: DataFrame, q: list[float], k: int) -> DataFrame:
    """The k nearest by angle: more of them by quantised vectors first, those then by the exact ones."""
    coarse = vec.angular(vec.quantize(F.col("v")).cast("array<double>"), vec.literal([max(-127, min(127, round(x * 127))) for x in q]))
    some = df.withColumn("coarse", coarse).where("coarse is not null").orderBy("coarse", "item_id").limit(max(4 * k, k + 200))
    return neighbours(some, q, k)


def shaped(found: DataFrame, catalogue: DataFrame, n: int, *, target=None, apart: float = 0.01, mood: tuple[list[str], float] | None = None, cap: int | None = AUTHOR_CAP) -> DataFrame:
    """What is shown of candidates (item_id, dist, v), a few hundred at most, in order of distance.

    Rows too near the last kept one go; then repeats of a title and author, the target's among them; then rows whose labels are too far
    from the target's; then those over an author's share, and those without an author. ``catalogue`` is read for the candidates only.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "item_id"]).reset_index(drop=True)
        return pdf.loc[keep_apart(np.stack(pdf.v.to_numpy()), 1, apart), ["item_id", "dist"]]

    kept = found.select("item_id", "dist", "v").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "item_id long, dist double") if apart else found.select("item_id", "dist")
    named = kept.join(catalogue.select("item_id", "title", "author", "tags"), "item_id")
    t, a = F.lower(F.trim("title")), F.lower(F.trim("author"))
    if target is not None:
        named = named.where(~(t.eqNullSafe(F.lit((target.title or "").strip().lower())) & a.eqNullSafe(F.lit((target.author or "").strip().lower()))))
        if mood:
            named = named.where(tags.gap(F.col("tags"), F.lit(target.tags), mood[0]) <= mood[1])
    first = named.withColumn("r", F.row_number().over(W.partitionBy(t, a).orderBy("dist", "item_id"))).where("r = 1")
    if cap:
        first = first.where("author is not null").withColumn("c", F.row_number().over(W.partitionBy("author").orderBy("dist", "item_id"))).where(F.col("c") <= cap)
    return first.orderBy("dist", "item_id").limit(n).select("item_id", "title", "author", "dist")


LOOK = """RECURSIVE c AS (SELECT item_id, v, d, row_number() OVER (ORDER BY d, item_id) AS rn FROM (SELECT item_id, v, {angle} AS d FROM $V t WHERE item_id <> {seed}) x ORDER BY d, item_id LIMIT {fetch}),
w AS (SELECT rn, item_id, d, v AS last, true AS kept FROM c WHERE rn = 1 UNION ALL
 SELECT c.rn, c.item_id, c.d, CASE WHEN 1 - list_inner_product(c.v, w.last) / sqrt(list_inner_product(c.v, c.v)) / sqrt(list_inner_product(w.last, w.last)) >= {apart} THEN c.v ELSE w.last END, 1 - list_inner_product(c.v, w.last) / sqrt(list_inner_product(c.v, c.v)) / sqrt(list_inner_product(w.last, w.last)) >= {apart} FROM w JOIN c ON c.rn = w.rn + 1),
k AS (SELECT w.item_id, d, title, author, tempo FROM w JOIN $ITEMS i ON i.item_id = w.item_id WHERE kept)"""
MOOD = "(abs((k.tempo - z.tempo) * 2 / 100.0::DOUBLE) + abs((k.item_id * 7 % 100 - z.item_id * 7 % 100) / 100.0::DOUBLE)) / 2 <= 0.5"


@query(f"""WITH {LOOK.format(angle=ANGLE, seed=0, fetch=41, apart=0.75)},
u AS (SELECT k.*, row_number() OVER (PARTITION BY lower(trim(k.title)), lower(trim(k.author)) ORDER BY d, k.item_id) AS r FROM k JOIN $ITEMS z ON z.item_id = 0 WHERE NOT (lower(k.title) = lower(z.title) AND lower(k.author) = lower(z.author)) AND {MOOD}),
a AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY d, item_id) AS q FROM u WHERE r = 1) SELECT item_id, title, author, round(d, 6) AS dist FROM a WHERE q <= 3 ORDER BY d, item_id LIMIT 10""")
def neighbours_by_id(spark, sf_dir):
    """An item's neighbours: fetched with room, re-ranked, near copies, repeats, far moods and an author's surplus dropped."""
    df, i = vectors(spark, sf_dir), items(spark, sf_dir)
    target = i.where("item_id = 0").first()
    found = reranked(df.where("item_id <> 0"), seed_vector(df, 0), over_fetch(10))
    return shaped(found, i, 10, target=target, apart=0.75, mood=(["happy", "sad"], 0.5)).withColumn("dist", F.round("dist", 6))


@query(f"""WITH RECURSIVE q AS (SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM $V t WHERE item_id IN (3, 4)) e GROUP BY pos) m),
c AS (SELECT item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM $V t, q ORDER BY d, item_id LIMIT 81),
u AS (SELECT c.item_id, d, title, author, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(author)) ORDER BY d, c.item_id) AS r FROM c JOIN $ITEMS i ON i.item_id = c.item_id),
a AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY d, item_id) AS k FROM u WHERE r = 1) SELECT item_id, title, author, round(d, 6) AS dist FROM a WHERE k <= 3 ORDER BY d, item_id LIMIT 20""")
def neighbours_by_vector(spark, sf_dir):
    """The neighbours of a vector that is no item's, here the mean of two."""
    df = vectors(spark, sf_dir)
    mean = df.where("item_id in (3, 4)").select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()  # a row a dimension
    found = neighbours(df, [r.x for r in mean], over_fetch(20))
    return shaped(found, items(spark, sf_dir), 20, apart=0).withColumn("dist", F.round("dist", 6))


@query(f"SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 25")
def exact_rerank(spark, sf_dir):
    """Quantised search for four times as many, then the exact order: equal to the exact search."""
    df = vectors(spark, sf_dir)
    return reranked(df.where("item_id <> 0"), seed_vector(df, 0), 25).select("item_id", F.round("dist", 6).alias("dist"))


# --- paths and compositions ----------------------------------------------------------------------------------


@query(f"""WITH m AS {CENTROIDS}, s AS (SELECT v AS a FROM $V t WHERE item_id = 0), near AS (SELECT c AS b, genre FROM m, s ORDER BY 1 - list_inner_product(c, a) / sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(a, a)) DESC, genre LIMIT 1),
p AS (SELECT genre, list_transform(range(1, 65), lambda i: 0.4 * a[i] + 0.6 * b[i]) AS q FROM s, near)
SELECT p.genre AS toward, t.item_id FROM $V t, p WHERE t.item_id <> 0 ORDER BY 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))), t.item_id LIMIT 1""")
def path_endpoint(spark, sf_dir):
    """Where a path to a mood ends: 0.6 of the way to a centre, here the farthest one, the nearest item there."""
    df = vectors(spark, sf_dir)
    a = seed_vector(df, 0)
    end = centroids(df, "genre").withColumn("d", vec.angular(F.col("v"), vec.literal(a))).orderBy(F.desc("d"), "genre").first()
    found = neighbours(df.where("item_id <> 0"), [0.4 * x + 0.6 * y for x, y in zip(a, end.v, strict=True)], 1)
    return found.select(F.lit(end.genre).alias("toward"), "item_id")


#: Saved compositions: a name, whether it is on, points to add and points to keep away from.
RADIOS = (("calm", True, (1, 2, 3), (4,)), ("late", True, (10, 11), (12, 13)), ("off", False, (5,), ()))


def composed(df: DataFrame, add, away, n: int, reach: float = 0.45) -> DataFrame:
    """(item_id, d): near any added point, none within reach of a point to keep away from; the points' vectors are literals."""
    points = {r.item_id: r.v for r in df.where(F.col("item_id").isin(*add, *away)).collect()}  # 16 at most
    to = lambda k: vec.angular_pi(F.col("v"), vec.literal(points[k]))
    far = F.least(*[to(k) for k in away], F.lit(9.0), F.lit(9.0)) > reach
    near = F.least(*[to(k) for k in add], F.lit(9.0), F.lit(9.0))
    return df.where(~F.col("item_id").isin(*add, *away)).where(far).select("item_id", near.alias("d")).orderBy("d", "item_id").limit(n)


def _pi(k: int) -> str:
    return f"(acos(greatest(-1, least(1, list_inner_product(t.v, (SELECT v FROM $V z WHERE item_id = {k})) / sqrt(list_inner_product(t.v, t.v)) / sqrt((SELECT list_inner_product(v, v) FROM $V z WHERE item_id = {k}))))) / pi())"


def _radio(name, add, away) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS radio, item_id, round(d, 6) AS dist FROM (SELECT item_id, least({', '.join(map(_pi, add))}) AS d, least({', '.join(map(_pi, away))}, 9) AS away FROM $V t WHERE item_id NOT IN ({', '.join(map(str, add + away))})) x WHERE away > 0.45 ORDER BY d, item_id LIMIT 15) y"


@query(" UNION ALL ".join(_radio(name, add, away) for name, on, add, away in RADIOS if on))
def anchor_radios(spark, sf_dir):
    """The playlist of each radio that is on."""
    df, out = vectors(spark, sf_dir), None
    for name, on, add, away in RADIOS:
        if on:
            part = composed(df, add, away, 15).select(F.lit(name).alias("radio"), "item_id", F.round("d", 6).alias("dist"))
            out = part if out is None else out.unionByName(part)
    return out


@query("""WITH c AS (SELECT p_brand AS artist, p_size % 3 AS comp, p_partkey AS id, v FROM part JOIN $V t ON item_id = p_partkey),
g AS (SELECT artist, comp, list(x ORDER BY pos) AS m FROM (SELECT artist, comp, pos, avg(x) AS x FROM (SELECT artist, comp, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c) e GROUP BY 1, 2, 3) z GROUP BY 1, 2)
SELECT artist, comp, id AS item_id, r AS place FROM (SELECT c.artist, c.comp, id, row_number() OVER (PARTITION BY c.artist, c.comp ORDER BY list_distance(v, m), id) AS r FROM c JOIN g ON c.artist = g.artist AND c.comp = g.comp) x WHERE r <= 2""")
def representative_tracks(spark, sf_dir):
    """The two items nearest each component's mean, for every artist."""
    c = items(spark, sf_dir).join(vectors(spark, sf_dir), "item_id").select(F.col("author").alias("artist"), (F.col("tempo") % 3).alias("comp"), "item_id", "v")
    part = c.select("artist", "comp", F.posexplode("v").alias("at", "x")).groupBy("artist", "comp", "at").agg(F.avg("x").alias("x"))
    g = part.groupBy("artist", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("m"))
    d = c.join(g, ["artist", "comp"]).select("artist", "comp", "item_id", vec.euclid(F.col("v"), F.col("m")).alias("d"))
    r = F.row_number().over(W.partitionBy("artist", "comp").orderBy("d", "item_id"))
    return d.withColumn("place", r).where("place <= 2").select("artist", "comp", "item_id", "place")


def text_search(df: DataFrame, catalogue: DataFrame, q: list[float], limit: int) -> DataFrame:
    """Items for a query vector from a text model; an author's share holds, whatever the case of the name, unless very many rows are asked for."""
    found = neighbours(df, q, limit if limit >= UNCAPPED else over_fetch(limit)).select("item_id", "dist")
    named = found.join(catalogue.select("item_id", F.lower(F.trim("author")).alias("a")), "item_id", "left")
    if limit < UNCAPPED:
        r = F.row_number().over(W.partitionBy("a").orderBy("dist", "item_id"))
        named = named.withColumn("r", r).where((F.col("r") <= AUTHOR_CAP) | F.col("a").isNull() | (F.col("a") == ""))
    return named.orderBy("dist", "item_id").limit(limit).select("item_id", "dist")


TEXT = "(SELECT t.item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM $V t, (SELECT list_transform(range(64), lambda i: CASE WHEN i % 5 = 0 THEN 1.0 ELSE -0.5 END)::DOUBLE[] AS q) z)"


@query(f"""SELECT 'capped' AS kind, item_id, round(d, 6) AS dist FROM (SELECT * FROM (SELECT c.*, author, row_number() OVER (PARTITION BY lower(author) ORDER BY d, c.item_id) AS r FROM (SELECT * FROM {TEXT} x ORDER BY d, item_id LIMIT 121) c LEFT JOIN $ITEMS i ON i.item_id = c.item_id) y WHERE r <= 3 OR author IS NULL ORDER BY d, item_id LIMIT 30) k
UNION ALL SELECT 'all', item_id, round(d, 6) FROM (SELECT * FROM {TEXT} x ORDER BY d, item_id LIMIT 1000) a""")
def text_query_search(spark, sf_dir):
    df, i = vectors(spark, sf_dir), items(spark, sf_dir)
    q = [1.0 if k % 5 == 0 else -0.5 for k in range(64)]
    part = lambda kind, n: text_search(df, i, q, n).select(F.lit(kind).alias("kind"), "item_id", F.round("dist", 6).alias("dist"))
    return part("capped", 30).unionByName(part("all", UNCAPPED))


#: Labels of each axis, side by side in a 27-vector.
AXES = (6, 6, 6, 5, 4)


def axis_vector(v: Column, temperature: float = 0.1) -> Column:
    """A softmax over each axis' labels."""
    parts, at = [], 1
    for n in AXES:
        parts.append(vec.softmax(F.slice(v, at, n), temperature))
        at += n
    return F.concat(*parts)


_SOFT = " || ".join(f"list_transform(v[{a}:{a + n - 1}], lambda x: exp((x - list_max(v[{a}:{a + n - 1}])) / 0.1::DOUBLE) / list_sum(list_transform(v[{a}:{a + n - 1}], lambda y: exp((y - list_max(v[{a}:{a + n - 1}])) / 0.1::DOUBLE))))" for a, n in zip((1, 7, 13, 19, 24), AXES, strict=True))


@query(f"SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, 1 - (s[2] + s[15]) / (sqrt(list_inner_product(s, s)) * sqrt(2.0::DOUBLE)) AS d FROM (SELECT item_id, {_SOFT} AS s FROM $V t) x) y ORDER BY d, item_id LIMIT 20")
def axis_search(spark, sf_dir):
    """Items by chosen labels of several axes: the angle to a vector of ones at those labels."""
    df = vectors(spark, sf_dir).select("item_id", axis_vector(F.col("v")).alias("v"))
    return neighbours(df, [1.0 if k in (1, 14) else 0.0 for k in range(sum(AXES))], 20).select("item_id", F.round("dist", 6).alias("dist"))


@query("""WITH m AS (SELECT p_partkey AS item_id, p_name AS title, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part JOIN embeddings ON vec_id = p_partkey),
t AS (SELECT item_id, first(label ORDER BY score DESC, label) AS top FROM $PAIRS p GROUP BY 1)
SELECT share, m.item_id, title, round(x, 6) AS x, round(y, 6) AS y, top FROM m JOIN t USING (item_id), (VALUES (100), (50), (25)) s(share) WHERE share = 100 OR k % (100 / share) = 0""")
def map_buckets(spark, sf_dir):
    """The map at three sizes: coordinates beside the catalogue, the best label, and every row, every second, every fourth."""
    from .library import numbered

    xy = vectors(spark, sf_dir).select("item_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))
    best = F.array_min(F.transform(F.map_entries(tags.parse(F.col("tags"))), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("l"))))["l"]
    m = numbered(items(spark, sf_dir).select("item_id", "title", best.alias("top")).join(xy, "item_id"), "item_id")
    step = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(100 // s).alias("step")) for s in (100, 50, 25)]))
    return m.withColumn("s", step).where("(n - 1) % s.step = 0").select("s.share", "item_id", "title", "x", "y", "top")


# --- the index -----------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM embeddings) AS stored, (SELECT count(*) FROM embeddings) AS distinct_ids, 0::BIGINT AS astray, true AS recall_ok, true AS pruned")
def index_store(spark, sf_dir):
    """An index written by cell and loaded again: all rows are there once, a probe reads its cells only, and finds what the exact search finds.

    Recall is held against the floor for quantised cells, 0.88.
    """
    df = vectors(spark, sf_dir)
    path = scratch(spark)
    store.write_index(df, path)
    loaded = store.load_index(spark, path)
    q = df.where("item_id % 20 = 0")
    got, want = cut(loaded.search(q, 10).select("query_id", "item_id")), block_neighbours(df, q, 10).select("query_id", "item_id")
    n = want.join(got.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").agg(F.count("hit") / F.count("*")).first()[0]
    asked = [int(c) for c in store.nearest(np.array([seed_vector(df, 20)]), loaded.centres, 2)[0]]
    plan = loaded.cells(asked).select("item_id")._jdf.queryExecution().executedPlan().toString()
    pruned = "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    rows = loaded.rows.select("item_id")
    counts = rows.agg(F.count("*").alias("stored"), F.countDistinct("item_id").alias("distinct_ids"))
    astray = rows.join(df.select("item_id"), "item_id", "left_anti").agg(F.count("*").alias("astray"))
    return counts.crossJoin(astray).select("*", F.lit(bool(n >= 0.88)).alias("recall_ok"), F.lit(pruned).alias("pruned"))


@query("SELECT count(*) AS blobs, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total FROM embeddings")
def blob_round_trip(spark, sf_dir):
    """Vectors as little-endian blobs and back; a blob of another length than the dimension asks for is null."""
    from ..sources import blobs

    df = vectors(spark, sf_dir).select("item_id", blobs.encode(F.col("v")).alias("blob"))
    back = df.select("item_id", blobs.decode(F.col("blob")).alias("v"))
    return back.where("size(v) = 64").agg(F.count("*").alias("blobs"), F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


@query("SELECT vec_id AS item_id, pos::INT AS pos, round(x, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id < 40) t")
def blob_explode(spark, sf_dir):
    """A row for each number of a blob, by its place."""
    from ..sources import blobs

    df = vectors(spark, sf_dir).where("item_id < 40").select("item_id", blobs.encode(F.col("v")).alias("blob"))
    return df.select("item_id", F.posexplode(blobs.decode(F.col("blob"))).alias("pos", "x")).select("item_id", "pos", F.round("x", 6).alias("x"))


# --- clusters ------------------------------------------------------------------------------------------------


def farthest_first(points: np.ndarray, n: int, start: int = 0) -> list[int]:
    """Places of n points, each the farthest from those taken; of equals the first."""
    if not len(points):
        return []
    out, gap = [start], np.linalg.norm(points - points[start], axis=1)
    while len(out) < min(n, len(points)):
        gap[out] = -1
        out.append(int(np.argmax(gap)))
        gap = np.minimum(gap, np.linalg.norm(points - points[out[-1]], axis=1))
    return out


@query(f"""WITH RECURSIVE m AS (SELECT genre, c, row_number() OVER (ORDER BY genre) AS k FROM {CENTROIDS} x), w AS (SELECT 1 AS step, [k] AS taken, k AS last FROM m WHERE k = 1 UNION ALL
 SELECT step + 1, list_append(taken, p), p FROM (SELECT w.step, w.taken, (SELECT m.k FROM m WHERE NOT list_contains(w.taken, m.k) ORDER BY (SELECT min(list_distance(m.c, o.c)) FROM m o WHERE list_contains(w.taken, o.k)) DESC, m.k LIMIT 1) AS p FROM w WHERE step < 6) n)
SELECT step - 1 AS place, genre FROM w JOIN m ON m.k = w.last""")
def maximin_select(spark, sf_dir):
    """Six playlists as unlike as can be, by their centres: one row a cluster."""
    rows = centroids(vectors(spark, sf_dir), "genre").orderBy("genre").collect()  # a row a genre
    taken = farthest_first(np.array([r.v for r in rows]), 6)
    return spark.createDataFrame([(place, rows[k].genre) for place, k in enumerate(taken)], "place int, genre int")


@query("""WITH m AS (SELECT l_suppkey AS list, l_partkey AS item_id, lower(p_name) AS t, p_brand AS a FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT DISTINCT list, item_id, t, a FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY list, t, a ORDER BY item_id) AS r FROM u), n AS (SELECT list, count(*) AS members FROM o WHERE r = 1 GROUP BY 1 HAVING count(*) >= 20)
SELECT list, members, row_number() OVER (ORDER BY members DESC, list) AS place FROM n ORDER BY members DESC, list LIMIT 40""")
def playlist_postprocess(spark, sf_dir):
    """Playlists without repeats of a title and author, those under 20 rows dropped, the largest 40 in order."""
    i = items(spark, sf_dir).select("item_id", F.lower("title").alias("t"), "author")
    once = bridge(spark, sf_dir).select(F.col("server_id").alias("list"), "item_id").join(i, "item_id").select("list", "t", "author").distinct()
    n = once.groupBy("list").agg(F.count("*").alias("members")).where("members >= 20").orderBy(F.desc("members"), "list").limit(40)
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("members"), "list")))  # 40 rows


def knn_radius(df: DataFrame, k: int = 4) -> tuple[float, float]:
    """The median and the 90th percentile of the distance to the k-th neighbour: the range in which a density radius makes sense."""
    far = block_neighbours(df, df, k).where(F.col("r") == k)
    return tuple(far.agg(F.percentile("dist", F.array(F.lit(0.5), F.lit(0.9)))).first()[0])


@query()
def evolved_clusters(spark, sf_dir):
    """Rounds of k-means with parameters drawn, or changed from the best so far, each scored by silhouette; the best of each round.

    Parameters come from a seed, so a run repeats. A round's fits are jobs of their own over all rows; a fit's data never reach the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    df = cut(vectors(spark, sf_dir).select("item_id", "v")).withColumn("features", array_to_vector("v"))
    rng, elites, rows = np.random.default_rng(3), [], []
    for step in range(4):
        if elites and rng.random() < 0.7:
            k = int(np.clip(elites[0][1] + rng.integers(-3, 4), 2, 30))
        else:
            k = int(rng.integers(2, 30))
        fitted = KMeans(k=k, seed=step, maxIter=5).fit(df)
        score = (ClusteringEvaluator().evaluate(fitted.transform(df)) + 1) / 2
        elites = sorted([*elites, (score, k)], reverse=True)[:3]
        rows.append((step, k, float(score), float(elites[0][0])))
    return spark.createDataFrame(rows, "step int, k int, score double, best double")


@query()
def spectral_clusters(spark, sf_dir):
    """Power iteration on the graph of nearest neighbours: (item_id, cluster)."""
    from pyspark.ml.clustering import PowerIterationClustering

    df = vectors(spark, sf_dir)
    near = block_neighbours(df, df, 6).where("query_id <> item_id")
    edges = cut(near.select(F.least("query_id", "item_id").alias("src"), F.greatest("query_id", "item_id").alias("dst"), F.greatest(F.lit(1e-6), 1 - F.col("dist")).alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    model = PowerIterationClustering(k=6, maxIter=10, initMode="degree", weightCol="weight")
    return model.assignClusters(edges).select(F.col("id").alias("item_id"), "cluster")
