"""Neighbour search and what builds on it: filters, masks, centroids, fusion, hyperbolic space, identity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.tables import bridge, items, table, vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The vectors in SQL, and one of them.
VECTORS = "(SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label AS genre FROM embeddings)"
SEED = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
#: Queries that one block search sends to every task, and rows of a block where there are more; queries that a task compares at once.
MAX_BLOCK, QUERY_ROWS = 10_000, 512


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql.replace("$SEED", SEED).replace("$NORM", "sqrt(list_inner_product(v, v))").replace("$V", VECTORS)
        return f

    return add


def seed_vector(df: DataFrame, item_id: int) -> list[float]:
    """A point lookup: one row."""
    row = df.where(F.col("item_id") == item_id).select("v").first()
    if row is None:
        raise KeyError(item_id)
    return list(row.v)


def neighbours(df: DataFrame, q: list[float], k: int, metric: str = "angular") -> DataFrame:
    """The k nearest rows, exact: a scan, and TakeOrderedAndProject on (distance, item_id)."""
    return df.select("*", vec.distance(metric, F.col("v"), vec.literal(q)).alias("dist")).where("dist is not null").orderBy("dist", "item_id").limit(k)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def nearest_of(qid: np.ndarray, q: np.ndarray, item: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, item_id, dist) of the k nearest of some unit rows to each of some unit queries, itself left out; queries in turn, so that little is held."""
    out = []
    for at in range(0, len(qid), QUERY_ROWS):
        d = 1 - q[at : at + QUERY_ROWS] @ v.T
        d[qid[at : at + QUERY_ROWS, None] == item[None, :]] = np.inf
        some = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        of = np.repeat(np.arange(len(d)), some.shape[1])
        dist = d[of, some.ravel()]
        live = np.isfinite(dist)
        out.append((qid[at : at + QUERY_ROWS][of][live], item[some.ravel()][live], dist[live]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "item_id", "dist"])


def dealt_pairs(df: DataFrame, queries: DataFrame, rows: int) -> DataFrame:
    """(part, block, query_id, item_id, v): every block of queries beside every part of the rows, by equal keys. Both are cut by hash into about ``rows`` rows."""
    parts, blocks = max(1, -(-df.count() // rows)), max(1, -(-queries.count() // rows))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = F.lit(None).cast("long")
    ours = df.select(F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"), each("block", blocks), none.alias("query_id"), "item_id", "v")
    asked = queries.select(each("part", parts), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), F.col("item_id").alias("query_id"), none.alias("item_id"), "v")
    return ours.unionByName(asked)


def pair_matrices(table: pa.Table):
    """(query ids, unit queries, item ids, unit rows) of one block beside one part."""
    import pyarrow.compute as pc

    def of(name):
        some = table.filter(pc.is_valid(table.column(name)))
        ids = some.column(name).to_numpy()
        flat = some.column("v").combine_chunks().flatten().to_numpy()
        return ids, unit_rows(flat.reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))

    return *of("query_id"), *of("item_id")


def block_neighbours(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, dist, r): the k nearest by angle for many queries, item itself left out.

    Up to MAX_BLOCK queries go to all tasks as a matrix. More are dealt in blocks: each block of queries meets each part of the rows in one
    task. Either way a task keeps k rows for each query before the shuffle.
    """
    df, queries = df.where(vec.finite(F.col("v"))).select("item_id", "v"), queries.where(vec.finite(F.col("v"))).select("item_id", "v")
    schema = "query_id long, item_id long, dist double"
    rows = queries.limit(MAX_BLOCK + 1).toPandas()  # MAX_BLOCK rows and one
    if len(rows) <= MAX_BLOCK:
        sent = df.sparkSession.sparkContext.broadcast((rows.item_id.to_numpy(np.int64), unit_rows(np.stack(rows.v.to_numpy())) if len(rows) else np.zeros((0, 1))))

        def run(batches):
            for batch in batches:
                if batch.num_rows and len(sent.value[0]):
                    item = batch.column(0).to_numpy()
                    yield nearest_of(*sent.value, item, unit_rows(np.asarray(batch.column(1).flatten()).reshape(len(item), -1)), k)

        found = df.mapInArrow(run, schema)
    else:

        def meet(table: pa.Table) -> pa.Table:
            qid, q, item, v = pair_matrices(table)
            if not len(qid) or not len(item):
                return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
            return pa.Table.from_batches([nearest_of(qid, q, item, v, k)])

        found = dealt_pairs(df, queries, MAX_BLOCK).groupBy("part", "block").applyInArrow(meet, schema)
    r = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "item_id"))
    return found.withColumn("r", r).where(F.col("r") <= k)


def _knn(name: str, metric: str, sql: str):
    def run(spark, sf_dir):
        df = vectors(spark, sf_dir)
        found = neighbours(df.where("item_id <> 0"), seed_vector(df, 0), 20, metric)
        return found.select("item_id", F.round("dist", 6).alias("dist"), F.round(vec.similarity(metric, F.col("dist")), 6).alias("similarity"))

    run.__name__ = name
    return query(sql)(run)


ANGLE = "1 - list_inner_product(v, $SEED) / ($NORM * sqrt(list_inner_product($SEED, $SEED)))"
_knn("knn_single_angular", "angular", f"SELECT item_id, round(d, 6) AS dist, round(1 - d, 6) AS similarity FROM (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 20")
_knn("knn_single_euclid", "euclidean", "SELECT item_id, round(d, 6) AS dist, round(1 / (1 + d), 6) AS similarity FROM (SELECT item_id, list_distance(v, $SEED) AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 20")
_knn("knn_single_dot", "dot", "SELECT item_id, round(d, 6) AS dist, round(-d, 6) AS similarity FROM (SELECT item_id, -list_inner_product(v, $SEED) AS d FROM $V t WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 20")


@query("SELECT query_id, item_id, round(d, 6) AS dist, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM (SELECT q.item_id AS query_id, t.item_id, 1 - list_inner_product(q.v, t.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(t.v, t.v))) AS d FROM $V q, $V t WHERE q.item_id % 20 = 0 AND q.item_id <> t.item_id) x) y WHERE r <= 10")
def knn_batch_topk(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return block_neighbours(df, df.where("item_id % 20 = 0"), 10).select("query_id", "item_id", F.round("dist", 6).alias("dist"), F.col("r").alias("place"))


@query(f"SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0 AND item_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <= 5)) x ORDER BY d, item_id LIMIT 15")
def knn_availability_masked(spark, sf_dir):
    """The mask is a semi-join before distances are taken."""
    df = vectors(spark, sf_dir)
    here = bridge(spark, sf_dir).where("server_id <= 5").select("item_id")
    return neighbours(df.where("item_id <> 0").join(here, "item_id", "left_semi"), seed_vector(df, 0), 15).select("item_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, {ANGLE} AS d FROM $V t) x ORDER BY d DESC, item_id LIMIT 1")
def max_distance(spark, sf_dir):
    df = vectors(spark, sf_dir)
    d = vec.angular(F.col("v"), vec.literal(seed_vector(df, 0)))
    return df.select("item_id", d.alias("d")).where("d is not null").orderBy(F.desc("d"), "item_id").limit(1).select("item_id", F.round("d", 6).alias("dist"))


def centroids(df: DataFrame, by: str) -> DataFrame:
    """(by, v): the mean vector of each group, by place in the vector; partial sums on the map side."""
    part = df.select(by, F.posexplode("v").alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("x"))
    return part.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("v"))


CENTROIDS = "(SELECT genre, list(x ORDER BY pos) AS c FROM (SELECT genre, pos, avg(x) AS x FROM (SELECT genre, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM $V t) e GROUP BY 1, 2) p GROUP BY genre)"


@query(f"SELECT item_id, nearest, round(d, 6) AS dist FROM (SELECT item_id, c.genre AS nearest, list_distance(v, c.c) AS d, row_number() OVER (PARTITION BY item_id ORDER BY list_distance(v, c.c), c.genre) AS r FROM $V t, {CENTROIDS} c) x WHERE r = 1")
def nearest_centroid_assign(spark, sf_dir):
    """Every item's nearest mean; the means, one for each genre, are a literal of bounded size."""
    df = vectors(spark, sf_dir)
    means = centroids(df, "genre").orderBy("genre").collect()  # a row for each genre
    near = F.array_min(F.array(*[F.struct(vec.euclid(F.col("v"), vec.literal(m.v)).alias("d"), F.lit(m.genre).alias("g")) for m in means]))
    return df.select("item_id", near.alias("n")).select("item_id", F.col("n.g").alias("nearest"), F.round("n.d", 6).alias("dist"))


@query(f"""WITH c AS (SELECT p.item_id, title, author, d FROM (SELECT p_partkey AS item_id, p_name AS title, p_brand AS author FROM part) p JOIN (SELECT item_id, {ANGLE} AS d FROM $V t WHERE item_id <> 0) x ON p.item_id = x.item_id),
u AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), lower(trim(author)) ORDER BY d, item_id) AS k FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY d, item_id) AS r FROM u WHERE k = 1 AND author IS NOT NULL)
SELECT item_id, title, author, round(d, 6) AS dist FROM a WHERE r <= 3 ORDER BY d, item_id LIMIT 20""")
def knn_dedupe_artist_cap(spark, sf_dir):
    """Flagship: neighbours, one of each title and author, three of an author at most."""
    df = vectors(spark, sf_dir)
    i = items(spark, sf_dir).select("item_id", "title", "author")
    d = df.where("item_id <> 0").select("item_id", vec.angular(F.col("v"), vec.literal(seed_vector(df, 0))).alias("d")).where("d is not null")
    c = d.join(i, "item_id").where("author is not null")
    first = c.groupBy(F.lower(F.trim("title")).alias("t"), F.lower(F.trim("author")).alias("a")).agg(F.min(F.struct("d", "item_id", "title", "author")).alias("m")).select("m.*")
    r = F.row_number().over(W.partitionBy("author").orderBy("d", "item_id"))
    return first.withColumn("r", r).where("r <= 3").orderBy("d", "item_id").limit(20).select("item_id", "title", "author", F.round("d", 6).alias("dist"))


@query("""WITH p AS (SELECT user_id % 100 AS item_id, max(ts) AS last FROM events WHERE user_id < 40 GROUP BY 1),
w AS (SELECT v, pow(0.5::DOUBLE, date_diff('day', last::DATE, DATE '2024-02-01') / 30.0::DOUBLE) AS w FROM p JOIN $V t ON t.item_id = p.item_id),
f AS (SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, sum(w * x) / sum(w) AS x FROM (SELECT w, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM w) e GROUP BY pos) m)
SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM $V t, f WHERE item_id NOT IN (SELECT item_id FROM p)) x ORDER BY d, item_id LIMIT 20""")
def weighted_fingerprint_knn(spark, sf_dir):
    """A taste vector: mean of what was played, halved in weight for every 30 days, then its neighbours."""
    df = vectors(spark, sf_dir)
    played = table(spark, sf_dir, "events").where("user_id < 40").groupBy((F.col("user_id") % 100).alias("item_id")).agg(F.max("ts").alias("last"))
    weight = F.pow(F.lit(0.5), F.datediff(F.lit("2024-02-01").cast("date"), F.col("last").cast("date")) / 30.0)
    parts = played.join(df, "item_id").select(weight.alias("w"), F.posexplode("v").alias("at", "x")).groupBy("at").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    q = [r.x for r in parts.orderBy("at").collect()]  # a row for each dimension
    return neighbours(df.join(played, "item_id", "left_anti"), q, 20).select("item_id", F.round("dist", 6).alias("dist")) if q else df.select("item_id", F.lit(0.0).alias("dist")).limit(0)


# --- hyperbolic ----------------------------------------------------------------------------------------------

#: A scaled copy of the vectors, so that norms differ; the scale is the 95th percentile of the norms.
SCALED = "(SELECT item_id, list_transform(v, lambda x: x * (0.5 + item_id % 10 / 10.0::DOUBLE)) AS v FROM $V t)"
BALL = f"""s AS {SCALED}, k AS (SELECT quantile_cont($NORM, 0.95) AS k FROM s),
b AS (SELECT item_id, list_transform(v, lambda x: x / $NORM * tanh($NORM / (2 * k))) AS p, tanh($NORM / (2 * k)) AS r FROM s, k),
z AS (SELECT p AS q, r AS r0 FROM b WHERE item_id = 5), m AS (SELECT b.*, r0, acosh(1 + 2 * pow(list_distance(p, q), 2) / ((1 - list_inner_product(p, p)) * (1 - list_inner_product(q, q)))) AS d FROM b, z WHERE item_id <> 5)"""


def ball(spark, sf_dir):
    df = vectors(spark, sf_dir).select("item_id", F.transform("v", lambda x: x * (0.5 + F.col("item_id") % 10 / 10.0)).alias("v"))
    scale = df.agg(F.percentile(vec.norm(F.col("v")), 0.95)).first()[0]
    return df.select("item_id", vec.poincare(F.col("v"), F.lit(scale)).alias("p")).withColumn("r", vec.norm(F.col("p")))


def _hyperbolic(name: str, where: str, spark_where):
    def run(spark, sf_dir):
        b = ball(spark, sf_dir)
        z = b.where("item_id = 5").first()
        m = b.where("item_id <> 5").where(spark_where(F.col("r"), z.r))
        return m.select("item_id", vec.hyperbolic(F.col("p"), vec.literal(z.p)).alias("d"), "r").orderBy("d", "item_id").limit(15).select("item_id", F.round("d", 6).alias("dist"), F.round("r", 6).alias("radius"))

    run.__name__ = name
    return query(f"WITH {BALL} SELECT item_id, round(d, 6) AS dist, round(r, 6) AS radius FROM m WHERE {where} ORDER BY d, item_id LIMIT 15")(run)


_hyperbolic("hyperbolic_similar", "true", lambda r, r0: F.lit(True))
_hyperbolic("hyperbolic_roots", "r < r0 * 0.85", lambda r, r0: r < r0 * 0.85)
_hyperbolic("hyperbolic_niche", "r > r0 + (1 - r0) * 0.15", lambda r, r0: r > r0 + (1 - r0) * 0.15)


@query(f"WITH {BALL}, e AS (SELECT quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS b2, quantile_cont(r, 0.75) AS c FROM b) SELECT item_id, (r > a)::INT + (r > b2)::INT + (r > c)::INT AS band FROM b, e")
def radial_bands(spark, sf_dir):
    b = ball(spark, sf_dir)
    edges = b.agg(F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    return b.select("item_id", sum((F.when(F.col("r") > e, 1).otherwise(0) for e in edges), F.lit(0)).alias("band"))


# --- fusion, groups, composition -----------------------------------------------------------------------------

HALF = "list_transform(range({a}, {b}), lambda i: (v[i] - m[i]) / CASE WHEN s[i] > 0 THEN s[i] ELSE 1 END)"


@query(f"""WITH st AS (SELECT list(m ORDER BY pos) AS m, list(s ORDER BY pos) AS s FROM (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM $V t) e GROUP BY pos) z),
h AS (SELECT item_id, {HALF.format(a=1, b=33)} AS a, {HALF.format(a=33, b=65)} AS b FROM $V t, st),
f AS (SELECT item_id, list_transform(a, lambda x: sqrt(0.75::DOUBLE) * x / sqrt(list_inner_product(a, a))) || list_transform(b, lambda x: sqrt(0.25::DOUBLE) * x / sqrt(list_inner_product(b, b))) AS v FROM h),
q AS (SELECT v AS q FROM f WHERE item_id = 0)
SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM f, q WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 20""")
def fusion_whitened_knn(spark, sf_dir):
    """Two half vectors, each whitened by population deviation and made unit, weighted 3 to 1 and joined."""
    df = vectors(spark, sf_dir)
    stats = df.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("at").collect()  # a row a dimension
    mean, std = vec.literal([r.m for r in stats]), vec.literal([r.s or 1.0 for r in stats])
    white = F.zip_with(F.zip_with(F.col("v"), mean, lambda x, m: x - m), std, lambda x, s: x / s)
    half = len(stats) // 2
    part = lambda a, n, w: F.transform(vec.unit(F.slice(F.col("w"), a, n)), lambda x: x * float(np.sqrt(w)))
    fused = df.select("item_id", white.alias("w")).select("item_id", F.concat(part(1, half, 0.75), part(half + 1, len(stats) - half, 0.25)).alias("v"))
    return neighbours(fused.where("item_id <> 0"), seed_vector(fused, 0), 20).select("item_id", F.round("dist", 6).alias("dist"))


@query("""WITH c AS (SELECT p_brand AS artist, p_size % 3 AS comp, p_partkey AS id, v FROM part JOIN $V t ON item_id = p_partkey),
g AS (SELECT artist, comp, list(x ORDER BY pos) AS v, any_value(n) AS n FROM (SELECT artist, comp, pos, avg(x) AS x, count(*) AS n FROM (SELECT artist, comp, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c) e GROUP BY 1, 2, 3) z GROUP BY 1, 2),
w AS (SELECT artist, comp, v, n / sum(n) OVER (PARTITION BY artist)::DOUBLE AS w FROM g),
d AS (SELECT a.artist AS a, b.artist AS b, a.comp AS ac, b.comp AS bc, a.w AS aw, b.w AS bw, 1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) AS d FROM w a, w b WHERE a.artist = 'Brand#11' AND b.artist <> a.artist),
x AS (SELECT b, sum(aw * d) AS s FROM (SELECT b, ac, any_value(aw) AS aw, min(d) AS d FROM d GROUP BY 1, 2) q GROUP BY b), y AS (SELECT b, sum(bw * d) AS s FROM (SELECT b, bc, any_value(bw) AS bw, min(d) AS d FROM d GROUP BY 1, 2) q GROUP BY b)
SELECT x.b AS artist, round((x.s + y.s) / 2, 6) AS dist FROM x JOIN y ON x.b = y.b ORDER BY (x.s + y.s) / 2, x.b LIMIT 10""")
def artist_soft_chamfer(spark, sf_dir):
    """Artists as weighted components; the weighted mean of each component's nearest one, both ways."""
    c = items(spark, sf_dir).join(vectors(spark, sf_dir), "item_id").select(F.col("author").alias("artist"), (F.col("tempo") % 3).alias("comp"), "v")
    n = c.groupBy("artist", "comp").agg(F.count("*").alias("n"))
    part = c.select("artist", "comp", F.posexplode("v").alias("at", "x")).groupBy("artist", "comp", "at").agg(F.avg("x").alias("x"))
    g = part.groupBy("artist", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("v")).join(n, ["artist", "comp"])
    g = g.withColumn("w", F.col("n") / F.sum("n").over(W.partitionBy("artist")))
    mine = g.where("artist = 'Brand#11'").collect()  # the components of one artist
    if not mine:
        return g.select("artist", F.lit(0.0).alias("dist")).limit(0)
    seeds = F.array(*[F.struct(F.lit(k).alias("ac"), F.lit(float(m.w)).alias("aw"), vec.literal(m.v).alias("q")) for k, m in enumerate(mine)])
    d = g.where("artist <> 'Brand#11'").select("artist", "comp", "w", "v", F.explode(seeds).alias("s")).select("artist", "comp", "w", "s.ac", "s.aw", vec.angular(F.col("v"), F.col("s.q")).alias("d"))
    x = d.groupBy("artist", "ac", "aw").agg(F.min("d").alias("d")).groupBy("artist").agg(F.sum(F.col("aw") * F.col("d")).alias("x"))
    y = d.groupBy("artist", "comp", "w").agg(F.min("d").alias("d")).groupBy("artist").agg(F.sum(F.col("w") * F.col("d")).alias("y"))
    return x.join(y, "artist").select("artist", ((F.col("x") + F.col("y")) / 2).alias("d")).orderBy("d", "artist").limit(10).select("artist", F.round("d", 6).alias("dist"))


PI = "acos(greatest(-1, least(1, list_inner_product(t.v, q{k}.v) / sqrt(list_inner_product(t.v, t.v)) / sqrt(list_inner_product(q{k}.v, q{k}.v))))) / pi()"


@query(f"WITH q1 AS (SELECT v FROM $V z WHERE item_id = 1), q2 AS (SELECT v FROM $V z WHERE item_id = 2), q3 AS (SELECT v FROM $V z WHERE item_id = 3) SELECT item_id, round(d, 6) AS dist FROM (SELECT t.item_id, least({PI.format(k=1)}, {PI.format(k=2)}) AS d, {PI.format(k=3)} AS away FROM $V t, q1, q2, q3 WHERE t.item_id NOT IN (1, 2, 3)) x WHERE away > 0.45 ORDER BY d, item_id LIMIT 20")
def alchemy_add_subtract(spark, sf_dir):
    """Near any of the added points, none within reach of a subtracted one; temperature 0."""
    df = vectors(spark, sf_dir)
    points = {r.item_id: r.v for r in df.where("item_id in (1, 2, 3)").collect()}
    to = lambda k: vec.angular_pi(F.col("v"), vec.literal(points[k]))
    found = df.where("item_id not in (1, 2, 3)").select("item_id", F.least(to(1), to(2)).alias("d"), to(3).alias("away")).where("away > 0.45")
    return found.orderBy("d", "item_id").limit(20).select("item_id", F.round("d", 6).alias("dist"))


QUANT = "list_transform({v}, lambda x: greatest(-127, least(127, round_even(x * 127, 0)))::DOUBLE)"


@query(f"WITH s AS (SELECT item_id, {QUANT.format(v='v')} AS v FROM $V t), q AS (SELECT v AS q FROM s WHERE item_id = 0) SELECT item_id, round(d, 6) AS dist FROM (SELECT item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM s, q WHERE item_id <> 0) x ORDER BY d, item_id LIMIT 20")
def quantize_i8_knn(spark, sf_dir):
    s = vectors(spark, sf_dir).select("item_id", vec.quantize(F.col("v")).cast("array<double>").alias("v"))
    return neighbours(s.where("item_id <> 0"), seed_vector(s, 0), 20).select("item_id", F.round("dist", 6).alias("dist"))


@query("""WITH b AS (SELECT item_id, list_transform(v, lambda x: (x > list_avg(v))::INT) AS s FROM $V t),
h AS (SELECT item_id, s, unnest(range(19)) AS band FROM b),
k AS (SELECT item_id, s, band, array_to_string(s[(band * 64) // 19 + 1:((band + 1) * 64) // 19], '') AS key FROM h)
SELECT DISTINCT a.item_id AS a_id, b.item_id AS b_id, list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::INT))::INT AS flips FROM k a JOIN k b ON a.band = b.band AND a.key = b.key AND a.item_id < b.item_id WHERE list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::INT)) <= 18""")
def simhash_band_pairs(spark, sf_dir):
    """Signs about the mean in 19 bands; of 64 bits 18 may differ, so one band is equal. A band's keys are dealt by hash."""
    return band_pairs(vectors(spark, sf_dir), 64, 19, 18)


def band_pairs(df: DataFrame, bits: int, bands: int, flips: int) -> DataFrame:
    """(a_id, b_id, flips) of the pairs with that many different signs at most, by bands of the signature.

    With more bands than flips an equal band is sure. Signatures are whole numbers, so a candidate costs an exclusive or and a bit count,
    and a pair is taken in its first equal band only, so pairs need no distinct. A band's keys are join keys, which AQE may split.
    """
    cuts = [k * bits // bands for k in range(bands + 1)]
    mask = [sum(1 << (j % 64) for j in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")
    if bits > 64:
        raise ValueError("signatures have 64 bits at most")
    s = df.select("item_id", vec.sign_bits(F.col("v"))[0].alias("s"))
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("s").bitwiseAND(signed(m)).alias("key")) for k, m in enumerate(mask)]))
    k = s.select("item_id", "s", key.alias("k")).select("item_id", "s", "k.band", "k.key")
    x, y = k.select(F.col("item_id").alias("a_id"), F.col("s").alias("sa"), "band", "key"), k.select(F.col("item_id").alias("b_id"), F.col("s").alias("sb"), "band", "key")
    differ = F.col("sa").bitwiseXOR(F.col("sb"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(signed(m)) == 0, k) for k, m in enumerate(mask)])
    pairs = x.join(y, ["band", "key"]).where("a_id < b_id").where((F.bit_count(differ) <= flips) & (first == F.col("band")))
    return pairs.select("a_id", "b_id", F.bit_count(differ).cast("int").alias("flips"))


@query("""WITH b AS (SELECT item_id, v, list_transform(v, lambda x: (x > list_avg(v))::INT) AS s FROM $V t),
p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, a.v AS av, b.v AS bv FROM b a JOIN b b ON a.item_id < b.item_id WHERE list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::INT)) <= 18)
SELECT a_id, b_id FROM p JOIN part x ON x.p_partkey = a_id JOIN part y ON y.p_partkey = b_id WHERE abs(x.p_size - y.p_size) <= 25 AND 1 - list_inner_product(av, bv) / sqrt(list_inner_product(av, av)) / sqrt(list_inner_product(bv, bv)) <= 0.7""")
def dup_pair_confirm(spark, sf_dir):
    """Proposed pairs that lengths and then vectors confirm, the cheap test first."""
    df = vectors(spark, sf_dir)
    i = items(spark, sf_dir)
    a = df.join(i, "item_id").select(F.col("item_id").alias("a_id"), F.col("v").alias("av"), F.col("tempo").alias("at"))
    b = df.join(i, "item_id").select(F.col("item_id").alias("b_id"), F.col("v").alias("bv"), F.col("tempo").alias("bt"))
    pairs = band_pairs(df, 64, 19, 18).select("a_id", "b_id").join(a, "a_id").join(b, "b_id")
    return pairs.where("abs(at - bt) <= 25").where(vec.angular(F.col("av"), F.col("bv")) <= 0.7).select("a_id", "b_id")


@query("SELECT vec_id AS item_id, round(list_sum(list_transform(list_sort(list_transform(embedding::DOUBLE[], lambda x: exp(x / 0.1)))[-3:], lambda x: x)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x / 0.1))), 6) AS top3 FROM embeddings")
def axis_softmax(spark, sf_dir):
    """Softmax at temperature 0.1 over an axis; share of the three largest."""
    s = vectors(spark, sf_dir).select("item_id", F.sort_array(vec.softmax(F.col("v"), 0.1), asc=False).alias("s"))
    return s.select("item_id", F.round(F.col("s")[0] + F.col("s")[1] + F.col("s")[2], 6).alias("top3"))
