"""Fitted operators: inverted-file index, clustering, mixtures, projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.index import list_matrix, nearest, probe_cells
from ..sources.scratch import cut
from ..sources.tables import items, vectors
from .similarity import block_neighbours, unit_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The index is fitted on so many rows for each cell at most, those with the smallest hash of their id; every row is indexed.
FIT_ROWS, MAX_CELLS = 50, 8192
#: Rows of a genre that its tree's centres are fitted on at most; all rows are then dealt to the nearest.
GENRE_FIT = 5000
#: Rows of a block of the radius search, at most and, for 16 blocks, at least; and of them those that a task compares at once.
LINK_ROWS, LINK_LEAST, LINK_STEP = 32_768, 4096, 128


def query(f):
    QUERIES[f.__name__] = f
    return f


def build_index(df: DataFrame, cells: int | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(rows with their cell, cell centres). Cells: 8 times the root of the rows, within bounds."""
    n = df.count()
    cells = cells or max(1, min(MAX_CELLS, n, round(8 * math.sqrt(n))))
    some = df.orderBy(F.xxhash64("item_id")).limit(cells * FIT_ROWS).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine").fit(some)
    return model.transform(df.withColumn("features", array_to_vector("v"))).select("item_id", "v", F.col("prediction").alias("cell")), np.array(model.clusterCenters())


def probe(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(query_id, item_id, dist, r): the k nearest rows of each query's nprobe nearest cells. Cells prune files of an index written by cell."""
    rows = indexed.where(vec.finite(F.col("v"))).select("item_id", "v", "cell")
    found = probe_cells(rows, queries.where(vec.finite(F.col("v"))), len(centres), lambda q: nearest(q, centres, nprobe), lambda t, q: (unit_rows(list_matrix(t, "v")), unit_rows(q)), k)
    r = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "item_id"))
    return found.withColumn("r", r).where(F.col("r") <= k)


@query
def ivf_recall(spark, sf_dir):
    """Recall of the index against the exact search, for every 20th item."""
    df = vectors(spark, sf_dir)
    indexed, centres = build_index(df, cells=32)
    q = df.where("item_id % 20 = 0")
    got, want = probe(indexed, centres, q, 10, 20), block_neighbours(df, q, 10)
    hits = want.join(got.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query
def kmeans_playlists(spark, sf_dir):
    """Clusters, their members near the centre, three of an author at most."""
    df = vectors(spark, sf_dir)
    model = KMeans(k=10, seed=1, maxIter=10).fit(df.select(array_to_vector("v").alias("features")))
    centres = F.array(*[vec.literal(c) for c in model.clusterCenters()])
    own = model.transform(df.withColumn("features", array_to_vector("v"))).select("item_id", F.col("prediction").alias("cluster"), vec.euclid(F.col("v"), F.element_at(centres, F.col("prediction") + 1)).alias("d"))
    r = F.row_number().over(W.partitionBy("cluster", "author").orderBy("d", "item_id"))
    return own.join(items(spark, sf_dir).select("item_id", "author"), "item_id").withColumn("r", r).where("r <= 3").select("cluster", "item_id", "author", F.round("d", 6).alias("dist"))


@query
def cluster_metrics(spark, sf_dir):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz, each mapped to 0 to 1."""
    df = vectors(spark, sf_dir).withColumn("features", array_to_vector("v"))
    model = KMeans(k=8, seed=1, maxIter=10).fit(df)
    p = model.transform(df)
    silhouette = ClusteringEvaluator().evaluate(p)
    c = np.array(model.clusterCenters())
    centres = F.array(*[vec.literal(x) for x in c])
    spread = p.select("prediction", vec.euclid(F.col("v"), F.element_at(centres, F.col("prediction") + 1)).alias("d")).groupBy("prediction").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"), F.count("*").alias("n")).orderBy("prediction").collect()
    at, s, n = [r.prediction for r in spread], np.array([r.s for r in spread]), np.array([r.n for r in spread])
    c = c[at]
    gap = np.linalg.norm(c[:, None] - c[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    db = ((s[:, None] + s[None]) / gap).max(axis=1).mean()
    mean = (n[:, None] * c).sum(axis=0) / n.sum()
    ch = ((n * ((c - mean) ** 2).sum(axis=1)).sum() / (len(c) - 1)) / (sum(r.w for r in spread) / (n.sum() - len(c)))
    return spark.createDataFrame([((silhouette + 1) / 2, 1 / (1 + float(db)), 1 - math.exp(-float(ch) / 500))], "silhouette double, davies_bouldin double, calinski_harabasz double")


def mixture(v: np.ndarray, most: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, means) of a spherical mixture whose number of parts has the least BIC; under 5 rows a part each."""
    n, dim = v.shape
    if n < 5:
        return np.full(n, 1 / n), v
    best, rng = None, np.random.default_rng(seed)
    v2 = (v * v).sum(axis=1, keepdims=True)
    far = lambda mean: np.maximum(0, v2 - 2 * v @ mean.T + (mean * mean).sum(axis=1))
    for k in range(1, min(most, n) + 1):
        mean, var, w = v[rng.choice(n, k, replace=False)], np.full(k, v.var() + 1e-6), np.full(k, 1 / k)
        for _ in range(30):
            ll = np.log(w) - 0.5 * dim * np.log(2 * np.pi * var) - far(mean) / (2 * var)
            top = ll.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(ll - top).sum(axis=1))
            r = np.exp(ll - total[:, None])
            size = r.sum(axis=0) + 1e-9
            mean, w = r.T @ v / size[:, None], size / size.sum()
            var = (r * far(mean)).sum(axis=0) / (size * dim) + 1e-6
        bic = -2 * total.sum() + (k * (dim + 2) - 1) * np.log(n)
        if best is None or bic < best[0]:
            best = (bic, w, mean)
    return best[1], best[2]


@query
def gmm_bic(spark, sf_dir):
    return author_mixtures(vectors(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "author"), "item_id"))


def author_mixtures(rows: DataFrame) -> DataFrame:
    """A mixture for each author, of all the author's rows, which one task holds."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        w, m = mixture(np.stack(pdf.v.to_numpy()))
        return pd.DataFrame({"author": pdf.author.iloc[0], "component": range(len(w)), "weight": w.round(6), "norm": np.linalg.norm(m, axis=1).round(6)})

    return rows.select("item_id", "author", "v").groupBy("author").applyInPandas(fit, "author string, component int, weight double, norm double")


@query
def gaussian_mixture(spark, sf_dir):
    df = vectors(spark, sf_dir).withColumn("raw", array_to_vector("v"))
    p = PCA(k=4, inputCol="raw", outputCol="features").fit(df).transform(df)
    m = GaussianMixture(k=5, seed=1, maxIter=20).fit(p)
    return m.transform(p).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query
def pca_map(spark, sf_dir):
    """Two coordinates, centred and scaled to -1 to 1."""
    df = vectors(spark, sf_dir).withColumn("features", array_to_vector("v"))
    p = PCA(k=2, inputCol="features", outputCol="xy").fit(df).transform(df).select("item_id", vector_to_array("xy").alias("xy")).select("item_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    m = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    top = p.agg(F.greatest(F.max(F.abs(F.col("x") - m.mx)), F.max(F.abs(F.col("y") - m.my)))).first()[0] or 1.0
    return p.select("item_id", F.round((F.col("x") - m.mx) / top, 6).alias("x"), F.round((F.col("y") - m.my) / top, 6).alias("y"))


@query
def genre_tree(spark, sf_dir):
    """Edges of genre, cluster, item: k-means in each genre by nearest of a few centres."""
    df = vectors(spark, sf_dir)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        v = np.stack(pdf.v.to_numpy())
        k = max(1, min(6, len(v) // 20))
        c = v[np.linspace(0, len(v) - 1, k).astype(int)]
        for _ in range(10):
            own = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        return pd.DataFrame({"genre": pdf.genre, "cluster": own, "item_id": pdf.item_id})

    # the fit is on a bounded sample of each genre; all rows take the nearest of its centres in the join below
    r = F.row_number().over(W.partitionBy("genre").orderBy(F.xxhash64("item_id")))
    fitted = df.withColumn("r", r).where(F.col("r") <= GENRE_FIT).groupBy("genre").applyInPandas(split, "genre int, cluster int, item_id long")
    means = fitted.join(df.select("item_id", "v"), "item_id").select("genre", "cluster", F.posexplode("v").alias("at", "x")).groupBy("genre", "cluster", "at").agg(F.avg("x").alias("x"))
    means = means.groupBy("genre", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("c"))
    near = df.join(F.broadcast(means), "genre").groupBy("genre", "item_id").agg(F.min_by("cluster", F.struct(vec.euclid(F.col("v"), F.col("c")), F.col("cluster"))).alias("cluster"))
    name = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    leaf = near.select(name("g", F.col("genre"), "/c", F.col("cluster")).alias("parent"), name("i", F.col("item_id")).alias("child"), F.lit("item").alias("kind"))
    folder = near.select("genre", "cluster").distinct().select(name("g", F.col("genre")).alias("parent"), name("g", F.col("genre"), "/c", F.col("cluster")).alias("child"), F.lit("cluster").alias("kind"))
    return leaf.unionByName(folder)


def block_pairs(df: DataFrame, rows: int) -> DataFrame:
    """(a, b, side, ...) of the rows (item_id, v, ...): cut by hash into blocks of about ``rows``, each pair of blocks once, and each block with itself on one side only."""
    n = df.count()
    blocks = max(1, -(-n // min(rows, max(LINK_LEAST, n // 16))))
    own, other = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = df.withColumn("own", own).select("*", other)
    return dealt.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), *df.columns)


def near_chunks(table: pa.Table, eps: float):
    """Of one pair of blocks: ({column: values} of one and of the other, (places in one, places in the other) within eps by angle, a few rows at a time); each pair once."""
    table = table.combine_chunks()
    of = lambda side: table.filter(pa.array(table.column("side").to_numpy() == side))
    one, two = of(0), of(1)
    alone = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    two = one if alone else two
    v, w = unit_rows(list_matrix(one, "v")), unit_rows(list_matrix(two, "v"))

    def links():
        for k in range(0, len(v) if len(w) else 0, LINK_STEP):
            at, to = np.nonzero(1 - v[k : k + LINK_STEP] @ w.T <= eps)
            at = at + k
            once = to > at if alone else slice(None)
            yield at[once], to[once]

    plain = lambda t: {c: t.column(c).to_numpy() for c in t.column_names if c != "v"}
    return plain(one), plain(two), links(), alone


def link_counts(df: DataFrame, eps: float) -> DataFrame:
    """(item_id, more): how many rows are within eps of each row (item_id, v, n), itself left out; a task leaves a count for each of its rows."""

    def meet(table: pa.Table) -> pa.Table:
        one, two, links, alone = near_chunks(table, eps)
        here, there = np.zeros(len(one["n"])), np.zeros(len(two["n"]))
        there = here if alone else there
        for at, to in links:
            here += np.bincount(at, weights=two["n"][to], minlength=len(here))
            there += np.bincount(to, weights=one["n"][at], minlength=len(there))
        item, more = (one["item_id"], here) if alone else (np.concatenate((one["item_id"], two["item_id"])), np.concatenate((here, there)))
        return pa.table({"item_id": item[more > 0], "more": more[more > 0].astype(np.int64)})

    found = block_pairs(df.select("item_id", "v", "n"), LINK_ROWS).groupBy("a", "b").applyInArrow(meet, "item_id long, more long")
    return found.groupBy("item_id").agg(F.sum("more").alias("more"))


def core_links(df: DataFrame, eps: float) -> DataFrame:
    """(query_id, item_id, inner) from (item_id, v, core): of each task the trees that its links among cores span, and all links of a core with another row.

    What is no core has fewer links than a core needs, so there are few of these.
    """

    def meet(table: pa.Table) -> pa.Table:
        one, two, links, alone = near_chunks(table, eps)
        n = len(one["item_id"])
        item, core = (one["item_id"], one["core"]) if alone else (np.concatenate((one["item_id"], two["item_id"])), np.concatenate((one["core"], two["core"])))
        core, shift, root, edge = core.astype(bool), 0 if alone else n, np.arange(len(item)), []
        for at, to in links:
            to = to + shift
            for x, y in ((at, to), (to, at)):
                half = core[x] & ~core[y]
                edge.append((item[x[half]], item[y[half]]))
            both = core[at] & core[to]
            at, to = at[both], to[both]
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                met = root[to[a:b]]
                if (met != root[at[a]]).any():
                    met = np.unique(np.append(met, root[at[a]]))
                    root[np.isin(root, met)] = met[0]
        tree = np.flatnonzero(root != np.arange(len(item)))
        x, y = (np.concatenate(z) for z in zip((item[root[tree]], item[tree]), *edge, strict=True))
        return pa.table({"query_id": x, "item_id": y, "inner": np.arange(len(x)) < len(tree)})

    return block_pairs(df.select("item_id", "v", "core"), LINK_ROWS).groupBy("a", "b").applyInArrow(meet, "query_id long, item_id long, inner boolean")


ORACLE["dbscan_labels"] = """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND 1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) <= 0.62),
core AS (SELECT a AS id FROM l GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT id, id AS label FROM core UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.id JOIN core ON core.id = l.b),
m AS (SELECT id, min(label) AS label FROM r GROUP BY 1), border AS (SELECT l.b AS id, min(m.label) AS label FROM l JOIN m ON m.id = l.a GROUP BY 1)
SELECT v.id AS item_id, coalesce(m.label, border.label, -1) AS cluster FROM v LEFT JOIN m ON m.id = v.id LEFT JOIN border ON border.id = v.id"""


@query
def dbscan_labels(spark, sf_dir):
    return density_labels(vectors(spark, sf_dir), 0.62, 3)


def density_labels(df: DataFrame, eps: float, least: int) -> DataFrame:
    """Density clusters: links up to eps, cores with enough links, core components by the smallest id, borders with their least core.

    Equal vectors share one fate, so the smallest id stands for them, with their number; one without a direction links to nothing.
    """
    long = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0
    same = cut(df.where(vec.finite(F.col("v")) & long).groupBy("v").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")))
    # single floats move as such where they are the same numbers
    single = same.agg(F.bool_and(F.forall("v", lambda x: x.cast("float").cast("double") == x))).first()[0]
    moved = same.withColumn("v", F.col("v").cast("array<float>")) if single else same
    more = cut(link_counts(moved, eps))
    degree = F.col("n") - 1 + F.coalesce("more", F.lit(0))
    size = cut(moved.join(more, "item_id", "left").select("item_id", "v", (degree >= least).cast("int").alias("core")))
    core = size.where("core = 1").select(F.col("item_id").alias("query_id"))
    near = cut(core_links(size, eps))
    links, inner = near.where("not inner"), near.where("inner").select("query_id", "item_id")
    both = cut(inner.union(inner.select("item_id", "query_id")).toDF("a", "b").distinct())
    label = cut(core.select(F.col("query_id").alias("a"), F.col("query_id").alias("l")))
    while True:  # least label of neighbours, then that of the label: rounds grow as the log of a cluster's width
        step = cut(both.join(label.withColumnRenamed("a", "b"), "b").select("a", "l").union(label).groupBy("a").agg(F.min("l").alias("l")))
        after = cut(step.join(step.select(F.col("a").alias("l"), F.col("l").alias("m")), "l", "left").select("a", F.coalesce("m", "l").alias("l")))
        done = after.join(label.withColumnRenamed("l", "was"), "a").where("l <> was").limit(1).count() == 0
        label = after
        if done:
            break
    border = links.join(label.withColumnRenamed("a", "query_id"), "query_id").groupBy("item_id").agg(F.min("l").alias("border"))
    own = df.select("item_id", "v").join(same.select("v", F.col("item_id").alias("same")), "v", "left").select("item_id", "same")
    out = own.join(label.withColumnRenamed("a", "same"), "same", "left").join(border.withColumnRenamed("item_id", "same"), "same", "left")
    return out.select("item_id", F.coalesce("l", "border", F.lit(-1)).cast("long").alias("cluster"))
