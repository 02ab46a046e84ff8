"""Order-dependent selections: each works on the candidates of one query, a few thousand rows at most, gathered by query id.

The candidates come out of a distributed top-k first; what is gathered for one query is bounded by its k, never by the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.scratch import cut
from ..sources.tables import items, vectors
from .similarity import band_pairs, block_neighbours, seed_vector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Batch of the near-copy filter, bucket of the walk, and its weights.
BATCH, BUCKET, STEP_WEIGHT, ANCHOR_WEIGHT = 50, 50, 0.7, 0.3

#: So many open pairs of the merge are settled on the driver.
DRIVER_PAIRS = 100_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _angles(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    norms = np.maximum(np.linalg.norm(m) * np.linalg.norm(rows, axis=1), 1e-300)
    return 1 - rows @ m / norms


def keep_apart(v: np.ndarray, lookback: int = 1, threshold: float = 0.01) -> list[int]:
    """Places kept in order: a row goes if it is closer than the threshold to one of the last kept ones.

    Of more than BATCH rows, batches are filtered in turn; within a batch a row is held against the ``lookback`` kept before the batch
    and every row kept in it.
    """
    kept: list[int] = []
    if len(v) <= BATCH:
        for k in range(len(v)):
            near = kept[-lookback:] if lookback else []
            if not near or (_angles(v[k], v[near]) >= threshold).all():
                kept.append(k)
        return kept
    for low in range(0, len(v), BATCH):
        before = kept[-lookback:] if lookback else []
        now: list[int] = []
        for k in range(low, min(low + BATCH, len(v))):
            near = before + now
            if not near or (_angles(v[k], v[near]) >= threshold).all():
                now.append(k)
        kept += now
    return kept


def walk(v: np.ndarray, dist: np.ndarray, author: list[str | None], n: int, cap: int = 3) -> list[int]:
    """Places of a walk: rows by distance from the anchor in buckets, from one to the next by the least of weighted steps.

    An author is taken once a bucket, from two buckets before the cap is reached, and ``cap`` times in all; rows without an author are
    never held back.
    """
    order = np.lexsort((np.arange(len(dist)), dist))
    out: list[int] = []
    taken: dict[str, int] = {}
    for low in range(0, len(order), BUCKET):
        if len(out) >= n:
            break
        pool, used = list(order[low : low + BUCKET]), set()
        while pool and len(out) < n:
            free = [k for k in pool if not author[k] or (author[k] not in used and taken.get(author[k], 0) < min(2, cap))]
            if not free:
                break
            cost = ANCHOR_WEIGHT * dist[free] + (STEP_WEIGHT * _angles(v[out[-1]], v[free]) if out else 0)
            best = free[int(np.argmin(cost))]
            out.append(best)
            pool.remove(best)
            if author[best]:
                used.add(author[best])
                taken[author[best]] = taken.get(author[best], 0) + 1
    return out


def without_triples(order: list[int], author: list[str | None]) -> list[int]:
    """The same places with no author three times in a row where a later row of another author can be swapped in."""
    order, at = list(order), 0
    while at + 2 < len(order):
        who = author[order[at]]
        if not who or not who == author[order[at + 1]] == author[order[at + 2]]:
            at += 1
            continue
        other = next((j for j in range(at + 3, len(order)) if author[order[j]] != who), None)
        if other is None:
            break
        order[at + 2], order[other] = order[other], order[at + 2]
    return order


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """On the arc from a to b; on the line where they are parallel."""
    ua, ub = a / max(np.linalg.norm(a), 1e-300), b / max(np.linalg.norm(b), 1e-300)
    angle = np.arccos(np.clip(ua @ ub, -1, 1))
    if angle < 1e-6:
        return (1 - t) * a + t * b
    return (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)


#: The circle of fifths, flats beside their sharps, and how far apart energies are as far as can be.
FIFTHS = {k: i for i, names in enumerate(["C", "G", "D", "A", "E", "B", "F# GB", "C# DB", "G# AB", "D# EB", "A# BB", "F"]) for k in names.split()}
ENERGY_SPAN = 0.14


def key_gap(a: str | None, b: str | None, scale_a: str | None = None, scale_b: str | None = None) -> float:
    """0 to 1 on the circle of fifths, a fifth less in an equal scale; 0.5 where a key is not known."""
    name = lambda k: FIFTHS.get((k or "").upper().replace(" ", ""))
    if name(a) is None or name(b) is None:
        return 0.5
    apart = abs(name(a) - name(b))
    gap = min(apart, 12 - apart) / 6
    return 0.8 * gap if scale_a and scale_b and scale_a.lower() == scale_b.lower() else gap


def order_items(tempo: np.ndarray, energy: np.ndarray, key: list[str | None], scale: list[str | None] | None = None) -> list[int]:
    """From the row at the energies' lower quartile, always to the nearest by tempo, energy and key (0.35, 0.35, 0.30)."""
    if not len(tempo):
        return []
    scale = scale or [None] * len(tempo)
    start = int(np.argsort(energy, kind="stable")[len(energy) // 4])
    out, left = [start], [k for k in range(len(tempo)) if k != start]
    while left:
        at = out[-1]
        gap = [key_gap(key[at], key[k], scale[at], scale[k]) for k in left]
        cost = 0.35 * np.minimum(1, np.abs(tempo[left] - tempo[at]) / 80) + 0.35 * np.minimum(1, np.abs(energy[left] - energy[at]) / ENERGY_SPAN) + 0.30 * np.array(gap)
        out.append(left.pop(int(np.argmin(cost))))
    return out


def candidates(spark, sf_dir, k: int = 120) -> DataFrame:
    """(query_id, item_id, dist, v, author, title) of the neighbours of every 20th item."""
    df = vectors(spark, sf_dir)
    found = block_neighbours(df, df.where("item_id % 20 = 0"), k)
    i = items(spark, sf_dir).select("item_id", "author", "title", "tempo", "price")
    return found.join(df.select("item_id", "v"), "item_id").join(i, "item_id", "left")


#: The candidates in SQL, with their place in order of distance, and the angle of two of them.
_V = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_ANGLE = "(1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a})) / sqrt(list_inner_product({b}, {b})))"
_CANDIDATES = f"""c AS (SELECT * FROM (SELECT q.id AS query_id, t.id AS item_id, t.v, {_ANGLE.format(a='q.v', b='t.v')} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {_ANGLE.format(a='q.v', b='t.v')}, t.id) AS k FROM {_V} q, {_V} t WHERE q.id % 20 = 0 AND q.id <> t.id) x WHERE k <= $K)"""

ORACLE["near_dup_lookback"] = f"""WITH RECURSIVE {_CANDIDATES.replace('$K', '120')}, b AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
w AS (SELECT query_id, 0::BIGINT AS k, []::BIGINT[] AS kept, 0::BIGINT AS held FROM b UNION ALL
 SELECT query_id, k, CASE WHEN far THEN list_append(kept, item_id) ELSE kept END, held FROM (
  SELECT w.query_id, c.k, c.item_id, w.kept, CASE WHEN (c.k - 1) % 50 = 0 THEN len(w.kept) ELSE w.held END AS held,
   NOT EXISTS (SELECT 1 FROM c o WHERE o.query_id = w.query_id AND list_contains(w.kept[greatest(1, CASE WHEN (c.k - 1) % 50 = 0 THEN len(w.kept) ELSE w.held END):], o.item_id) AND {_ANGLE.format(a='o.v', b='c.v')} < 0.6) AS far
  FROM w JOIN c ON c.query_id = w.query_id AND c.k = w.k + 1) s)
SELECT w.query_id, unnest(kept) AS item_id, unnest(range(len(kept)))::INT AS place FROM w JOIN b ON b.query_id = w.query_id AND b.n = w.k"""


@query
def near_dup_lookback(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "item_id"]).reset_index(drop=True)
        kept = keep_apart(np.stack(pdf.v.to_numpy()), 1, 0.6)
        return pdf.loc[kept, ["query_id", "item_id"]].assign(place=range(len(kept)))

    return candidates(spark, sf_dir).groupBy("query_id").applyInPandas(run, "query_id long, item_id long, place int")


ORACLE["radius_walk"] = f"""WITH RECURSIVE {_CANDIDATES.replace('$K', '120')}, a AS (SELECT c.*, p_brand AS author, (k - 1) // 50 AS bucket FROM c LEFT JOIN part ON p_partkey = item_id),
w AS (SELECT DISTINCT query_id, 0::BIGINT AS bucket, []::BIGINT[] AS done, []::VARCHAR[] AS here, []::VARCHAR[] AS taken, NULL::DOUBLE[] AS last FROM c UNION ALL
 SELECT query_id, CASE WHEN pick IS NULL THEN bucket + 1 ELSE bucket END, CASE WHEN pick IS NULL THEN done ELSE list_append(done, pick.item_id) END,
  CASE WHEN pick IS NULL THEN [] WHEN pick.author IS NULL THEN here ELSE list_append(here, pick.author) END, CASE WHEN pick.author IS NULL THEN taken ELSE list_append(taken, pick.author) END, CASE WHEN pick IS NULL THEN last ELSE pick.v END FROM (
  SELECT w.*, (SELECT struct_pack(item_id := a.item_id, author := a.author, v := a.v) FROM a WHERE a.query_id = w.query_id AND a.bucket = w.bucket AND NOT list_contains(w.done, a.item_id)
   AND (a.author IS NULL OR (NOT list_contains(w.here, a.author) AND len(list_filter(w.taken, lambda x: x = a.author)) < 2))
   ORDER BY 0.3 * a.d + CASE WHEN w.last IS NULL THEN 0 ELSE 0.7 * {_ANGLE.format(a='a.v', b='w.last')} END, a.k LIMIT 1) AS pick FROM w WHERE len(w.done) < 30 AND w.bucket < 3) s),
e AS (SELECT query_id, arg_max(done, len(done)) AS done FROM w GROUP BY 1)
SELECT query_id, unnest(done) AS item_id, unnest(range(len(done)))::INT AS place FROM e"""


@query
def radius_walk(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "item_id"]).reset_index(drop=True)
        author = [x if isinstance(x, str) else None for x in pdf.author]
        out = without_triples(walk(np.stack(pdf.v.to_numpy()), pdf.dist.to_numpy(), author, 30), author)
        return pdf.loc[out, ["query_id", "item_id"]].assign(place=range(len(out)))

    return candidates(spark, sf_dir).groupBy("query_id").applyInPandas(run, "query_id long, item_id long, place int")


ORACLE["song_path"] = f"""WITH RECURSIVE e AS (SELECT (SELECT v FROM {_V} x WHERE id = 0) AS a, (SELECT v FROM {_V} x WHERE id = 1) AS b), g AS (SELECT a, b, acos(greatest(-1, least(1, 1 - {_ANGLE.format(a='a', b='b')}))) AS g FROM e),
s AS (SELECT k, list_transform(range(1, len(a) + 1), lambda i: (sin((1 - k / 11.0::DOUBLE) * g) * a[i] + sin(k / 11.0::DOUBLE * g) * b[i]) / sin(g)) AS q FROM g, range(1, 11) r(k)),
w AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS used UNION ALL SELECT step + 1, list_append(used, pick) FROM (SELECT w.step, w.used, (SELECT t.id FROM {_V} t, s WHERE s.k = w.step + 1 AND t.id NOT IN (0, 1) AND NOT list_contains(w.used, t.id) ORDER BY {_ANGLE.format(a='t.v', b='s.q')}, t.id LIMIT 1) AS pick FROM w WHERE w.step < 10) z)
SELECT step::INT AS step, used[step] AS item_id FROM w WHERE step > 0 UNION ALL SELECT 0, 0 UNION ALL SELECT 11, 1"""


@query
def song_path(spark, sf_dir):
    """Ten steps on the arc between two items; the nearest item of each step that is not yet on the path."""
    df = vectors(spark, sf_dir)
    a, b = np.array(seed_vector(df, 0)), np.array(seed_vector(df, 1))
    steps = spark.createDataFrame([(-1 - k, [float(x) for x in slerp(a, b, (k + 1) / 11)]) for k in range(10)], "item_id long, v array<double>")
    near = block_neighbours(df.where("item_id not in (0, 1)"), steps, 12).select((-1 - F.col("query_id")).alias("step"), "item_id", "dist").toPandas()  # 120 rows
    used, rows = set(), [(0, 0)]
    for step, some in near.sort_values(["step", "dist", "item_id"]).groupby("step"):
        pick = next((int(x) for x in some.item_id if x not in used), None)
        if pick is not None:
            used.add(pick)
            rows.append((int(step) + 1, pick))
    return spark.createDataFrame([*rows, (11, 1)], "step int, item_id long")


ORACLE["playlist_order"] = f"""WITH RECURSIVE {_CANDIDATES.replace('$K', '40')}, a AS (SELECT query_id, item_id, k, coalesce(p_size, 0) * 4.0::DOUBLE AS tempo, (coalesce(p_retailprice, 900) % 100) / 100 AS energy,
 CASE WHEN item_id % 13 <> 0 THEN [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11][item_id % 12 + 1] END AS place, item_id % 2 AS scale FROM c LEFT JOIN part ON p_partkey = item_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY energy, k) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM a),
w AS (SELECT query_id, [item_id] AS done, tempo, energy, place, scale FROM f WHERE r = n // 4 + 1 UNION ALL SELECT query_id, list_append(done, pick.item_id), pick.tempo, pick.energy, pick.place, pick.scale FROM (
 SELECT w.query_id, w.done, (SELECT struct_pack(item_id := a.item_id, tempo := a.tempo, energy := a.energy, place := a.place, scale := a.scale) FROM a WHERE a.query_id = w.query_id AND NOT list_contains(w.done, a.item_id)
  ORDER BY 0.35 * least(1, abs(a.tempo - w.tempo) / 80) + 0.35 * least(1, abs(a.energy - w.energy) / 0.14::DOUBLE) + 0.30 * CASE WHEN a.place IS NULL OR w.place IS NULL THEN 0.5 ELSE least(abs(a.place - w.place), 12 - abs(a.place - w.place)) / 6.0::DOUBLE * CASE WHEN a.scale = w.scale THEN 0.8::DOUBLE ELSE 1 END END, a.k LIMIT 1) AS pick FROM w) s WHERE pick IS NOT NULL),
e AS (SELECT query_id, arg_max(done, len(done)) AS done FROM w GROUP BY 1)
SELECT query_id, unnest(done) AS item_id, unnest(range(len(done)))::INT AS place FROM e"""


@query
def playlist_order(spark, sf_dir):
    keys = [k for k in FIFTHS if not k.endswith("B") or k == "B"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "item_id"]).head(40).reset_index(drop=True)
        out = order_items(pdf.tempo.fillna(0).to_numpy(float) * 4, (pdf.price.fillna(900).to_numpy(float) % 100) / 100, [keys[int(x) % 12] if int(x) % 13 else None for x in pdf.item_id], ["major" if int(x) % 2 else "minor" for x in pdf.item_id])
        return pdf.loc[out, ["query_id", "item_id"]].assign(place=range(len(out)))

    return candidates(spark, sf_dir, 40).groupBy("query_id").applyInPandas(run, "query_id long, item_id long, place int")


ORACLE["alchemy_sampled"] = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), d AS (SELECT vec_id AS item_id, 1 - list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q, q)) AS d,
 (CAST('0x' || substr(md5('42|' || vec_id), 1, 13) AS BIGINT) + 1) / 4503599627370498.0::DOUBLE AS u FROM embeddings, q WHERE vec_id NOT IN (1, 2))
SELECT item_id, round(d, 6) AS dist FROM d ORDER BY -d / 0.1 - ln(-ln(u)) DESC, item_id LIMIT 20"""


@query
def alchemy_sampled(spark, sf_dir):
    """Softmax sampling without replacement in one pass over all rows: the largest of score / T plus Gumbel noise from a seed."""
    df = vectors(spark, sf_dir)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), F.col("item_id").cast("string"))), 1, 13), 16, 10).cast("double")
    d = df.where("item_id not in (1, 2)").select("item_id", vec.angular(F.col("v"), vec.literal(seed_vector(df, 1))).alias("d"), ((bits + 1) / float((1 << 52) + 2)).alias("u")).where("d is not null")
    return d.select("item_id", "d", (-F.col("d") / 0.1 - F.log(-F.log("u"))).alias("g")).orderBy(F.desc("g"), "item_id").limit(20).select("item_id", F.round("d", 6).alias("dist"))


def settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """The ordered greedy merge of (a_id, b_id, d, a_folder, b_folder): later rows in order of id, each to its nearest earlier match that is free.

    A row that merged is no target, one that is a target may merge no more than it did before it was asked. No group holds two files of
    one folder; an unknown folder is like no other.
    """
    parent: dict[int, int] = {}
    folders: dict[int, set] = {}
    for r in pairs.sort_values(["b_id", "d", "a_id"]).itertuples(index=False):
        if r.b_id in parent or r.a_id in parent:
            continue
        held = folders.setdefault(r.a_id, {r.a_folder} - {None})
        if r.b_folder is not None and r.b_folder in held:
            continue
        parent[r.b_id] = r.a_id
        held.add(r.b_folder)
    return pd.DataFrame({"item_id": list(parent), "merged_into": list(parent.values())}, dtype="int64")


def merge_by_folder(pairs: DataFrame, folders: DataFrame) -> DataFrame:
    """(item_id, merged_into) by settled(), from (a_id, b_id, d) and (item_id, folder). What is not connected does not meet, so each piece is settled on its own."""
    f = lambda s: folders.select(F.col("item_id").alias(f"{s}_id"), F.col("folder").alias(f"{s}_folder"))
    pairs = cut(pairs.select("a_id", "b_id", "d").join(f("a"), "a_id", "left").join(f("b"), "b_id", "left"))
    both = pairs.select(F.col("a_id").alias("x"), F.col("b_id").alias("y"))
    both = cut(both.union(both.select("y", "x")).distinct())
    label = cut(both.select("x").distinct().withColumn("l", F.col("x")))
    while True:  # the least id near, then that one's: rounds grow as the log of a piece's width
        step = cut(both.join(label.select(F.col("x").alias("y"), "l"), "y").select("x", "l").union(label).groupBy("x").agg(F.min("l").alias("l")))
        after = cut(step.join(step.select(F.col("x").alias("l"), F.col("l").alias("m")), "l", "left").select("x", F.coalesce("m", "l").alias("l")))
        done = after.join(label.withColumnRenamed("l", "was"), "x").where("l <> was").limit(1).count() == 0
        label = after
        if done:
            break

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return settled(pdf.astype({"a_folder": object, "b_folder": object}).where(pdf.notna(), None))

    return pairs.join(label.select(F.col("x").alias("b_id"), "l"), "b_id").groupBy("l").applyInPandas(run, "item_id long, merged_into long")


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """(item_id, merged_into) from confirmed pairs (a_id, b_id, d), a before b: the ordered greedy merge, run to its end.

    Items settle in order of id: each joins its nearest earlier match that is not merged itself, and stays a target if there is none.
    An item all of whose earlier matches are merged is a target; one with a target among them is merged. Rounds settle what they can
    until no pair is open; a few open pairs are settled in order on the driver.
    """
    pairs = cut(pairs)
    left, merged = pairs.select("a_id", "b_id"), pairs.select(F.col("b_id").alias("id")).limit(0)
    while n := left.count():
        if n <= DRIVER_PAIRS:
            gone: set[int] = set()
            for r in left.orderBy("b_id", "a_id").collect():
                if r.a_id not in gone:
                    gone.add(r.b_id)
            merged = merged.union(pairs.sparkSession.createDataFrame([(x,) for x in sorted(gone)], merged.schema))
            break
        now = cut(left.join(left.select(F.col("b_id").alias("a_id")).distinct(), "a_id", "left_anti").select(F.col("b_id").alias("id")).distinct())
        merged = merged.union(now)
        left = cut(left.join(now, F.col("b_id") == F.col("id"), "left_anti").join(now, F.col("a_id") == F.col("id"), "left_anti"))
    free = pairs.join(merged, F.col("a_id") == F.col("id"), "left_anti")
    return free.groupBy(F.col("b_id").alias("item_id")).agg(F.min(F.struct("d", "a_id")).alias("m")).select("item_id", F.col("m.a_id").alias("merged_into"))


ORACLE["merge_forest"] = f"""WITH RECURSIVE v AS (SELECT id, v, list_transform(v, lambda x: (x > list_avg(v))::INT) AS s FROM {_V} z),
p AS (SELECT a.id AS a, b.id AS b, {_ANGLE.format(a='a.v', b='b.v')} AS d FROM v a JOIN v b ON a.id < b.id WHERE list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::INT)) <= 18 AND {_ANGLE.format(a='a.v', b='b.v')} <= 0.7),
o AS (SELECT p.*, x.p_brand || '/' || x.p_type AS fa, y.p_brand || '/' || y.p_type AS fb, row_number() OVER (ORDER BY b, d, a) AS n FROM p LEFT JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone, []::BIGINT[] AS into_, []::VARCHAR[] AS held UNION ALL
 SELECT n, CASE WHEN ok THEN list_append(gone, b) ELSE gone END, CASE WHEN ok THEN list_append(into_, a) ELSE into_ END, CASE WHEN ok AND fb IS NOT NULL THEN list_append(held, a || '|' || fb) ELSE held END FROM (
  SELECT o.*, w.gone, w.into_, w.held, NOT list_contains(w.gone, o.a) AND NOT list_contains(w.gone, o.b) AND coalesce(o.fa <> o.fb, true) AND NOT coalesce(list_contains(w.held, o.a || '|' || o.fb), false) AS ok FROM w JOIN o ON o.n = w.n + 1) s)
SELECT unnest(gone) AS item_id, unnest(into_) AS merged_into FROM w WHERE n = (SELECT max(n) FROM w)"""


@query
def merge_forest(spark, sf_dir):
    """Each item joins its nearest earlier match that is not merged itself, so that chains cannot form; no group holds two files of a folder."""
    df = vectors(spark, sf_dir)
    v = df.select("item_id", "v")
    pairs = band_pairs(df, 64, 19, 18).join(v.select(F.col("item_id").alias("a_id"), F.col("v").alias("av")), "a_id").join(v.select(F.col("item_id").alias("b_id"), F.col("v").alias("bv")), "b_id")
    d = pairs.select("a_id", "b_id", vec.angular(F.col("av"), F.col("bv")).alias("d")).where("d <= 0.7")
    return merge_by_folder(d, items(spark, sf_dir).select("item_id", F.concat_ws("/", "author", "album").alias("folder")))
