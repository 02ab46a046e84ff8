"""Matches by tiers, parts of artists, playlists of clusters, trees with subgenres, quotas, and what is told from sound. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import tags, text, vec
from ..sources import providers
from ..sources.scratch import scratch
from ..sources.tables import items, table, vectors
from .features import strip_noise
from .relational import ITEMS, PAIRS
from .similarity import CENTROIDS, VECTORS, centroids

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS).replace("$V", VECTORS)
        return f

    return add


# --- tiers ---------------------------------------------------------------------------------------------------

#: From the surest to the loosest; a tier's columns must all be equal.
TIERS = (("path",), ("tail",), ("title", "author", "album"), ("plain", "who", "album"), ("plain", "who"))


def match_tiers(old: DataFrame, new: DataFrame, tiers=TIERS) -> DataFrame:
    """(old_id, new_id, tier): the first tier that finds a new row for an old one; a new row that several claim goes to the surest, then the smallest old id.

    Of a tier's candidates the smallest new id is all that can be taken, so each tier is one equi-join to one row a key.
    """
    found = None
    for tier, keys in enumerate(tiers, 1):
        one = new.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("new_id").alias("new_id"))
        got = old.join(one, list(keys)).select("old_id", "new_id", F.lit(tier).alias("tier"))
        found = got if found is None else found.unionByName(got)
    best = found.groupBy("old_id").agg(F.min(F.struct("tier", "new_id")).alias("m")).select("old_id", "m.tier", "m.new_id")
    return best.groupBy("new_id").agg(F.min(F.struct("tier", "old_id")).alias("m")).select("m.old_id", "new_id", "m.tier")


MOVED = """o AS (SELECT item_id AS old_id, '/a/' || author || '/' || album || '/' || item_id || '.mp3' AS path, title, author, album FROM $ITEMS i WHERE item_id % 3 = 0),
n AS (SELECT item_id + 1000000 AS new_id, CASE item_id % 5 WHEN 0 THEN '/a/' || author || '/' || album || '/' || item_id || '.mp3' WHEN 1 THEN '/mnt/b/' || author || '/' || album || '/' || item_id || '.mp3' ELSE '/x/' || item_id || '/y/z.mp3' END AS path,
 CASE WHEN item_id % 5 = 3 THEN upper(title) || ' (Live)' ELSE title END AS title, author, CASE WHEN item_id % 5 = 4 THEN 'other' ELSE album END AS album FROM $ITEMS i WHERE item_id % 2 = 0)"""


@query(f"""WITH {MOVED}, ok AS (SELECT *, array_to_string(string_split(lower(path), '/')[-3:], '/') AS tail, lower(title) AS plain, lower(author) AS who FROM o), nk AS (SELECT *, array_to_string(string_split(lower(path), '/')[-3:], '/') AS tail, trim(replace(lower(title), '(live)', '')) AS plain, lower(author) AS who FROM n),
c AS (SELECT old_id, new_id, 1 AS tier FROM ok JOIN nk ON lower(ok.path) = lower(nk.path) UNION ALL SELECT old_id, new_id, 2 FROM ok JOIN nk USING (tail) UNION ALL SELECT old_id, new_id, 3 FROM ok JOIN nk USING (title, author, album) UNION ALL SELECT old_id, new_id, 4 FROM ok JOIN nk USING (plain, who, album) UNION ALL SELECT old_id, new_id, 5 FROM ok JOIN nk USING (plain, who)),
a AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY tier, new_id) AS r FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY tier, old_id) AS q FROM a WHERE r = 1) SELECT old_id, new_id, tier FROM b WHERE q = 1""")
def five_tier_match(spark, sf_dir):
    """A library after a move: by path, by the path's end, by names, by names without noise, by title and author."""
    i = items(spark, sf_dir)
    k, ident = F.col("item_id") % 5, F.col("item_id").cast("string")
    path = lambda root: F.concat(F.lit(root), "author", F.lit("/"), "album", F.lit("/"), ident, F.lit(".mp3"))
    keys = lambda df: df.withColumns({"path": text.path_key(F.col("path")), "tail": text.path_tail(F.col("path")), "plain": strip_noise(F.col("title")), "who": F.lower("author")})
    old = i.where("item_id % 3 = 0").select(F.col("item_id").alias("old_id"), path("/a/").alias("path"), "title", "author", "album")
    new = i.where("item_id % 2 = 0").select(
        (F.col("item_id") + 1_000_000).alias("new_id"), F.when(k == 0, path("/a/")).when(k == 1, path("/mnt/b/")).otherwise(F.concat(F.lit("/x/"), ident, F.lit("/y/z.mp3"))).alias("path"),
        F.when(k == 3, F.concat(F.upper("title"), F.lit(" (Live)"))).otherwise(F.col("title")).alias("title"), "author", F.when(k == 4, "other").otherwise(F.col("album")).alias("album"),
    )
    return match_tiers(keys(old), keys(new))


@query("SELECT 'plain' AS kind, item_id::VARCHAR AS provider_id, title, author, album, tempo * 1.5::DOUBLE AS seconds FROM $ITEMS i WHERE item_id < 50 UNION ALL SELECT 'nested', item_id::VARCHAR, title, author, album, tempo::DOUBLE FROM $ITEMS i WHERE item_id < 50 UNION ALL SELECT 'tagged', item_id::VARCHAR, title, author, album, tempo / 4.0::DOUBLE FROM $ITEMS i WHERE item_id < 50")
def provider_reads(spark, sf_dir):
    """The same items as three kinds of server tell them, read alike."""
    i = items(spark, sf_dir).where("item_id < 50")
    ident = F.col("item_id").cast("string")
    told = {
        "plain": i.select(ident.alias("id"), "title", F.col("author").alias("artist"), "album", F.lit("/p").alias("path"), (F.col("tempo") * 1.5).alias("duration")),
        "nested": i.select(ident.alias("Id"), F.col("title").alias("Name"), F.array("author").alias("Artists"), F.struct(F.col("album").alias("Name")).alias("Album"), F.array(F.struct(F.lit("/p").alias("Path"))).alias("MediaSources"), (F.col("tempo").cast("long") * 10_000_000).alias("RunTimeTicks")),
        "tagged": i.select(ident.alias("key"), F.create_map(F.lit("title"), "title", F.lit("artist"), "author", F.lit("album"), "album").alias("tags"), F.lit("/f").alias("folder"), F.lit("x").alias("file"), (F.col("tempo").cast("long") * 250).alias("ms")),
    }
    out = None
    for kind, df in told.items():
        path = scratch(spark)
        df.write.json(path)
        part = providers.read(spark, kind, path).select(F.lit(kind).alias("kind"), "provider_id", "title", "author", "album", "seconds")
        out = part if out is None else out.unionByName(part)
    return out


# --- parts and playlists -------------------------------------------------------------------------------------


def parts_of_artists(spark, sf_dir) -> DataFrame:
    """(artist, comp, v): the mean vector of each part of each artist."""
    c = items(spark, sf_dir).join(vectors(spark, sf_dir), "item_id").select(F.col("author").alias("artist"), (F.col("tempo") % 3).alias("comp"), "v")
    part = c.select("artist", "comp", F.posexplode("v").alias("at", "x")).groupBy("artist", "comp", "at").agg(F.avg("x").alias("x"))
    return part.groupBy("artist", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("v"))


@query("""WITH c AS (SELECT p_brand AS artist, p_size % 3 AS comp, v FROM part JOIN $V t ON item_id = p_partkey),
g AS (SELECT artist, comp, list(x ORDER BY pos) AS v FROM (SELECT artist, comp, pos, avg(x) AS x FROM (SELECT artist, comp, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c) e GROUP BY 1, 2, 3) z GROUP BY 1, 2),
d AS (SELECT b.artist, a.comp, b.comp AS other, 1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) AS d FROM g a, g b WHERE a.artist = 'Brand#11' AND b.artist <> a.artist)
SELECT artist, comp, other, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY artist, comp ORDER BY d, other) AS r FROM d) x WHERE r = 1""")
def component_matches(spark, sf_dir):
    """For each part of one artist the nearest part of every other one."""
    g = parts_of_artists(spark, sf_dir)
    mine = g.where("artist = 'Brand#11'").select(F.col("comp").alias("own"), F.col("v").alias("q"))  # a few rows
    d = g.where("artist <> 'Brand#11'").join(F.broadcast(mine), F.lit(True)).select("artist", F.col("own").alias("comp"), F.col("comp").alias("other"), vec.angular(F.col("v"), F.col("q")).alias("d"))
    return d.groupBy("artist", "comp").agg(F.min(F.struct("d", "other")).alias("m")).select("artist", "comp", "m.other", F.round("m.d", 6).alias("dist"))


@query(f"""WITH d AS (SELECT t.item_id, t.genre, list_distance(v, c) AS d FROM $V t JOIN {CENTROIDS} m ON m.genre = t.genre), near AS (SELECT *, max(d) OVER (PARTITION BY genre) AS far FROM d),
k AS (SELECT near.genre, near.item_id, d, author, row_number() OVER (PARTITION BY near.genre, author ORDER BY d, near.item_id) AS r FROM near JOIN $ITEMS i ON i.item_id = near.item_id WHERE d <= 0.97 * far),
s AS (SELECT k.genre, label, avg(score) AS s FROM k JOIN $PAIRS p ON p.item_id = k.item_id WHERE r <= 3 GROUP BY 1, 2), t AS (SELECT genre, first(label ORDER BY s DESC, label) AS top FROM s GROUP BY 1)
SELECT k.genre, top || CASE WHEN avg(tempo) >= 26 THEN ' fast' ELSE ' slow' END AS name, count(*) AS members FROM k JOIN t ON t.genre = k.genre JOIN $ITEMS i ON i.item_id = k.item_id WHERE r <= 3 GROUP BY k.genre, top""")
def cluster_playlists(spark, sf_dir):
    """A playlist a cluster: members not too far out, three of an author, named by the best label and the tempo."""
    df = vectors(spark, sf_dir)
    d = df.join(centroids(df, "genre").withColumnRenamed("v", "c"), "genre").select("genre", "item_id", vec.euclid(F.col("v"), F.col("c")).alias("d"))
    far = d.groupBy("genre").agg(F.max("d").alias("far"))
    near = d.join(F.broadcast(far), "genre").where("d <= 0.97 * far").join(items(spark, sf_dir).select("item_id", "author", "tempo", "tags"), "item_id")
    kept = near.withColumn("r", F.row_number().over(W.partitionBy("genre", "author").orderBy("d", "item_id"))).where("r <= 3")
    said = kept.select("genre", F.explode(tags.parse(F.col("tags"))).alias("label", "score")).groupBy("genre", "label").agg(F.avg("score").alias("s"))
    top = said.groupBy("genre").agg(F.min(F.struct((-F.col("s")).alias("s"), "label")).alias("m")).select("genre", "m.label")
    n = kept.groupBy("genre").agg(F.count("*").alias("members"), F.avg("tempo").alias("t"))
    return n.join(top, "genre").select("genre", F.concat("label", F.when(F.col("t") >= 26, " fast").otherwise(" slow")).alias("name"), "members")


@query("""WITH s AS (SELECT genre, part, list(x ORDER BY pos) AS c FROM (SELECT genre, item_id % 3 AS part, pos, avg(x) AS x FROM (SELECT genre, item_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM $V t) e GROUP BY 1, 2, 3) z GROUP BY 1, 2),
n AS (SELECT t.genre, t.item_id, part, row_number() OVER (PARTITION BY t.item_id ORDER BY list_distance(v, c), part) AS r FROM $V t JOIN s ON s.genre = t.genre), m AS (SELECT genre, part, count(*) AS k FROM n WHERE r = 1 GROUP BY 1, 2)
SELECT CASE WHEN k >= 15 THEN 'g' || n.genre || '/s' || n.part ELSE 'g' || n.genre END AS parent, 'i' || item_id AS child FROM n JOIN m ON m.genre = n.genre AND m.part = n.part WHERE r = 1 UNION ALL SELECT 'g' || genre, 'g' || genre || '/s' || part FROM m WHERE k >= 15 UNION ALL SELECT DISTINCT 'root', 'g' || genre FROM m""")
def subgenre_tree(spark, sf_dir):
    """Root, genre, subgenre, item: each item with the nearest of its genre's centres; a subgenre of under fifteen items is its genre."""
    df = vectors(spark, sf_dir).withColumn("part", F.col("item_id") % 3)
    x = df.select("genre", "part", F.posexplode("v").alias("at", "x")).groupBy("genre", "part", "at").agg(F.avg("x").alias("x"))
    c = x.groupBy("genre", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("c"))  # three rows a genre
    near = df.select("item_id", "genre", "v").join(F.broadcast(c), "genre").groupBy("genre", "item_id").agg(F.min_by("part", F.struct(vec.euclid(F.col("v"), F.col("c")), F.col("part"))).alias("part"))
    m = near.groupBy("genre", "part").agg(F.count("*").alias("k"))
    genre = F.concat(F.lit("g"), F.col("genre").cast("string"))
    sub = F.concat(genre, F.lit("/s"), F.col("part").cast("string"))
    leaf = near.join(F.broadcast(m), ["genre", "part"]).select(F.when(F.col("k") >= 15, sub).otherwise(genre).alias("parent"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("child"))
    return leaf.unionByName(m.where("k >= 15").select(genre.alias("parent"), sub.alias("child"))).unionByName(m.select("genre").distinct().select(F.lit("root").alias("parent"), genre.alias("child")))


# --- quotas --------------------------------------------------------------------------------------------------


def water_fill(counts: dict, total: int) -> dict:
    """How many of each group make up a total, as even as the groups allow; what is left over goes to the first groups by name that have more."""
    total = min(total, sum(counts.values()))
    level = 0
    while sum(min(c, level + 1) for c in counts.values()) <= total and level < max(counts.values(), default=0):
        level += 1
    out = {g: min(c, level) for g, c in counts.items()}
    for g in sorted(counts):
        if sum(out.values()) < total and counts[g] > level:
            out[g] += 1
    return out


@query("""WITH n AS (SELECT label AS genre, count(*) AS c FROM embeddings GROUP BY 1), l AS (SELECT max(k) AS level FROM range(1, 100000) r(k) WHERE (SELECT sum(least(c, k)) FROM n) <= (SELECT round(0.93 * sum(c)) FROM n) AND k <= (SELECT max(c) FROM n)),
q AS (SELECT genre, c, least(c, level) AS q, (SELECT round(0.93 * sum(c)) FROM n) - (SELECT sum(least(c, level)) FROM n, l) AS rest, level FROM n, l), x AS (SELECT genre, q + CASE WHEN c > level AND row_number() OVER (PARTITION BY c > level ORDER BY genre) <= rest THEN 1 ELSE 0 END AS q FROM q)
SELECT vec_id AS item_id, e.genre FROM (SELECT vec_id, label AS genre, row_number() OVER (PARTITION BY label ORDER BY md5('w|' || vec_id), vec_id) AS r FROM embeddings) e JOIN x ON x.genre = e.genre WHERE r <= q""")
def water_filled_sample(spark, sf_dir):
    """A sample of 0.93 of all rows, as even over the genres as they allow, drawn by seed."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("genre"))
    counts = {r.genre: r["count"] for r in e.groupBy("genre").count().collect()}  # a row a genre
    quota = water_fill(counts, round(0.93 * sum(counts.values())))
    named = F.create_map([F.lit(x) for kv in quota.items() for x in kv]) if quota else F.lit(None)
    r = F.row_number().over(W.partitionBy("genre").orderBy(F.md5(F.concat(F.lit("w|"), F.col("item_id").cast("string"))), "item_id"))
    return e.withColumn("r", r).where(F.col("r") <= max(quota.values(), default=0)).where(F.col("r") <= named[F.col("genre")]).drop("r")


# --- sound ---------------------------------------------------------------------------------------------------

#: The published profiles of major and minor keys over the twelve semitones.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def folded_tempo(c: Column, low: float = 40.0, high: float = 200.0) -> Column:
    """Doubled or halved into a range; null for what is not above 0."""
    up = F.ceil(F.greatest(F.lit(0.0), F.log2(F.lit(low) / c)))
    down = F.ceil(F.greatest(F.lit(0.0), F.log2(c / F.lit(high))))
    return F.when(c > 0, c * F.pow(F.lit(2.0), up - down))


def key_of(chroma: Column) -> Column:
    """struct<r, key, scale>: the key whose profile correlates best with twelve semitones, of equals the first by name."""
    scored = []
    for scale, profile in (("major", MAJOR), ("minor", MINOR)):
        p = np.array(profile) - np.mean(profile)
        for k, note in enumerate(NOTES):
            scored.append((F.lit(note), F.lit(scale), vec.literal(np.roll(p / np.linalg.norm(p), k))))

    def of(c):
        return F.array_min(F.array(*[F.struct((-F.round(vec.dot(c, profile), 9)).alias("r"), note.alias("key"), scale.alias("scale")) for note, scale, profile in scored]))

    mean = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x) / F.size(chroma)
    return vec.let(mean, lambda m: vec.let(vec.unit(F.transform(chroma, lambda x: x - m)), of))


_ROLLED = ", ".join(f"{{'key': '{note}', 'scale': '{scale}', 'p': [{', '.join(repr(float(x)) for x in np.roll(np.array(p) - np.mean(p), k) / np.linalg.norm(np.array(p) - np.mean(p)))}]}}" for scale, p in (("major", MAJOR), ("minor", MINOR)) for k, note in enumerate(NOTES))


@query(f"""WITH c AS (SELECT vec_id AS item_id, embedding[1:12]::DOUBLE[] AS c FROM embeddings), z AS (SELECT item_id, list_transform(c, lambda x: x - list_avg(c)) AS c FROM c), k AS (SELECT unnest([{_ROLLED}]) AS k),
s AS (SELECT item_id, k.key AS key, k.scale AS scale, round(list_inner_product(c, k.p) / sqrt(list_inner_product(c, c)), 9) AS r FROM z, k)
SELECT item_id, key, scale, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY r DESC, key, scale) AS n FROM s) x WHERE n = 1""")
def estimated_keys(spark, sf_dir):
    """The key of each item by its first twelve numbers."""
    k = vectors(spark, sf_dir).select("item_id", key_of(F.slice("v", 1, 12)).alias("k"))
    return k.select("item_id", "k.key", "k.scale", F.round(-F.col("k.r"), 6).alias("r"))


@query("SELECT item_id, round(CASE WHEN t <= 0 THEN NULL WHEN t < 40 THEN t * pow(2, ceil(log2(40 / t))) WHEN t > 200 THEN t / pow(2, ceil(log2(t / 200))) ELSE t END, 6) AS tempo FROM (SELECT item_id, (item_id % 700 - 10)::DOUBLE AS t FROM $ITEMS i) x")
def folded_tempos(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", F.round(folded_tempo((F.col("item_id") % 700 - 10).cast("double")), 6).alias("tempo"))
