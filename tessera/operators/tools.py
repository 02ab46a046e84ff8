"""Queries as tools: a dict of arguments becomes a DataFrame. And what is stored and loaded again. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import tags, text, vec
from ..plans import hooks
from ..sources import index as store
from ..sources import sinks
from ..sources.scratch import cut, scratch
from ..sources.tables import bridge, items, table, vectors
from .features import has_word, reroute
from .learned import mixture
from .relational import ITEMS, PAIRS
from .search import over_fetch, shaped
from .similarity import ANGLE, CENTROIDS, SEED, VECTORS, centroids, neighbours, seed_vector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS).replace("$SEED", SEED).replace("$NORM", "sqrt(list_inner_product(v, v))").replace("$V", VECTORS)
        return f

    return add


# --- searches as tools ---------------------------------------------------------------------------------------

FULL = f"(SELECT *, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][item_id % 12 + 1] AS key, CASE WHEN item_id % 2 = 0 THEN 'major' ELSE 'minor' END AS scale, 1970 + item_id % 50 AS year, item_id % 6 AS rating, item_id % 4 = 0 AS instrumental FROM {ITEMS} i)"


def full_items(spark, sf_dir) -> DataFrame:
    """The catalogue with key, scale, year, rating and whether there are words."""
    k = F.col("item_id")
    key = F.element_at(F.array(*map(F.lit, KEYS)), (k % 12 + 1).cast("int"))
    return items(spark, sf_dir).withColumns({"key": key, "scale": F.when(k % 2 == 0, "major").otherwise("minor"), "year": k % 50 + 1970, "rating": k % 6, "instrumental": k % 4 == 0})


#: What search_database() knows; anything else is refused.
ARGUMENTS = {"genres", "moods", "other", "exclude_genres", "exclude_authors", "author", "album", "key", "scale", "instrumental", "tempo", "year", "rating", "pool", "least", "limit"}


def search_database(df: DataFrame, args: dict) -> DataFrame:
    """Rows that fit every argument given: any of the genres, any of the labels, ranges with open ends, an author by name or as a whole word, a pool of ids.

    Dense labels asked for as genres or moods are looked up among the scores. Best are those that fit most labels; ties by id.
    """
    if extra := set(args) - ARGUMENTS:
        raise ValueError(f"unknown arguments: {sorted(extra)}")
    wanted, least = reroute({k: args.get(k, []) for k in ("genres", "moods", "other")}), args.get("least", 0.5)
    if wanted["genres"]:
        df = df.where(F.lower("album").isin([g.lower() for g in wanted["genres"]]))
    labels = wanted["other"] + wanted["moods"]
    fits = [F.when(tags.has_at_least(F.col("tags"), x, least), 1).otherwise(0) for x in labels]
    hits = sum(fits, F.lit(0))
    if labels:
        df = df.where(hits > 0)
    for x in args.get("exclude_genres", []):
        df = df.where(~tags.has_at_least(F.col("tags"), x, 0.3) & (F.lower("album") != x.lower()))
    if args.get("exclude_authors"):
        df = df.where(~F.lower("author").isin([a.lower() for a in args["exclude_authors"]]))
    if args.get("author"):
        df = df.where((text.match_key(F.col("author")) == text.match_key(F.lit(args["author"]))) | has_word(F.col("author"), args["author"]))
    if args.get("album"):
        df = df.where(F.lower("album").contains(args["album"].lower()))
    for name in ("key", "scale", "instrumental"):
        if args.get(name) is not None:
            df = df.where(F.col(name) == args[name])
    for name in ("tempo", "year", "rating"):
        low, high = args.get(name) or (None, None)
        df = df.where(F.col(name) >= low) if low is not None else df
        df = df.where(F.col(name) <= high) if high is not None else df
    if args.get("pool") is not None:
        df = df.join(args["pool"].select("item_id").distinct(), "item_id", "left_semi")
    return df.select("item_id", "title", "author", hits.alias("hits")).orderBy(F.desc("hits"), "item_id").limit(args.get("limit", 100))


@query(f"""SELECT item_id, title, author, h AS hits FROM (SELECT *, (tempo * 2 - 1 >= 50)::INT + (item_id * 29 % 100 >= 50)::INT AS h FROM {FULL} f) x WHERE h > 0 AND lower(album) IN ('small', 'large') AND NOT item_id * 7 % 100 >= 30 AND lower(author) <> 'brand#11' AND scale = 'minor' AND year BETWEEN 1980 AND 2015 AND rating >= 1 AND tempo <= 45
AND item_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <= 60) ORDER BY h DESC, item_id LIMIT 100""")
def tool_search_database(spark, sf_dir):
    args = {"genres": ["Small", "LARGE", "happy"], "moods": ["party"], "exclude_genres": ["sad"], "exclude_authors": ["brand#11"], "scale": "minor", "year": (1980, 2015), "rating": (1, None), "tempo": (None, 45)}
    return search_database(full_items(spark, sf_dir), args | {"pool": bridge(spark, sf_dir).where("server_id <= 60")})


@query(f"SELECT item_id, title, author, 0 AS hits FROM {FULL} f WHERE regexp_matches(author, '(?i)(^|[^a-z0-9])12([^a-z0-9]|$)') AND instrumental AND key = 'C' ORDER BY item_id LIMIT 50")
def tool_search_words(spark, sf_dir):
    """An author by a whole word of the name, a key, and no words sung."""
    return search_database(full_items(spark, sf_dir), {"author": "12", "key": "C", "instrumental": True, "limit": 50})


def seed_search(spark, sf_dir, args: dict) -> DataFrame:
    """Items like a seed named by title and author: the seed is looked up, its neighbours fetched, the seed dropped, the rest in order."""
    i, df = items(spark, sf_dir), vectors(spark, sf_dir)
    same = (text.match_key(F.col("title")) == text.match_key(F.lit(args["title"]))) & (text.match_key(F.col("author")) == text.match_key(F.lit(args["author"])))
    seed = i.where(same).join(df.select("item_id"), "item_id", "left_semi").orderBy("item_id").first()
    if seed is None:
        return i.select("item_id", "title", "author", F.lit(0.0).alias("dist")).limit(0)
    n = args.get("n", 20)
    found = neighbours(df.where(F.col("item_id") != seed.item_id), seed_vector(df, seed.item_id), over_fetch(n))
    return shaped(found, i, n, target=seed, apart=0)


@query("""WITH s AS (SELECT item_id, title, author FROM $ITEMS i JOIN embeddings ON vec_id = item_id WHERE lower(translate(title, ' -/''', '')) = (SELECT lower(translate(p_name, ' -/''', '')) FROM part WHERE p_partkey = 40) AND lower(author) = (SELECT lower(p_brand) FROM part WHERE p_partkey = 40) ORDER BY item_id LIMIT 1),
q AS (SELECT v AS q FROM $V z JOIN s ON s.item_id = z.item_id), c AS (SELECT t.item_id, 1 - list_inner_product(v, q) / ($NORM * sqrt(list_inner_product(q, q))) AS d FROM $V t, q WHERE t.item_id <> (SELECT item_id FROM s) ORDER BY d, t.item_id LIMIT 61),
u AS (SELECT c.item_id, d, i.title, i.author, row_number() OVER (PARTITION BY lower(trim(i.title)), lower(trim(i.author)) ORDER BY d, c.item_id) AS r FROM c JOIN $ITEMS i ON i.item_id = c.item_id, s WHERE NOT (lower(i.title) = lower(s.title) AND lower(i.author) = lower(s.author))),
a AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY d, item_id) AS k FROM u WHERE r = 1) SELECT item_id, title, author, round(d, 6) AS dist FROM a WHERE k <= 3 ORDER BY d, item_id LIMIT 15""")
def tool_seed_search(spark, sf_dir):
    seed = items(spark, sf_dir).where("item_id = 40").first()
    return seed_search(spark, sf_dir, {"title": seed.title.upper(), "author": seed.author.lower(), "n": 15}).withColumn("dist", F.round("dist", 6))


def text_match(df: DataFrame, args: dict) -> DataFrame:
    """Rows that hold every word asked for in title, author or album; the title counts 3, the author 2, the album 1."""
    key, hit, score = text.search_key(F.col("title"), F.col("author"), F.col("album")), F.lit(True), F.lit(0)
    for word in args["text"].lower().split():
        hit &= key.contains(word)
        for col, w in (("title", 3), ("author", 2), ("album", 1)):
            score = score + F.when(text.unaccent(F.lower(col)).contains(word), w).otherwise(0)
    return df.where(hit).select("item_id", "title", "author", score.alias("score")).orderBy(F.desc("score"), "item_id").limit(args.get("limit", 50))


@query("SELECT item_id, title, author, CASE WHEN lower(title) LIKE '%small%' THEN 3 ELSE 0 END + CASE WHEN lower(author) LIKE '%small%' THEN 2 ELSE 0 END + CASE WHEN lower(album) LIKE '%small%' THEN 1 ELSE 0 END + CASE WHEN lower(title) LIKE '%2%' THEN 3 ELSE 0 END + CASE WHEN lower(author) LIKE '%2%' THEN 2 ELSE 0 END + CASE WHEN lower(album) LIKE '%2%' THEN 1 ELSE 0 END AS score FROM $ITEMS i WHERE lower(title || ' ' || author || ' ' || album) LIKE '%small%' AND lower(title || ' ' || author || ' ' || album) LIKE '%2%' ORDER BY score DESC, item_id LIMIT 50")
def tool_text_match(spark, sf_dir):
    return text_match(items(spark, sf_dir), {"text": "Small 2"})


@query("SELECT 'items' AS what, count(*) AS n, count(DISTINCT author) AS authors, min(tempo) AS low, max(tempo) AS high FROM $ITEMS i")
def tool_knowledge(spark, sf_dir):
    """What there is to ask for: how many items and authors, and the range of tempo."""
    return items(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"), F.min("tempo").alias("low"), F.max("tempo").alias("high")).select(F.lit("items").alias("what"), "*")


# --- stored and loaded again ---------------------------------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT ON (l_suppkey, l_partkey) l_suppkey AS server_id, l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS provider_id FROM lineitem WHERE l_quantity > 25 ORDER BY l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber),
s AS (SELECT server_id, item_id + 1 AS item_id, provider_id FROM b WHERE provider_id % 5 = 0), o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id, item_id ORDER BY provider_id DESC) AS r FROM s) x WHERE r = 1),
o AS (SELECT * FROM (SELECT server_id, item_id, provider_id, row_number() OVER (PARTITION BY provider_id ORDER BY server_id DESC, item_id DESC) AS q FROM o1) x WHERE q = 1)
SELECT server_id, item_id, provider_id FROM o UNION ALL SELECT server_id, item_id, provider_id FROM b WHERE (server_id, item_id) NOT IN (SELECT server_id, item_id FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.provider_id = b.provider_id AND (o.server_id, o.item_id) <> (b.server_id, b.item_id))""")
def staged_mappings(spark, sf_dir):
    """Files that were found to be another item: the new mapping displaces the old one of the same file."""
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_partkey").alias("item_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("provider_id"))
    return sinks.staged_upsert(b, b.where("provider_id % 5 = 0").withColumn("item_id", F.col("item_id") + 1), ["server_id", "item_id"], ["provider_id"])


@query("SELECT vec_id AS item_id, round(CASE WHEN vec_id % 6 = 0 THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings UNION ALL SELECT 1000000 + vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 60 = 0")
def vector_upsert(spark, sf_dir):
    """Vectors replaced and added by key."""
    from ..sources.tables import upsert

    df = vectors(spark, sf_dir).select("item_id", "v")
    delta = df.where("item_id % 6 = 0").withColumn("v", F.transform("v", lambda x: x * 2)).unionByName(df.where("item_id % 60 = 0").withColumn("item_id", F.col("item_id") + 1_000_000))
    return upsert(df, delta, ["item_id"]).select("item_id", F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT doc_id, md5(coalesce(text, 'null')) AS hash, lang FROM documents")
def copy_round_trip(spark, sf_dir):
    """Texts with tabs, line feeds and backslashes, out as lines of text and in again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = scratch(spark)
    sinks.copy_out(d, path)
    return sinks.copy_in(spark, path, d.schema).select("doc_id", F.md5(F.coalesce("text", F.lit("null"))).alias("hash"), "lang")


@query(f"SELECT genre, len(c) AS dim, round(c[1], 6) AS first FROM {CENTROIDS} x")
def reference_data(spark, sf_dir):
    """Centres by mood, kept as JSON and read with a schema."""
    path = scratch(spark)
    rows = centroids(vectors(spark, sf_dir), "genre").collect()  # a row a genre
    sinks.save_reference(spark, path, [{"genre": r.genre, "centre": list(r.v)} for r in rows])
    return sinks.load_reference(spark, path, "genre int, centre array<double>").select("genre", F.size("centre").cast("long").alias("dim"), F.round(F.col("centre")[0], 6).alias("first"))


@query("""WITH b AS (SELECT l_suppkey AS server_id, year(l_shipdate)::INT AS round, l_orderkey AS name, l_linenumber AS place, l_partkey AS item_id FROM lineitem WHERE l_suppkey <= 20), n AS (SELECT server_id, max(round) AS round FROM b WHERE server_id % 2 = 0 GROUP BY 1),
k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.server_id = b.server_id AND n.round = b.round) UNION ALL SELECT server_id, round, 0, 1, server_id FROM n), r AS (SELECT server_id, round, row_number() OVER (PARTITION BY server_id ORDER BY round DESC) AS r FROM (SELECT DISTINCT server_id, round FROM k) d)
SELECT server_id, round, count(*) AS places FROM k JOIN r USING (server_id, round) WHERE r <= 3 GROUP BY 1, 2""")
def playlist_rounds(spark, sf_dir):
    """New playlists replace a server's last round; three rounds of each server stay."""
    x = table(spark, sf_dir, "lineitem").where("l_suppkey <= 20")
    base = x.select(F.col("l_suppkey").alias("server_id"), F.year("l_shipdate").alias("round"), F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("item_id"))
    new = base.where("server_id % 2 = 0").groupBy("server_id").agg(F.max("round").alias("round")).select("server_id", "round", F.lit(0).cast("long").alias("name"), F.lit(1).alias("place"), F.col("server_id").alias("item_id"))
    return sinks.replace_playlists(base, new).groupBy("server_id", "round").agg(F.count("*").alias("places"))


@query("SELECT 2::BIGINT AS version, item_id, title FROM $ITEMS i WHERE tempo > 40")
def current_snapshot(spark, sf_dir):
    """Two snapshots published; the pointer leads to the second."""
    i, root = items(spark, sf_dir).select("item_id", "title", "tempo"), scratch(spark)
    for version, least in ((1, 10), (2, 40)):
        sinks.publish(i.where(F.col("tempo") > least).drop("tempo"), root, version)
    version, rows = sinks.current(spark, root)
    return rows.select(F.lit(version).cast("long").alias("version"), "item_id", "title")


@query("SELECT item_id, upper(title) AS title, tempo * 2 AS tempo FROM $ITEMS i WHERE tempo > 20")
def hooked_items(spark, sf_dir):
    """Two transforms added by name, one that runs on what is written, in order."""
    for name in ("loud", "fast"):
        hooks.remove(name)
    hooks.transform("loud", on_write=True)(lambda df: df.withColumn("title", F.upper("title")))
    hooks.transform("fast")(lambda df: df.where("tempo > 20").withColumn("tempo", F.col("tempo") * 2))
    out = hooks.written(hooks.apply(items(spark, sf_dir).select("item_id", "title", "tempo"), "fast"))
    for name in ("loud", "fast"):
        hooks.remove(name)
    return out


@query("SELECT 'audio' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'words', count(*) FROM embeddings")
def index_builders(spark, sf_dir):
    """One index for each column of vectors."""
    df, out = vectors(spark, sf_dir), None
    both = df.select("item_id", F.slice("v", 1, 32).alias("audio"), F.slice("v", 33, 32).alias("words"))
    for name in ("audio", "words"):
        path = scratch(spark)
        store.write_index(both, path, name, cells=12)
        part = store.load_index(spark, path).rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- profiles ------------------------------------------------------------------------------------------------


@query()
def genre_profiles(spark, sf_dir):
    """For each genre a few clusters: centre's norm, mean labels, the three nearest items. The centres are fitted by genre, one job each."""
    df = cut(vectors(spark, sf_dir))
    n = {r.genre: r["count"] for r in df.groupBy("genre").count().collect()}  # a row a genre
    placed = None
    for genre, count in sorted(n.items()):
        mine = df.where(F.col("genre") == genre).withColumn("features", array_to_vector("v"))
        model = KMeans(k=min(8, max(2, count // 400 + 2)), seed=1, maxIter=5).fit(mine)
        centres = F.array(*[vec.literal(c) for c in model.clusterCenters()])
        part = model.transform(mine).select("genre", F.col("prediction").alias("cluster"), "item_id", vec.euclid(F.col("v"), F.element_at(centres, F.col("prediction") + 1)).alias("d"))
        placed = part if placed is None else placed.unionByName(part)
    placed = cut(placed)
    near = placed.withColumn("r", F.row_number().over(W.partitionBy("genre", "cluster").orderBy("d", "item_id"))).where("r <= 3").groupBy("genre", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "item_id"))), lambda e: e["item_id"].cast("string")), ",").alias("samples"))
    said = placed.join(items(spark, sf_dir).select("item_id", F.explode(tags.parse(F.col("tags"))).alias("label", "score")), "item_id").groupBy("genre", "cluster", "label").agg(F.avg("score").alias("s")).groupBy("genre", "cluster").agg(F.max_by("label", F.struct("s", "label")).alias("top"))
    return placed.groupBy("genre", "cluster").agg(F.count("*").alias("members")).join(near, ["genre", "cluster"]).join(said, ["genre", "cluster"], "left")


@query()
def mood_mixtures(spark, sf_dir):
    """Items of a mood by score, the best two hundred of them by likeness to the mood's centre, and a mixture of those chosen by BIC."""
    df, out = vectors(spark, sf_dir), []
    i = items(spark, sf_dir).select("item_id", "tags")
    for mood in ("happy", "party"):
        mine = df.join(i.where(tags.has_at_least(F.col("tags"), mood, 0.7)), "item_id").select("item_id", "v")
        centre = mine.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()  # a row a dimension
        if centre:
            best = neighbours(mine, [r.x for r in centre], 200).where("dist <= 1.0").select("v").collect()  # two hundred
            w, m = mixture(np.array([r.v for r in best]))
            out += [(mood, k, float(x), float(np.linalg.norm(y))) for k, (x, y) in enumerate(zip(w, m, strict=True))]
    return spark.createDataFrame(out, "mood string, component int, weight double, norm double")
