"""What is told about single rows: predicates, normalised fields, feature vectors, ids. Each has its SQL beside it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tags, text, vec
from ..sources.tables import items, table, vectors
from .relational import ITEMS, PAIRS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Labels that are scored for every item; asked for as a genre or a mood, they are looked up among the scores.
DENSE = ("happy", "sad", "danceable", "party")
#: The ranges that tempo and energy are normalised from.
TEMPO_RANGE, ENERGY_RANGE = (40.0, 200.0), (0.30, 0.95)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$ITEMS", ITEMS).replace("$PAIRS", PAIRS)
        return f

    return add


# --- predicates ----------------------------------------------------------------------------------------------


def reroute(wanted: dict[str, list[str]], dense=DENSE) -> dict[str, list[str]]:
    """Labels asked for as genres or moods that are dense ones move to ``other``, each once, in the order asked."""
    out = {"other": list(wanted.get("other", []))}
    for kind in ("genres", "moods"):
        out[kind] = [x for x in wanted.get(kind, []) if x.lower() not in dense]
        out["other"] += [x.lower() for x in wanted.get(kind, []) if x.lower() in dense]
    return out | {"other": list(dict.fromkeys(out["other"]))}


@query("SELECT item_id, title FROM $ITEMS i WHERE album = 'SMALL' AND (item_id * 29 % 100 >= 50 OR tempo * 2 - 1 >= 50)")
def label_reroute(spark, sf_dir):
    """Genres SMALL and happy, mood party: the dense two are thresholds on scores, OR-ed; the rest names the album."""
    plan = reroute({"genres": ["SMALL", "Happy"], "moods": ["party"]})
    scored = F.lit(False)
    for label in plan["other"]:
        scored |= tags.has_at_least(F.col("tags"), label)
    return items(spark, sf_dir).where(F.col("album").isin(*plan["genres"]) & scored).select("item_id", "title")


def instrumental(v: Column) -> Column:
    """The vector that stands for no words: 1, then zeros."""
    return (F.size(v) > 1) & (v[0] == 1) & F.forall(F.slice(v, 2, 1 << 20), lambda x: x == 0)


@query("SELECT vec_id AS item_id FROM embeddings WHERE vec_id % 50 = 7")
def instrumental_vectors(spark, sf_dir):
    """Rows that hold the sentinel; every 50th vector is replaced by it first, and another 50th by a near miss."""
    zero = F.transform("v", lambda x, k: F.when(k == 0, 1.0).otherwise(0.0))
    miss = F.transform("v", lambda x, k: F.when((k == 0) | (k == 9), 1.0).otherwise(0.0))
    v = F.when(F.col("item_id") % 50 == 7, zero).when(F.col("item_id") % 50 == 8, miss).otherwise(F.col("v"))
    return vectors(spark, sf_dir).where(instrumental(v)).select("item_id")


def old_scheme(c: Column, scheme: int = 2) -> Column:
    """Ids of the form fp_<scheme><hex> whose scheme is an older one."""
    found = F.regexp_extract(c, "^fp_([1-9])[0-9a-f]+$", 1)
    return (found != "") & (found.cast("int") < scheme)


@query("SELECT item_id, id FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'fp_1' || substr(md5(item_id::VARCHAR), 1, 12) WHEN 1 THEN 'fp_2' || substr(md5(item_id::VARCHAR), 1, 12) WHEN 2 THEN 'fp_x' ELSE item_id::VARCHAR END AS id FROM $ITEMS i) x WHERE item_id % 4 = 0")
def old_scheme_ids(spark, sf_dir):
    k, h = F.col("item_id") % 4, F.substring(F.md5(F.col("item_id").cast("string")), 1, 12)
    name = F.when(k == 0, F.concat(F.lit("fp_1"), h)).when(k == 1, F.concat(F.lit("fp_2"), h)).when(k == 2, "fp_x").otherwise(F.col("item_id").cast("string"))
    return items(spark, sf_dir).select("item_id", name.alias("id")).where(old_scheme(F.col("id")))


def same_length(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """Both known, finite and above 0, and apart by the tolerance at most; an unknown length is the same as none."""
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return F.coalesce(known(a) & known(b) & (F.abs(a - b) <= tolerance), F.lit(False))


@query("SELECT a.l_orderkey AS task, a.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag <> 'R' AND b.l_returnflag <> 'R' AND a.l_quantity > 0 AND b.l_quantity > 0 AND abs(a.l_quantity - b.l_quantity) <= 1")
def same_length_lines(spark, sf_dir):
    """Neighbouring files whose lengths agree; those of one flag have none."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double")).alias("q"))
    b = x.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("q").alias("after"))
    return x.join(b, ["l_orderkey", "l_linenumber"]).where(same_length(F.col("q"), F.col("after"))).select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("line"))


@F.pandas_udf(T.DoubleType())
def compression_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes over zlib's bytes; 0 for an empty or null text."""
    for texts in batches:
        yield texts.map(lambda t: len(t.encode()) / len(zlib.compress(t.encode())) if t else 0.0).astype("float64")


@query()
def text_reject(spark, sf_dir):
    """Texts under 250 characters, that shrink more than 15 times, or that are Latin by 0.9 and more in a language that is not written so."""
    t = F.col("text")
    latin = text.ratio_of(t, "[A-Za-z]") >= 0.9
    cheap = F.when(t.isNull() | (F.length(t) < 250), "short").when(F.col("lang").isin("ja", "zh", "ko", "ru") & latin, "script")
    d = table(spark, sf_dir, "documents").select("doc_id", cheap.alias("why"), F.round(compression_ratio(t), 6).alias("ratio"))
    return d.select("doc_id", F.coalesce("why", F.when(F.col("ratio") > 15, "repeats")).alias("why"), "ratio")


# --- fields --------------------------------------------------------------------------------------------------


@query("SELECT item_id, coalesce(title, 'unknown') AS title, CASE WHEN item_id % 9 = 0 THEN 'unknown' ELSE author END AS artist, first(label ORDER BY score DESC, label) FILTER (score > 0) AS top_mood, round(max(score), 6) AS top_score FROM $PAIRS p GROUP BY item_id, title, author")
def serialise(spark, sf_dir):
    """Fields picked and renamed, with defaults, and the best label of the packed scores; of equals the first by name."""
    author = F.when(F.col("item_id") % 9 != 0, F.col("author"))
    best = F.array_min(F.transform(F.map_entries(tags.parse(F.col("tags"))), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("l"))))
    i = items(spark, sf_dir).select("item_id", F.coalesce("title", F.lit("unknown")).alias("title"), F.coalesce(author, F.lit("unknown")).alias("artist"), best.alias("b"))
    return i.select("item_id", "title", "artist", F.when(F.col("b.s") < 0, F.col("b.l")).alias("top_mood"), F.round(-F.col("b.s"), 6).alias("top_score"))


def has_word(c: Column, word: str) -> Column:
    """Whether a word stands whole in a text, whatever its case; signs in the word stand for themselves."""
    return F.regexp_like(c, F.lit("(?i)(^|[^\\p{L}\\p{N}])\\Q" + word.replace("\\E", "") + "\\E([^\\p{L}\\p{N}]|$)"))


@query("SELECT item_id, title FROM $ITEMS i WHERE regexp_matches(title, '(?i)(^|[^a-z0-9])ring([^a-z0-9]|$)')")
def word_match(spark, sf_dir):
    return items(spark, sf_dir).where(has_word(F.col("title"), "RING")).select("item_id", "title")


NOISE = "remaster(ed)?|live|version|edit|mono|stereo|deluxe|bonus"


def strip_noise(c: Column) -> Column:
    """Without brackets that hold a word of noise, a leading article, and white space beyond one blank."""
    bare = F.regexp_replace(c, rf"(?i)[(\[][^)\]]*\b({NOISE})\b[^)\]]*[)\]]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"\s+", " "), "^ ?the ", ""))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN title WHEN 1 THEN title || ' (part 2)' ELSE title END AS title FROM $ITEMS i")
def metadata_noise(spark, sf_dir):
    k = F.col("item_id") % 3
    said = F.when(k == 0, F.concat(F.lit("The  "), "title", F.lit(" (2011 Remastered)"))).when(k == 1, F.concat("title", F.lit(" (Part 2) [Live at home]"))).otherwise(F.upper("title"))
    return items(spark, sf_dir).select("item_id", strip_noise(said).alias("title"))


def disc_track(path: Column) -> Column:
    """struct<disc, track> from a file's name: 1-02, 102 or 02 before the title; the disc is 1 where only a track is named."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    disc, track = F.regexp_extract(name, r"^(\d{1,2})[-_.](\d{1,3})(?!\d)", 1), F.regexp_extract(name, r"^(\d{1,2})[-_.](\d{1,3})(?!\d)", 2)
    three, two = F.regexp_extract(name, r"^(\d{3})(?!\d)", 1), F.regexp_extract(name, r"^(\d{1,2})(?![\d])", 1)
    pair = lambda d, t: F.struct(d.try_cast("int").alias("disc"), t.try_cast("int").alias("track"))
    return F.when(disc != "", pair(disc, track)).when(three != "", pair(F.substring(three, 1, 1), F.substring(three, 2, 2))).when(two != "", pair(F.lit("1"), two))


@query("SELECT item_id, '/music/' || lower(author) AS folder, CASE item_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 1 ELSE tempo % 3 + 1 END::INT AS disc, CASE item_id % 4 WHEN 3 THEN NULL ELSE item_id % 30 + 1 END::INT AS track FROM $ITEMS i")
def path_parts(spark, sf_dir):
    """A file's folder, disc and track, from paths written in four ways."""
    k, n = F.col("item_id") % 4, F.lpad((F.col("item_id") % 30 + 1).cast("string"), 2, "0")
    disc = (F.col("tempo") % 3 + 1).cast("string")
    name = F.when(k == 0, F.concat(disc, F.lit("-"), n, F.lit(" x.mp3"))).when(k == 1, F.concat(disc, n, F.lit(" x.mp3"))).when(k == 2, F.concat(n, F.lit(". x.mp3"))).otherwise("x.mp3")
    path = F.concat(F.lit("file:///Music//"), "author", F.lit("/"), name)
    i = items(spark, sf_dir).select("item_id", text.path_key(path).alias("p")).select("item_id", text.folder(F.col("p")).alias("folder"), disc_track(F.col("p")).alias("d"))
    return i.select("item_id", "folder", "d.disc", "d.track")


def normal(c: Column, low: float, high: float) -> Column:
    """0 to 1 over a range, cut at its ends; 0 for null."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c.cast("double") - low) / (high - low))), F.lit(0.0))


def score_vector(tempo: Column, energy: Column, packed: Column, moods=("rock", "jazz"), dense=DENSE) -> Column:
    """Tempo and energy normalised, then the score of each mood and each dense label."""
    return F.array(normal(tempo, *TEMPO_RANGE), normal(energy, *ENERGY_RANGE), *[tags.score(packed, x) for x in (*moods, *dense)])


@query("""WITH v AS (SELECT item_id, [least(1.0, greatest(0.0, (tempo * 5 - 40) / 160.0::DOUBLE)), least(1.0, greatest(0.0, (price % 100 / 100.0::DOUBLE - 0.30) / (0.95 - 0.30)::DOUBLE)), 0.0, 0.0, (tempo * 2 - 1) / 100.0::DOUBLE, item_id * 7 % 100 / 100.0::DOUBLE, item_id * 13 % 100 / 100.0::DOUBLE, item_id * 29 % 100 / 100.0::DOUBLE] AS v FROM $ITEMS i)
SELECT item_id, unnest(range(8))::INT AS pos, round(unnest(v), 6) AS x FROM v""")
def feature_vector(spark, sf_dir):
    v = score_vector(F.col("tempo") * 5, F.col("price") % 100 / 100.0, F.col("tags"))
    return items(spark, sf_dir).select("item_id", F.posexplode(v).alias("pos", "x")).select("item_id", "pos", F.round("x", 6).alias("x"))


@query("SELECT item_id, CASE WHEN greatest(party, danceable) <= 0 THEN '__other__' WHEN party >= danceable THEN 'party' ELSE 'danceable' END AS genre FROM (SELECT item_id, item_id * 29 % 100 AS party, item_id * 13 % 100 AS danceable FROM $ITEMS i) x")
def primary_genre(spark, sf_dir):
    """The vocabulary's best label, the first of equals, or __other__."""
    best = tags.first_top(F.col("tags"), ["rock", "party", "danceable"])
    return items(spark, sf_dir).select("item_id", F.coalesce(best, F.lit("__other__")).alias("genre"))


#: Phrases and what they stand for.
PHRASES = {"1-urgent": "fast", "2-high": "fast", "3-medium": "medium", "urgent": "fast", "high": "fast", "medium": "medium", "low": "slow", "5-low": "slow"}


def canonical_phrase(c: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """The vocabulary's word for a phrase, null if there is none; case and outer blanks don't matter."""
    known = F.create_map([F.lit(x) for kv in phrases.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(c)))


@query("SELECT o_orderkey AS task, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'slow' END AS tempo FROM orders")
def vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), canonical_phrase(F.concat(F.lit(" "), "o_orderpriority")).alias("tempo"))


@query("SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS at FROM events")
def local_times(spark, sf_dir):
    """A moment as a zone's clocks show it; the table's month lies in winter time."""
    moment = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Berlin")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm").alias("at"))


def rating(c: Column) -> Column:
    """A whole number of 0 to 5; null for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(5), F.greatest(F.lit(0), F.floor(x + 0.5).cast("int"))))


@query("SELECT l_orderkey AS task, l_linenumber AS line, least(5, greatest(0, floor(l_quantity / 4.0 - 2 + 0.5)))::INT AS rating FROM lineitem")
def ratings(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("line"), rating((F.col("l_quantity") / 4.0 - 2).cast("string")).alias("rating"))


@query("SELECT item_id, round((list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q)) + 1) / 2, 6) AS score FROM (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings) t, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3) z")
def label_similarity(spark, sf_dir):
    """(cosine + 1) / 2 to a label's vector."""
    df = vectors(spark, sf_dir)
    label = df.where("item_id = 3").select(F.col("v").alias("q"))
    return df.crossJoin(F.broadcast(label)).select("item_id", F.round((vec.cosine(F.col("v"), F.col("q")) + 1) / 2, 6).alias("score"))


def preference(c: Column, low: float, high: float, reach: float) -> Column:
    """1 within a range, falling to 0 at ``reach`` beyond either end; 0.5 if unknown."""
    beyond = F.greatest(low - c, c - high, F.lit(0.0))
    return F.when(c.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - beyond / reach))


@query("SELECT item_id, round(CASE WHEN item_id % 8 = 0 THEN 0.5 ELSE greatest(0.0, 1 - greatest(20 - tempo, tempo - 30, 0.0) / 15.0::DOUBLE) END, 6) AS fit FROM $ITEMS i")
def preference_scores(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", F.round(preference(F.when(F.col("item_id") % 8 != 0, F.col("tempo").cast("double")), 20.0, 30.0, 15.0), 6).alias("fit"))


def minted(df: DataFrame, scheme: int = 2) -> DataFrame:
    """(item_id, canonical_id): the signs about the mean in hex; of equal signatures the later ids get a step; what has no vector a hash of its id."""
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    sign = F.array_join(F.transform("v", lambda x: F.when(x > F.col("m"), "1").otherwise("0")), "")
    sig = F.lpad(F.lower(F.conv(sign, 2, 16)), 16, "0")
    named = df.withColumn("m", mean).select("item_id", F.coalesce(F.concat(F.lit(f"fp_{scheme}"), sig), F.concat(F.lit("fp_x"), F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 16))).alias("base"))
    step = F.row_number().over(W.partitionBy("base").orderBy("item_id"))
    return named.withColumn("r", step).select("item_id", F.concat("base", F.when(F.col("r") > 1, F.concat(F.lit("_"), F.col("r").cast("string"))).otherwise("")).alias("canonical_id"))


@query("""WITH v AS (SELECT vec_id AS item_id, CASE WHEN vec_id % 40 = 1 THEN NULL WHEN vec_id % 40 IN (2, 3) THEN (SELECT embedding FROM embeddings WHERE vec_id = 2)::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings),
b AS (SELECT item_id, CASE WHEN v IS NULL THEN 'fp_x' || substr(sha256(item_id::VARCHAR), 1, 16) ELSE 'fp_2' || array_to_string([substr('0123456789abcdef', (8 * (v[4 * i + 1] > list_avg(v))::INT + 4 * (v[4 * i + 2] > list_avg(v))::INT + 2 * (v[4 * i + 3] > list_avg(v))::INT + (v[4 * i + 4] > list_avg(v))::INT + 1)::BIGINT, 1) for i in range(16)], '') END AS base FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY item_id) AS r FROM b)
SELECT item_id, base || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS canonical_id FROM r""")
def canonical_ids(spark, sf_dir):
    """Minted ids; some vectors are missing, some equal."""
    df = vectors(spark, sf_dir)
    two = df.where("item_id = 2").select(F.col("v").alias("two"))
    k = F.col("item_id") % 40
    return minted(df.crossJoin(F.broadcast(two)).select("item_id", F.when(k == 1, F.lit(None)).when(k.isin(2, 3), F.col("two")).otherwise(F.col("v")).alias("v")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'x' || event_id AS tag, event_type AS kind FROM events WHERE user_id < 50")
def json_edit(spark, sf_dir):
    """Keys set in a document: what was there stays, equal keys are replaced."""
    e = table(spark, sf_dir, "events").where("user_id < 50")
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("tag"), F.concat(F.lit("x"), F.col("event_id").cast("string")), F.lit("kind"), F.col("event_type"))
    doc = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new))
    j = e.select("event_id", doc.alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.tag").alias("tag"), F.get_json_object("j", "$.kind").alias("kind"))


# --- aggregates over fields ----------------------------------------------------------------------------------


@query("SELECT min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, round(100.0::DOUBLE * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 1) AS urgent FROM orders")
def year_range(spark, sf_dir):
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.round(100.0 * F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*"), 1).alias("urgent"))


@query("SELECT label, round(sum(score), 6) AS weight FROM $PAIRS p WHERE item_id IN (1, 5, 9, 14) GROUP BY label ORDER BY weight DESC, label LIMIT 3")
def seed_weights(spark, sf_dir):
    """The three labels that some seeds add up to most."""
    seeds = items(spark, sf_dir).where(F.col("item_id").isin(1, 5, 9, 14)).select(F.explode(tags.parse(F.col("tags"))).alias("label", "score"))
    return seeds.groupBy("label").agg(F.round(F.sum("score"), 6).alias("weight")).orderBy(F.desc("weight"), "label").limit(3)


@query("SELECT doc_id, md5(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS folded FROM documents")
def unaccented(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.unaccent(F.lower(F.coalesce("text", F.lit(""))))).alias("folded"))


@query("SELECT author, album, count(*) AS n FROM $ITEMS i GROUP BY ROLLUP (author, album)")
def rollup_counts(spark, sf_dir):
    return items(spark, sf_dir).rollup("author", "album").agg(F.count("*").alias("n"))


# --- user-defined aggregates and table functions -------------------------------------------------------------


def register(spark) -> None:
    """The engine's own functions for SQL: unaccent, vector_mean and the table function tags."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="label string, score double")
    class Tags:
        def eval(self, packed: str):
            seen = {}
            for part in (packed or "").split(","):
                name, _, value = part.partition(":")
                try:
                    if name.strip():
                        seen[name.strip()] = float(value)
                except ValueError:
                    pass
            yield from seen.items()

    spark.udtf.register("tags", Tags)
    spark.udf.register("vector_mean", vector_mean)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def vector_mean(v: pd.Series) -> list:
    """The mean vector of a group; one of another size than the first is left out."""
    import numpy as np

    held = [np.asarray(x, float) for x in v if x is not None]
    held = [x for x in held if len(x) == len(held[0])]
    return list(np.mean(held, axis=0)) if held else None


@query("SELECT genre, pos, round(avg(x), 6) AS x FROM (SELECT label AS genre, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings WHERE vec_id % 2 = 0) t GROUP BY 1, 2")
def mean_by_udaf(spark, sf_dir):
    """The user-defined aggregate, for small groups; centroids() has the form that adds up before the shuffle."""
    df = vectors(spark, sf_dir).where("item_id % 2 = 0").groupBy("genre").agg(vector_mean(F.col("v")).alias("m"))
    return df.select("genre", F.posexplode("m").alias("pos", "x")).select("genre", "pos", F.round("x", 6).alias("x"))


@query("SELECT label, count(*) AS n FROM $PAIRS p WHERE score >= 0.9 GROUP BY 1")
def tags_by_udtf(spark, sf_dir):
    register(spark)
    items(spark, sf_dir).createOrReplaceTempView("tagged_items")
    return spark.sql("SELECT t.label, count(*) AS n FROM tagged_items, LATERAL tags(tagged_items.tags) t WHERE t.score >= 0.9 GROUP BY t.label")
