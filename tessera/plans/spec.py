"""A declarative plan, as JSON, made into one DataFrame: primaries (search or similar), filters, order, caps, limit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import tags, text
from ..operators.similarity import neighbours, seed_vector
from ..sources.tables import items, vectors

RANGES = ("tempo", "price")


def normalise(spec: dict) -> dict:
    """Equal primaries once, contradictory exclusions dropped, unknown keys refused."""
    known = {"primaries", "filter", "order", "cap", "limit"}
    if extra := set(spec) - known:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    once = list({json.dumps(p, sort_keys=True): p for p in spec.get("primaries", [])}.values())
    f = dict(spec.get("filter", {}))
    f["exclude_authors"] = [a for a in f.get("exclude_authors", []) if a not in f.get("authors", [])]
    return {"primaries": once, "filter": f, "order": spec.get("order", "score"), "cap": spec.get("cap"), "limit": int(spec.get("limit", 100))}


def filtered(df: DataFrame, f: dict) -> DataFrame:
    for name in RANGES:
        low, high = (f.get(name) or [None, None])[:2]
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    if f.get("tags"):
        anyone = F.lit(False)
        for label, least in f["tags"].items():
            anyone |= tags.has_at_least(F.col("tags"), label, least)
        df = df.where(anyone)
    if f.get("authors"):
        df = df.where(F.col("author").isin(*f["authors"]))
    if f.get("exclude_authors"):
        df = df.where(~F.col("author").isin(*f["exclude_authors"]))
    return df


def build(spark: SparkSession, sf_dir: str, spec: dict | str) -> DataFrame:
    """(item_id, title, author, score, hits), best first. Several primaries are fused by rank; filters apply before their top-k."""
    spec = normalise(json.loads(spec) if isinstance(spec, str) else spec)
    base = filtered(items(spark, sf_dir), spec["filter"])
    found = None
    for p in spec["primaries"] or [{"kind": "all"}]:
        if p["kind"] == "similar":
            df = vectors(spark, sf_dir)
            pool = df.join(base.select("item_id"), "item_id", "left_semi").where(F.col("item_id") != p["item_id"])
            part = neighbours(pool, seed_vector(df, p["item_id"]), p.get("k", 100)).select("item_id", "dist")
        elif p["kind"] == "search":
            key = text.search_key(F.col("title"), F.col("author"), F.col("album"))
            hit = F.lit(True)
            for token in p["text"].lower().split():
                hit &= key.contains(token)
            part = base.where(hit).select("item_id", F.col("item_id").cast("double").alias("dist")).orderBy("dist").limit(p.get("k", 100))
        elif p["kind"] == "all":
            pool = base
            if spec["cap"]:  # an author's surplus would only push out what the cap leaves
                pool = base.withColumn("c", F.row_number().over(W.partitionBy("author").orderBy("item_id"))).where(F.col("c") <= spec["cap"])
            part = pool.select("item_id", F.lit(0.0).alias("dist")).orderBy("item_id").limit(p.get("k", spec["limit"]))
        else:
            raise ValueError(f"unknown primary: {p['kind']}")
        r = F.row_number().over(W.orderBy("dist", "item_id"))  # at most k rows
        part = part.withColumn("s", 1 - (r - 1) / float(p.get("k", 100)))
        found = part if found is None else found.unionByName(part)
    fused = found.groupBy("item_id").agg(F.round(F.sum("s"), 6).alias("score"), F.count("*").alias("hits")).join(base.select("item_id", "title", "author"), "item_id")
    if spec["cap"]:
        fused = fused.withColumn("c", F.row_number().over(W.partitionBy("author").orderBy(F.desc("hits"), F.desc("score"), "item_id"))).where(F.col("c") <= spec["cap"])
    return fused.orderBy(F.desc("hits"), F.desc("score"), "item_id").limit(spec["limit"]).select("item_id", "title", "author", "score", "hits")
