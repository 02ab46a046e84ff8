"""Packed label scores: label:score,label:score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import let


def parse(packed: Column) -> Column:
    """map<string,double>; pairs without a numeric score and empty labels are left out, the last of equal labels wins."""
    pairs = F.transform(F.split(F.coalesce(packed, F.lit("")), ","), lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("double").alias("v")))
    good = F.filter(pairs, lambda x: (x["k"] != "") & x["v"].isNotNull())
    last = lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda y: y["k"] == x["k"]))
    return let(good, lambda g: F.map_from_entries(last(g)))


def score(packed: Column, label: str) -> Column:
    return F.coalesce(F.try_element_at(parse(packed), F.lit(label)), F.lit(0.0))


def has_at_least(packed: Column, label: str, threshold: float = 0.5) -> Column:
    return score(packed, label) >= threshold


def top(packed: Column) -> Column:
    """The label with the highest score, null for a tie or none above 0."""
    first = lambda at, best: F.when((F.size(at) == 1) & (best > 0), at[0]["key"])
    of = lambda m: let(F.array_max(F.transform(m, lambda e: e["value"])), lambda best: let(F.filter(m, lambda e: e["value"] == best), lambda at: first(at, best)))
    return let(F.map_entries(parse(packed)), of)


def first_top(packed: Column, vocabulary: list[str]) -> Column:
    """The label of the vocabulary with the highest score, the first of equals; null if none is above 0."""
    scored = lambda m: F.array(*[F.struct(F.coalesce(F.try_element_at(m, F.lit(x)), F.lit(0.0)).alias("s"), F.lit(-k).alias("o"), F.lit(x).alias("l")) for k, x in enumerate(vocabulary)])
    return let(parse(packed), lambda m: let(F.array_max(scored(m)), lambda best: F.when(best["s"] > 0, best["l"])))


def gap(a: Column, b: Column, labels: list[str]) -> Column:
    """Mean absolute difference over some labels."""
    at = lambda m, x: F.coalesce(F.try_element_at(m, F.lit(x)), F.lit(0.0))
    return let(parse(a), lambda pa: let(parse(b), lambda pb: sum((F.abs(at(pa, x) - at(pb, x)) for x in labels), F.lit(0.0)) / len(labels)))
