"""Text and path normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and the plain ones they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def match_key(c: Column) -> Column:
    """Lower case without spaces, hyphens, slashes and apostrophes."""
    return F.translate(F.lower(c), " -‐/'", "")


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def search_key(*cols: Column) -> Column:
    return unaccent(F.lower(F.concat_ws(" ", *cols)))


def clean_title(c: Column) -> Column:
    """Without bracketed remarks and what follows a dash at the end."""
    out = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+-\s.*$", ""), r"\s+", " "))


def path_key(c: Column) -> Column:
    out = F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file://", "")
    return F.lower(F.regexp_replace(F.translate(out, "\\", "/"), "/+", "/"))


def path_tail(c: Column, n: int = 3) -> Column:
    parts = F.filter(F.split(path_key(c), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), "/")


def folder(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def scrub(c: Column, limit: int) -> Column:
    """Without control characters, cut at a column's length."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, limit)


def year(c: Column, low: int = 1000, high: int = 2100) -> Column:
    y = F.regexp_extract(c, r"(?:^|\D)(\d{4})(?:\D|$)", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def ratio_of(c: Column, pattern: str) -> Column:
    """Share of the letters that the pattern matches."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(pattern)) / letters).otherwise(0.0)


def content_hash(*cols: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 16)


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
