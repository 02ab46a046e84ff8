"""Media servers of several kinds behind one reader: each kind names its fields in its own way, all come out alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("provider_id", "title", "author", "album", "path", "seconds")
#: For each kind where a column stands in its records, as SQL over the record.
KINDS = {
    "plain": {"provider_id": "id", "title": "title", "author": "artist", "album": "album", "path": "path", "seconds": "duration"},
    "nested": {"provider_id": "Id", "title": "Name", "author": "Artists[0]", "album": "Album.Name", "path": "MediaSources[0].Path", "seconds": "RunTimeTicks / 10000000"},
    "tagged": {"provider_id": "key", "title": "tags['title']", "author": "coalesce(tags['albumartist'], tags['artist'])", "album": "tags['album']", "path": "concat(folder, '/', file)", "seconds": "ms / 1000"},
}
SCHEMAS = {
    "plain": "id string, title string, artist string, album string, path string, duration double",
    "nested": "Id string, Name string, Artists array<string>, Album struct<Name: string>, MediaSources array<struct<Path: string>>, RunTimeTicks bigint",
    "tagged": "key string, tags map<string,string>, folder string, file string, ms bigint",
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The records of a kind of server, a JSON document a line, as (provider_id, title, author, album, path, seconds). A record that cannot be read gives nulls."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of server: {kind}; there are {sorted(KINDS)}")
    return unified(spark.read.schema(SCHEMAS[kind]).json(path), kind)


def unified(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[F.expr(KINDS[kind][c]).cast("double" if c == "seconds" else "string").alias(c) for c in COLUMNS])
