"""What is written: staged merges, tables of vectors, text loads, reference data, playlists, and the pointer to the current snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .tables import upsert


def staged_upsert(base: DataFrame, staged: DataFrame, keys: list[str], other: list[str]) -> DataFrame:
    """Staged rows replace those with their key, and displace those of another key that hold their ``other`` key, which names one row too.

    Of staged rows that share either key the one with the largest values wins, so that the result has each key once.
    """
    rest = [F.desc(c) for c in staged.columns]
    once = staged.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*rest))).where("__r = 1").drop("__r")
    once = once.withColumn("__r", F.row_number().over(W.partitionBy(*other).orderBy(*rest))).where("__r = 1").drop("__r")
    clash = once.select(*other, *[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    left = base.join(clash, other, "left").where(F.col(f"__{keys[0]}").isNull() | same).select(*base.columns)
    return upsert(left, once.select(*base.columns), keys)


def copy_out(df: DataFrame, path: str) -> None:
    """Rows as text, a tab between fields; tabs, line feeds and backslashes escaped, null as \\N."""
    text = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), F.lit("\\N"))
    df.select(F.concat_ws("\t", *[text(c) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def copy_in(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that copy_out() wrote, cast to a schema; a line with another number of fields is left out."""
    fields = [(f.name, f.dataType) for f in schema.fields]
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == len(fields))
    mark = "￾"
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit(mark)), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))
    return parts.select(*[F.when(F.col("p")[k] != "\\N", plain(F.col("p")[k])).cast(kind).alias(name) for k, (name, kind) in enumerate(fields)])


def save_reference(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Small reference data, such as centres by mood, as one JSON document a line."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def replace_playlists(base: DataFrame, new: DataFrame, history: int = 3) -> DataFrame:
    """(server_id, name, round, place, item_id): a server's playlists of a round replace those of that round; of each server the last ``history`` rounds stay."""
    kept = base.join(new.select("server_id", "round").distinct(), ["server_id", "round"], "left_anti").unionByName(new)
    rounds = kept.select("server_id", "round").distinct().withColumn("r", F.row_number().over(W.partitionBy("server_id").orderBy(F.desc("round")))).where(F.col("r") <= history)
    return kept.join(rounds.drop("r"), ["server_id", "round"], "left_semi")


def publish(df: DataFrame, root: str, version: int) -> None:
    """A snapshot below ``root``, and then the pointer to it: readers see the old one or the new one, never half of one."""
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{root}/pointer")


def current(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """(version, rows) of the snapshot published last."""
    version = spark.read.schema("version long").parquet(f"{root}/pointer").agg(F.max("version")).first()[0]
    return version, spark.read.parquet(f"{root}/v={version}")
