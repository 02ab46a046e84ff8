"""Tables and the views of the catalogue that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(key, size):
    """Label scores packed as label:score,label:score."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = (("happy", size * 2 - 1), ("sad", key * 7 % 100), ("danceable", key * 13 % 100), ("party", key * 29 % 100))
    return F.concat_ws(",", *[F.concat(F.lit(f"{n}:0."), two(c)) for n, c in parts])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: id, title, author, album, tempo, energy, and packed label scores."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("album"),
        F.col("p_size").alias("tempo"), F.col("p_retailprice").alias("price"), packed(F.col("p_partkey"), F.col("p_size")).alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item id, vector as doubles, genre."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("genre"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which server holds which item under which id of its own."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("server_id"), F.col("l_partkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("provider_id"))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with their key; a null in a ``keep_if_null`` column leaves what was there."""
    rest = [c for c in base.columns if c not in keys]
    b, d = base.withColumn("__b", F.lit(True)), delta.withColumn("__d", F.lit(True))
    joined = b.alias("b").join(d.alias("d"), keys, "full_outer")
    pick = lambda c: F.when(F.col("__d"), F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")) if c in keep_if_null else F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return joined.select(*keys, *[pick(c) for c in rest])


def replace_partition(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The partitions that ``delta`` has replace those of ``base``."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def merge_snapshot(base: DataFrame, delta: DataFrame, column: str) -> DataFrame:
    """One row with a map: keys of ``delta`` win."""
    a, b = F.max(F.when(F.col("__o") == 0, F.to_json(column))), F.max(F.when(F.col("__o") == 1, F.to_json(column)))
    both = base.withColumn("__o", F.lit(0)).unionByName(delta.withColumn("__o", F.lit(1))).agg(a.alias("a"), b.alias("b"))
    kind = "map<string,string>"
    old, new = F.coalesce(F.from_json("a", kind), F.expr(f"cast(map() as {kind})")), F.coalesce(F.from_json("b", kind), F.expr(f"cast(map() as {kind})"))
    return both.select(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new).alias(column))
