"""Reading the given tables and writing intermediate ones where every executor sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.session import working_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once under the shared checkpoint folder and read back: lineage ends there, lost executors cost nothing."""
    path = working_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def lowest_hashes(keys: DataFrame, by: str, salts: int, key: str = "doc_id") -> DataFrame:
    """At most 1000 x `salts` rows for each value of `by`: those with the lowest hashes of `key`. Groups are salted and
    limited in every task before the shuffle, so no value of `by` meets in one task."""
    order = Window.partitionBy(by, "salt").orderBy("h", key)
    h = F.xxhash64(F.col(key), F.lit("sample"))
    ranked = keys.withColumn("h", h).withColumn("salt", F.pmod("h", F.lit(salts))).withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") <= 1000).drop("h", "salt", "r")


def unused(name: str, columns: list[str]) -> str:
    """The name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
