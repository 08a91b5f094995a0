"""Key-set algebra and table comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_union(keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """Distinct keys of several tables."""
    u = tables[0].select(*keys)
    for t in tables[1:]:
        u = u.unionByName(t.select(*keys))
    return u.distinct()


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def table_differences(a: DataFrame, b: DataFrame, before: Column | None = None) -> DataFrame:
    """Row hashes whose multiplicity differs between two tables of the same columns.

    Column order and row order do not matter; an empty result with equal schemas means the tables are
    equal as multisets (up to the 64-bit hash).  One union and one aggregate, no join.
    """
    cols = sorted(a.columns)
    if cols != sorted(b.columns) or [a.schema[c].dataType for c in cols] != [b.schema[c].dataType for c in cols]:
        raise ValueError("tables differ in columns or types")
    if before is not None:
        a, b = a.where(before), b.where(before)

    def counted(df: DataFrame, sign: int) -> DataFrame:
        h = F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])
        return df.select(h.alias("row_hash"), F.lit(sign).alias("_s"))

    return (
        counted(a, 1)
        .unionByName(counted(b, -1))
        .groupBy("row_hash")
        .agg(F.count_if(F.col("_s") > 0).alias("n_left"), F.count_if(F.col("_s") < 0).alias("n_right"))
        .where(F.col("n_left") != F.col("n_right"))
    )


def table_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row counts and whether the multisets agree."""
    d = table_differences(a, b).agg(F.count(F.lit(1)).alias("different_hashes"))
    return (
        a.agg(F.count(F.lit(1)).alias("rows_left"))
        .join(b.agg(F.count(F.lit(1)).alias("rows_right")))
        .join(d)
        .withColumn("equal", F.col("different_hashes") == 0)
    )
