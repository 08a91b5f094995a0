"""Landing, incremental reading and the file shapes the feeds arrive in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions import timecols as tc

PROVENANCE = ("_source", "_fetched_at", "_request")


# ---------------------------------------------------------------- raw datasets

def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a dataset, columns united by name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def with_provenance(df: DataFrame, dataset: str, request: str, fetched_at: Column | None = None) -> DataFrame:
    return (
        df.withColumn("_source", F.lit(dataset))
        .withColumn("_fetched_at", fetched_at if fetched_at is not None else F.current_timestamp())
        .withColumn("_request", F.lit(request))
    )


def land(df: DataFrame, root: str, dataset: str, request: str, fetched_at: Column | None = None) -> bool:
    """Append a batch with its provenance; an empty batch writes nothing and returns False."""
    if df.isEmpty():
        return False
    with_provenance(df, dataset, request, fetched_at).write.mode("append").parquet(f"{root}/{dataset}")
    return True


def watermark(df: DataFrame, ts: str) -> DataFrame:
    """One row with the newest landed stamp (null for an empty dataset)."""
    return df.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("watermark"))


def plan_windows(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """Half-open month-aligned windows that cover [start, end) without overlap."""
    days = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return _windows(days, months)


def _windows(days: DataFrame, months: int) -> DataFrame:
    first = F.trunc("a", "MM")
    s = days.where(F.col("a") < F.col("b")).withColumn(
        "w", F.explode(F.sequence(first, F.date_sub("b", 1), F.expr(f"interval {months} month")))
    )
    return s.select(
        F.greatest("w", "a").alias("window_start"), F.least(F.add_months("w", months), F.col("b")).alias("window_end")
    ).where(F.col("window_start") < F.col("window_end"))


def windows_of(bounds: DataFrame, months: int) -> DataFrame:
    """As ``plan_windows`` for every (a, b) row of a table."""
    return _windows(bounds, months)


def incremental_slice(df: DataFrame, ts: str, overlap_days: int, mark: DataFrame) -> DataFrame:
    """Rows from the watermark minus the re-read overlap (everything when there is no watermark)."""
    m = F.broadcast(mark.select(F.col("watermark").alias("_wm")))  # one row
    return df.join(m).where(F.col("_wm").isNull() | (F.col(ts) >= F.col("_wm") - F.expr(f"interval {overlap_days} day"))).drop("_wm")


# ---------------------------------------------------------------- file shapes

def read_json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files of the form {"records": [...]} to rows; ``record`` is the DDL of one record."""
    body = spark.read.option("multiLine", "true").schema(f"records array<struct<{record}>>").json(path)
    return body.select(F.explode("records").alias("r")).select("r.*")


def read_json_files(spark: SparkSession, path: str, record: str) -> DataFrame:
    """As ``read_json_records`` for files of one such object per line, which split across tasks."""
    body = spark.read.schema(f"records array<struct<{record}>>").json(path)
    return body.select(F.explode("records").alias("r")).select("r.*")


def read_fx_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reference-rate CSV: typed, renamed, rows without an observation dropped."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.where(F.col("OBS_VALUE").isNotNull() & (F.trim("OBS_VALUE") != "")).select(
        F.col("TIME_PERIOD").cast("date").alias("date"),
        F.col("CURRENCY").alias("currency"),
        F.col("CURRENCY_DENOM").alias("denominator"),
        F.col("OBS_VALUE").cast("double").alias("rate"),
        F.col("OBS_STATUS").alias("status"),
    )


def read_dated_files(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Daily CSVs: the file date comes from the name, the write time from the file system.

    The given columns are read by position; further optional columns of a file are ignored.
    """
    schema = ", ".join(f"{n} {t}" for n, t in columns)
    names = [n for n, _ in columns]
    raw = spark.read.option("header", "true").option("enforceSchema", "true").schema(schema).csv(path)
    return raw.select(
        *names,
        F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})", 1), "yyyyMMdd").alias("file_date"),
        F.col("_metadata.file_modification_time").alias("file_written_at"),
    )


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV entries of zip archives as text columns plus entry name and entry write time.

    Spark lists and distributes the archives; each task only unpacks its own archives, streaming one
    entry at a time.
    """
    names = list(columns)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in names]
        + [T.StructField("entry", T.StringType()), T.StructField("entry_written_at", T.TimestampNTZType()), T.StructField("ordinal", T.LongType())]
    )

    def unpack(batches):
        import datetime as dt
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                z = zipfile.ZipFile(io.BytesIO(content))
                for info in sorted(z.infolist(), key=lambda i: i.filename):
                    start = 0
                    with z.open(info) as fh:
                        for chunk in pd.read_csv(fh, header=0, dtype=str, chunksize=100_000):
                            out = chunk.iloc[:, : len(names)].copy()
                            out.columns = names
                            out = out.astype(object).where(out.notna(), None)
                            out["entry"] = info.filename
                            out["entry_written_at"] = pd.Timestamp(dt.datetime(*info.date_time))
                            out["ordinal"] = range(start, start + len(out))
                            start += len(out)
                            yield out

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def explode_parallel_arrays(df: DataFrame, arrays: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Arrays of equal length (column -> output name) to one row per position."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for a, n in arrays.items()])
    return df.select(*keep, F.explode(zipped).alias("_z")).select(*keep, *[F.col("_z").getItem(n).alias(n) for n in arrays.values()])


def explode_nested_map(df: DataFrame, text: str, keep: Sequence[str], max_lead: int) -> DataFrame:
    """JSON text {lead: {point: value}} to rows, leads beyond a bound dropped."""
    m = F.from_json(F.col(text), "map<string, map<string, double>>")
    leads = df.select(*keep, F.explode(m).alias("lead", "_p")).withColumn("lead_hours", F.col("lead").cast("int"))
    return leads.where(F.col("lead_hours") <= max_lead).select(*keep, "lead_hours", F.explode("_p").alias("point", "value"))


# ---------------------------------------------------------------- choosing and bounding rows

def fill_missing_days(primary: DataFrame, backup: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Days of the backup only where the primary has none; ``origin`` says which one a row came from."""
    have = primary.select(*keys, day).distinct()
    add = backup.join(have, [*keys, day], "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(add.withColumn("origin", F.lit("backup")))


def slice_window(df: DataFrame, ts: str, lo: Column, hi: Column) -> DataFrame:
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def rounded_export(df: DataFrame, digits: int, sort: Sequence[str]) -> DataFrame:
    """Double columns rounded, rows sorted: the shape of a published extract."""
    cols = [F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns]
    return df.select(*cols).sort(*sort)


def export_rounded(df: DataFrame, path: str, digits: int, sort: Sequence[str]) -> None:
    rounded_export(df, digits, sort).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_monthly(df: DataFrame, ts: str, path: str) -> None:
    """Month partitions; only the months present in ``df`` are replaced."""
    (
        df.withColumn("ym", F.date_format(ts, "yyyyMM"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ym")
        .parquet(path)
    )


def read_months(spark: SparkSession, path: str, ts: str, lo: str, hi: str) -> DataFrame:
    """Rows with lo <= ts < hi; the month filter prunes partitions, the stamp filter reaches the files."""
    raw = spark.read.parquet(path).withColumn("ym", F.col("ym").cast("string"))
    return raw.where(
        (F.col("ym") >= F.date_format(tc.ntz(lo), "yyyyMM"))
        & (F.col("ym") <= F.date_format(tc.ntz(hi), "yyyyMM"))
        & (F.col(ts) >= tc.ntz(lo))
        & (F.col(ts) < tc.ntz(hi))
    ).drop("ym")


def read_before(df: DataFrame, ts: str, end: Column) -> DataFrame:
    """Hard upper bound on what a study may see, re-asserted on every row that leaves the scan."""
    ok = F.col(ts) < end
    guarded = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("row at or after the bound")).cast("boolean"))
    return df.where(ok).where(guarded)


def append_or_replace_last(log: DataFrame, entry: DataFrame, key: str, baseline: str, order: str) -> DataFrame:
    """Add an entry to a log; a re-run with the key of the last entry replaces it unless it is a baseline."""
    whole = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(baseline).alias("b"))
    last = log.agg(F.max(whole).alias("_l")).select(
        F.col("_l.o").alias("_lo"), F.col("_l.k").alias("_lk"), F.col("_l.b").alias("_lb")
    )
    new = entry.agg(F.max(key).alias("_nk"))
    one = F.broadcast(last.join(new))  # one row
    kept = (
        log.join(one)
        .where(~((F.col(order) == F.col("_lo")) & (F.col("_lk") == F.col("_nk")) & ~F.col("_lb")))
        .drop("_lo", "_lk", "_lb", "_nk")
    )
    return kept.unionByName(entry)


# ---------------------------------------------------------------- dimensions

# Fee components in money per MWh by year: charge, regulator fee, supply-only uplift.
FEES = {
    2020: (0.0862, 0.010, 0.007),
    2021: (0.0757, 0.015, 0.004),
    2022: (0.0853, 0.016, 0.003),
    2023: (0.1066, 0.017, 0.026),
    2024: (0.1333, 0.017, 0.017),
    2025: (0.1666, 0.020, 0.028),
    2026: (0.1919, 0.020, 0.030),
}


def fees_dim(spark: SparkSession, earlier: dict[int, tuple[float, float, float]] | None = None) -> DataFrame:
    """year, load_cost, supply_cost; earlier years can be laid over the table."""
    rates = {**FEES, **(earlier or {})}
    values = ", ".join(
        f"({y}, {round(a + b, 6)}D, {round(a + b + c, 6)}D)" for y, (a, b, c) in sorted(rates.items())
    )
    return spark.sql(f"select * from values {values} as t(year, load_cost, supply_cost)")


def points_dim(spark: SparkSession, points: dict[str, tuple[str, float, float, bool]]) -> DataFrame:
    """Weather point -> zone, position and whether it is the zone's primary point."""
    rows = [(n, z, lat, lon, p) for n, (z, lat, lon, p) in points.items()]
    return spark.createDataFrame(rows, "point string, zone string, lat double, lon double, primary boolean")
