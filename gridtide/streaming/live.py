"""Structured Streaming forms of the batch operators; each has a batch counterpart with equal results.

Watermarks need zoned timestamps, so UTC NTZ stamps are read as instants on the way in and turned back on
the way out; the session time zone must be UTC (``gridtide.session.SETTINGS``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions.exact import exact_avg
from gridtide.operators.dedup import latest_wins
from gridtide.operators.joins import null_safe
from gridtide.session import exists, is_folder, working_dir


def read_files(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def read_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return read_files(spark, path, schema, files_per_batch=files_per_batch)
    folder, _, name = path.rpartition("/")
    return read_files(spark, folder, schema, name, files_per_batch)


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_hourly(readings: DataFrame, keys: Sequence[str], ts: str, value: str, delay: str) -> DataFrame:
    """Hourly mean and reading count; in append mode an hour appears once the watermark has passed its
    end, so the hour in progress is never published."""
    w = _timed(readings, ts, delay).groupBy(F.window(ts, "1 hour"), *keys).agg(
        exact_avg(value).alias("mean_value"), F.count(F.lit(1)).alias("readings")
    )
    return w.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("hour_utc"), "mean_value", "readings")


def without_repeats(deliveries: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Repeated deliveries of one key inside the watermark dropped; state is cleared behind it."""
    return _timed(deliveries, ts, delay).dropDuplicatesWithinWatermark(list(keys)).withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def outage_sessions(readings: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of uninterrupted readings; the space between two sessions of a key is an outage."""
    s = _timed(readings, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("readings"))
    w = F.col("session_window")
    return s.select(
        *keys, w["start"].cast("timestamp_ntz").alias("session_start"), w["end"].cast("timestamp_ntz").alias("session_end"), "readings"
    )


def late_settlements(versions: DataFrame, key: str, ts: str, settled: str, live: str, max_days: int) -> DataFrame:
    """Running newest settled and newest live hour per key, their lag in days and whether it is late.

    Update mode: a key comes again with every change, so an alarm (``late``) that a later settlement ends is withdrawn; the
    newest row of a key counts.  A key that has nothing settled yet has no lag and is not late.
    """
    x = versions.groupBy(key).agg(
        F.max(F.when(F.col(settled), F.col(ts))).alias("settled_hi"), F.max(F.when(F.col(live), F.col(ts))).alias("live_hi")
    )
    lag = F.datediff("live_hi", "settled_hi")
    return x.withColumn("lag_days", lag).withColumn("late", F.coalesce(lag > max_days, F.lit(False)))


# ---------------------------------------------------------------- sinks

def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table and return it."""
    spark = stream.sparkSession
    path = working_dir(spark, name)
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_each_batch(stream: DataFrame, name: str, sink: Callable[[DataFrame, int, str], None], mode: str = "update") -> str:
    """Process everything available, handing each micro-batch and the table path to ``sink``."""
    spark = stream.sparkSession
    path = working_dir(spark, name)
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: sink(df, i, f"{path}/table"))
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return f"{path}/table"


def upsert_latest(keys: Sequence[str], order: Sequence[str], partition: str) -> Callable[[DataFrame, int, str], None]:
    """A foreachBatch sink that keeps the latest fetch of each key in a table of versioned partitions.

    A batch writes the partitions it touches, old and new rows merged, into a folder of its own, then their names, and then, last,
    a commit of its number.  Rows are dealt by partition before they are written (large ones over several tasks), so the number
    of files grows with the partitions and not with tasks times partitions.  Readers (``upserted``) see committed versions only, so a crash in between leaves the table as it was, and a
    replayed batch writes its own folder anew and reads only batches before it.
    """

    def sink(batch: DataFrame, i: int, path: str) -> None:
        spark = batch.sparkSession
        both, touched = batch, batch.select(partition).distinct()
        if exists(spark, f"{path}/commits"):
            both = upserted(spark, path, partition, before=i).select(*batch.columns).join(touched, partition, "left_semi").unionByName(batch)
        merged = latest_wins(both, keys, order).hint("rebalance", partition)
        merged.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/versions/batch={i}")
        touched.write.mode("overwrite").parquet(f"{path}/touched/batch={i}")
        spark.range(1).select(F.lit(i).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={i}")

    return sink


def upserted(spark: SparkSession, path: str, partition: str, before: int | None = None) -> DataFrame:
    """The rows of a versioned table: of every partition the newest committed version (of the batches ``before`` one)."""
    commits = spark.read.parquet(f"{path}/commits").select(F.col("batch").cast("int").alias("batch"))
    if before is not None:
        commits = commits.where(F.col("batch") < before)
    versions = spark.read.parquet(f"{path}/versions")
    touched = spark.read.parquet(f"{path}/touched").join(commits, "batch", "left_semi")
    newest = touched.groupBy(partition).agg(F.max("batch").alias("batch"))
    return null_safe(versions, newest, [partition, "batch"]).drop("batch")


def revision_log(keys: Sequence[str], night: str, value: str, order: Sequence[str], eps: float) -> Callable[[DataFrame, int, str], None]:
    """A foreachBatch sink that logs what each night's delivery changed against the night before it.

    A batch is reduced to the last value per (key, night) before anything else, so a key with very many deliveries stays
    small.  Values and events are kept per (key, night), each batch writing its own part, so a replayed batch replaces its
    output.  A batch writes anew the event of every night it brings and of the first night behind each of them, so a night
    that comes late is compared with its own predecessor and corrects its successor.  ``current_events`` reads the log.
    """
    cols = [*keys, night, value]

    def sink(batch: DataFrame, i: int, path: str) -> None:
        spark = batch.sparkSession
        new = latest_wins(batch, [*keys, night], order).select(*cols, F.lit(i).alias("batch"))
        every = new
        if exists(spark, f"{path}/values"):
            kept = spark.read.schema(new.schema).parquet(f"{path}/values").where(F.col("batch") < i)
            touched = new.select(*keys).distinct()
            every = latest_wins(kept.join(touched, list(keys), "left_semi").unionByName(new), [*keys, night], ["batch"])
        w = Window.partitionBy(*keys).orderBy(night)
        own = F.col("batch") == i
        seen = every.withColumn("before", F.lag(value).over(w)).withColumn("_hit", own | F.coalesce(F.lag(own).over(w), F.lit(False)))
        status = F.when(F.col("before").isNull(), "appeared").when(F.abs(F.col(value) - F.col("before")) > eps, "revised")
        events = seen.where("_hit").select(*keys, night, "before", F.col(value).alias("after"), status.alias("status"), F.lit(i).alias("batch"))
        for df, name in ((events, "events"), (new, "values")):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return sink


def current_events(events: DataFrame, keys: Sequence[str], night: str) -> DataFrame:
    """The newest word on each (key, night) of a revision log, without nights that changed nothing."""
    return latest_wins(events, [*keys, night], ["batch"]).where(F.col("status").isNotNull()).drop("batch")
