"""Removal of cross-site boilerplate lines by the number of distinct sites that carry them.

Every distinct line (by 64-bit hash) has a HyperLogLog sketch of its sites; sketches merge in the aggregation, in every task
before the shuffle, so a line of a third of all rows costs one sketch per task. Lines whose estimate lies within the
sketch's error of the threshold are counted exactly. A line on `min_sites` sites or more is boilerplate: its first
occurrence stays (lowest doc_id, then text hash, then place), all others go.

DataFrame functions only.

Defined results: null and empty texts come back as they are; empty lines are never boilerplate; a null site counts as no
site; a null doc_id comes before all others; rows with the same doc_id and text are treated alike; a document that loses
all its visible text goes; other columns are kept, n_chars is renewed where it exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import tables

MIN_SITES = 5
LG_K = 12


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """One row per non-empty line: its hash, site, and place (doc_id, th, pos)."""
    lines = docs.select(F.col(site).alias("site"), "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where("line <> ''").select(F.xxhash64("line").alias("h"), "site", F.struct("doc_id", "th", "pos").alias("place"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, first): lines on `min_sites` sites or more, with the place of their first occurrence."""
    sketched = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.min("place").alias("first"))
    # A line on so many sites occurs as often; the rest needs no estimate.
    spread = sketched.where(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sites").alias("spread"))
    band = 1 + 4 * 1.04 / 2 ** (lg_k / 2) * min_sites
    spread = tables.stored(spread.where(F.col("spread") >= min_sites - band), "line-spread")
    near = spread.where(F.col("spread") <= min_sites + band)
    counted = lines.join(near.select("h"), "h", "left_semi").where("site is not null").groupBy("h", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= min_sites).select("h")
    sure = spread.where(F.col("spread") > min_sites + band)
    return sure.select("h", "first").unionByName(near.join(exact, "h").select("h", "first"))


def _cleaned(docs: DataFrame, min_sites: int, site: str) -> DataFrame:
    """(d, removed): the rows of docs as structs, with renewed text and n_chars, and how many lines each lost."""
    lines = occurrences(docs, site)
    common = boilerplate(lines, min_sites)
    gone = lines.join(common, "h").where(~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("place.doc_id", "place.th").agg(F.collect_set("place.pos").alias("gone")).select(F.struct("doc_id", "th").alias("key"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.struct("doc_id", F.xxhash64("text").alias("th")).alias("own"))
    rows = rows.join(gone, F.col("own.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("own.th") == F.col("key.th")), "left")
    parts = F.split("d.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i))
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n")))
    rows = rows.where(F.col("gone").isNull() | F.regexp_like("text", F.lit(r"\S")))
    changed = F.col("d").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withField("n_chars", F.when(F.col("gone").isNull(), F.col("d.n_chars")).otherwise(length))
    return rows.select(changed.alias("d"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs without boilerplate lines, all columns, and `lines_removed` (in place of a column of this name)."""
    docs = docs.drop("lines_removed")
    return _cleaned(docs, min_sites, site).select("d.*", F.col("removed").alias("lines_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(tables.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, with the columns they had."""
    return _cleaned(docs, MIN_SITES, "source").select("d.*")


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), ranked AS (
  SELECT l.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM l LEFT JOIN spread s ON l.line = s.line
), again AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS k
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(a.k, 0) = 0 THEN d.text ELSE a.text END AS text, d.lang, d.source,
       CASE WHEN coalesce(a.k, 0) = 0 THEN d.n_chars ELSE length(a.text) END AS n_chars,
       coalesce(a.k, 0)::INTEGER AS lines_removed
FROM documents d LEFT JOIN again a ON a.doc_id = d.doc_id
WHERE coalesce(a.k, 0) = 0 OR regexp_matches(a.text, '\\S')
"""
