"""Warehouse tables in the role of observations, vectors and file names.

Every analytic function takes frame, unit and feature names, so these tables
run through the library's own code. The SQL of each role stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwatch.functions.patches import dealt_rows, pixel_table

L_FEATURES = ["quantity", "price", "discount", "tax"]
L_LOWER = ["discount", "tax"]
E_FEATURES = ["avg_value", "max_value", "n"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = month of shipping, unit = supplier, features = means of line items."""
    cols = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.col("l_suppkey").alias("unit")).agg(*(F.round(F.avg(c) + 1e-10, 6).alias(n) for n, c in cols.items()))


OBS_L = """obs AS (SELECT strftime(l_shipdate, '%Y-%m') AS frame, l_suppkey AS unit, round(avg(l_quantity) + 1e-10, 6) AS quantity, round(avg(l_extendedprice) + 1e-10, 6) AS price,
    round(avg(l_discount) + 1e-10, 6) AS discount, round(avg(l_tax) + 1e-10, 6) AS tax FROM lineitem GROUP BY 1, 2)"""
#: The same in long form.
LONG_L = OBS_L + """, lng AS (SELECT frame, unit, 'quantity' AS feature, quantity AS value FROM obs UNION ALL SELECT frame, unit, 'price', price FROM obs
    UNION ALL SELECT frame, unit, 'discount', discount FROM obs UNION ALL SELECT frame, unit, 'tax', tax FROM obs)"""


def obs_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = day, unit = user, features = mean, largest and number of values; some cells are missing."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("frame"), F.col("user_id").alias("unit")).agg(F.round(F.avg("value") + 1e-10, 6).alias("avg_value"), F.max("value").alias("max_value"), F.count("*").cast("double").alias("n"))


OBS_E = """obs AS (SELECT strftime(ts, '%Y-%m-%d') AS frame, user_id AS unit, round(avg(value) + 1e-10, 6) AS avg_value, max(value) AS max_value, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray patches.

    Rows are dealt out by patch before they become pixels: a table may be one file with one row
    group, which one task reads, and what groups or orders by patch needs no other exchange.
    """
    return pixel_table(dealt_rows(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", 64), "vec_id", "embedding", 8)


PIXELS = """raw AS (SELECT vec_id AS patch, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings),
    px AS (SELECT patch, (k // 8)::INTEGER AS y, (k % 8)::INTEGER AS x, least(255, greatest(0, floor((e::DOUBLE + 0.5) * 255)))::INTEGER AS v FROM raw)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 colour patches: a pixel's channels are three elements a third of the array apart."""
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch"), "embedding", F.posexplode("embedding").alias("k", "e"))
    other = {c: level(F.col("embedding")[(F.col("k") + at) % 64]).alias(c) for c, at in (("g", 21), ("b", 42))}
    return rows.select("patch", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), level(F.col("e")).alias("r"), *other.values())


COLOURS = """raw AS (SELECT vec_id AS patch, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings), lv AS (SELECT patch, k, least(255, greatest(0, floor((e::DOUBLE + 0.5) * 255)))::INTEGER AS v FROM raw),
    rgb AS (SELECT a.patch, (a.k // 8)::INTEGER AS y, (a.k % 8)::INTEGER AS x, a.v AS r, g.v AS g, b.v AS b FROM lv a JOIN lv g ON g.patch = a.patch AND g.k = (a.k + 21) % 64 JOIN lv b ON b.patch = a.patch AND b.k = (a.k + 42) % 64),
    mm AS (SELECT *, greatest(r, g, b)::DOUBLE AS val, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d, round(0.0 + r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS v FROM rgb),
    tn AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN val = r THEN 60 * (g - b) / d WHEN val = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END::DOUBLE AS turn FROM mm),
    hs AS (SELECT *, round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2) % 180 AS h, round(CASE WHEN val > 0 THEN 255 * d / val ELSE 0 END) AS s FROM tn)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their 64 elements as columns v0 .. v63."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)))


def suspects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores and truth: length of labelled documents, and the toxic ones; frame = source."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("frame"), F.col("doc_id").alias("unit"), F.col("n_chars").cast("double").alias("score"))
    marks = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("unit"))
    return docs, docs.join(marks, "unit", "left_semi").select("frame", "unit")


SUSPECTS = """sc AS (SELECT source AS frame, doc_id AS unit, n_chars::DOUBLE AS score FROM documents),
    tr AS (SELECT frame, unit FROM sc WHERE unit IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
