"""Choice of frames and observations, completeness, and frame quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.schemas import long, observations

#: Facets that one side of a grid join holds.
BLOCK_UNITS = 100_000


def hours_between(df: DataFrame, ts: str, start: int = 7, stop: int = 10, strict: bool = False) -> DataFrame:
    """Rows with start <= hour < stop, or start < hour < stop when strict."""
    h = F.hour(ts)
    return df.where(((h > start) if strict else (h >= start)) & (h < stop))


def name_like(df: DataFrame, name: str, glob: str) -> DataFrame:
    """Rows whose file name fits a glob with ``*`` and ``?``."""
    special = "\\.[]{}()+-^$|"
    pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob)
    return df.where(F.col(name).rlike(f"^{pattern}$"))


def every_nth(df: DataFrame, n: int, by: Column, name: str) -> DataFrame:
    """Every n-th row in name order, beginning with the first, within each day."""
    w = Window.partitionBy("_day").orderBy(name)
    return df.withColumn("_day", by).withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") % n == 0).drop("_k", "_day")


def exclude_frames(df: DataFrame, bad: DataFrame, frame: str) -> DataFrame:
    """Rows of frames that are not listed."""
    return df.join(bad.select(frame).distinct(), frame, "left_anti")


def select_features(df: DataFrame, keys: list[str], features: list[str] | None, chosen: list[str] | None = None) -> DataFrame:
    """Key columns and chosen features, all of them for None; unknown names are an error."""
    chosen = features if chosen is None else chosen
    unknown = [f for f in chosen if f not in features]
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    return df.select(*keys, *chosen)


def flatten(df: DataFrame, frame: str, cells: str, names: list[str], valid: str | None = None) -> DataFrame:
    """Rows ``frame, mirror_id, features`` from an array (facets) of arrays (features)."""
    rows = df.select(frame, *([valid] if valid else []), F.posexplode(cells).alias("mirror_id", "_v"))
    if valid:
        rows = rows.where(F.col(valid)[F.col("mirror_id")])
    return rows.select(frame, "mirror_id", *(F.col("_v")[i].alias(n) for i, n in enumerate(names)))


def observation_rows(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long form, without missing values."""
    return long(observations(df, features), keys, features).where("value is not null")


def completeness(obs: DataFrame, frames: DataFrame, units: DataFrame, frame: str, unit: str, feature: str) -> DataFrame:
    """Per frame: expected and present units, percent, and values that are missing though the unit is there.

    The expected grid is frames times facets; facets are the small side.
    """
    present = observations(obs, [feature]).groupBy(frame).agg(F.countDistinct(unit).alias("n_present"), F.count_if(F.col(feature).isNull()).alias("n_null"))
    n = units.select(unit).distinct().agg(F.count("*").alias("n_expected"))
    out = frames.select(frame).distinct().join(F.broadcast(n)).join(present, frame, "left")
    out = out.withColumn("n_present", F.coalesce("n_present", F.lit(0))).withColumn("n_null", F.coalesce("n_null", F.lit(0)))
    return out.withColumn("pct", 100.0 * F.col("n_present") / F.col("n_expected"))


def missing_cells(obs: DataFrame, frames: DataFrame, units: DataFrame, frame: str, unit: str) -> DataFrame:
    """The cells of the frame-facet grid that have no observation.

    The grid is the result's own size. Facets are counted first: up to ``BLOCK_UNITS``
    they are broadcast, beyond that frames meet them block by block in a shuffled join.
    """
    left, right = frames.select(frame).distinct(), units.select(unit).distinct()
    blocks = right.count() // BLOCK_UNITS + 1
    if blocks == 1:
        grid = left.crossJoin(F.broadcast(right))
    else:
        right = right.withColumn("_block", F.pmod(F.xxhash64(unit), F.lit(blocks)))
        grid = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "_block").drop("_block")
    return grid.join(obs.select(frame, unit), [frame, unit], "left_anti")


#: Selection rules for frames.
RULES = {
    "good": "mean_brightness > 100 and bright_saturated_frac < 0.025 and sharpness > 25",
    "morning": "mean_brightness > 100 and mean_brightness < 145 and sharpness > 25",
    "even": "lr_asymmetry < 10 and mean_brightness > 80 and sharpness > 20",
}


def good_frames(quality: DataFrame, rule: str = "good") -> DataFrame:
    """Frames that meet a named rule; a NULL measure meets none."""
    return quality.where(RULES[rule])


def classify_weather(metrics: DataFrame, min_sat: float = 35, max_overexp: float = 15, max_gray: float = 40, min_blue: float = 0.33) -> DataFrame:
    """``verdict`` GOOD or BAD, and the ``reasons`` joined as text."""
    shown = lambda c, digits: F.round(F.col(c) + 1e-9, digits)  # noqa: E731  halves are rounded up before they are shown
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("sat_mean") < min_sat, F.format_string("low saturation (%.1f)", shown("sat_mean", 1))),
        F.when(F.col("overexposed_pct") > max_overexp, F.format_string("overexposed (%.1f%%)", shown("overexposed_pct", 1))),
        F.when(F.col("gray_pct") > max_gray, F.format_string("gray sky (%.1f%%)", shown("gray_pct", 1))),
        F.when(F.col("blue_ratio") < min_blue, F.format_string("little blue (%.2f)", shown("blue_ratio", 2))),
    )
    return metrics.withColumn("reasons", reasons).withColumn("verdict", F.when(F.col("reasons") == "", "GOOD").otherwise("BAD"))
