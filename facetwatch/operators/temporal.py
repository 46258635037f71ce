"""Ranking within frames and its history over time.

Everything about a frame is a window over the frame; everything about a
facet's history is one shuffle by facet. Frames are numbered in time order
from the small table of frames; the last rows of a history are taken by their
number from the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.lineage import cut
from facetwatch.operators.score import composite_of, frame_z
from facetwatch.schemas import COMPOSITE_FEATURES, LOWER_IS_BETTER, observations


def composite_score(obs: DataFrame, frame: str, features: list[str] = COMPOSITE_FEATURES, lower_is_better: list[str] = LOWER_IS_BETTER) -> DataFrame:
    """``obs`` with ``composite``: mean signed robust z in the frame.

    A feature without spread (MAD up to 1e-10) counts as 0, one with fewer than
    two values in the frame is left out.
    """
    z = frame_z(obs, frame, features, least=1e-10)
    return z.withColumn("composite", composite_of(z, features, lower_is_better)).drop(*(f"z_{f}" for f in features))


def mean_rank(order: Column | str, frame: list[str], value: str) -> Column:
    """Rank with ties averaged, cut to an integer."""
    first = F.rank().over(Window.partitionBy(*frame).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*frame, value))
    return F.floor(first + (ties - 1) / 2).cast("int")


def rank_units(scored: DataFrame, frame: str, score: str = "composite") -> DataFrame:
    """``rank`` in the frame, best is 1, ties get the cut average; NULL scores get no rank."""
    return scored.withColumn("rank", F.when(F.col(score).isNotNull(), mean_rank(F.desc_nulls_last(score), [frame], score)))


def composite_z(scored: DataFrame, frame: str, score: str = "composite") -> DataFrame:
    """``z``: robust z of the composite in its frame."""
    return frame_z(scored, frame, [score], least=1e-10).withColumnRenamed(f"z_{score}", "z")


def frame_rank(obs: DataFrame, frame: str, unit: str, features: list[str] = COMPOSITE_FEATURES, lower_is_better: list[str] = LOWER_IS_BETTER, digits: int | None = None) -> DataFrame:
    """``frame, unit, composite, rank, z``; one shuffle by frame. ``digits`` rounds before ranking."""
    out = composite_score(obs, frame, features, lower_is_better)
    if digits is not None:
        out = out.withColumn("composite", F.round("composite", digits))
    return composite_z(rank_units(out, frame), frame).select(frame, unit, "composite", "rank", "z")


def history(ranks: DataFrame, frame: str, unit: str, order: list[str] | None = None) -> DataFrame:
    """``frame_idx`` from 1 in time order, and ``from_end``, for each unit."""
    by = order or [frame]
    up = Window.partitionBy(unit).orderBy(*by)
    down = Window.partitionBy(unit).orderBy(*(F.desc(c) for c in by))
    return ranks.where("rank is not null").withColumn("frame_idx", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down))


def baseline_frames(n_frames: Column | int, share: float = 0.3, least: int = 10) -> Column:
    """Number of first frames that make the rank baseline."""
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    return F.least(n, F.greatest(F.lit(least), F.floor(n * share))).cast("int")


def with_counts(hist: DataFrame, unit: str, frame: str = "frame", order: list[str] | None = None, share: float = 0.3, least: int = 10) -> DataFrame:
    """Adds ``n_frames`` of the unit, and by the archive's frames ``n_base`` and ``recent``.

    The baseline is the first ``n_base`` frames of the archive, the same for all
    units; ranks in later frames are recent. Its last frame is found over the small
    table of different frames, whose numbering is one ordered partition, and goes to
    all rows as one row.
    """
    by = order or [frame]
    hist = cut(hist)  # the ranks are made once; frames, counts and signals all read them
    numbered = hist.select(*by).distinct().withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
    n = numbered.agg(F.count("*").alias("_n")).withColumn("n_base", baseline_frames(F.col("_n"), share, least))
    last = numbered.join(F.broadcast(n), F.col("_no") == F.col("n_base")).select("n_base", F.struct(*by).alias("_last"))
    out = hist.join(F.broadcast(last)).withColumn("recent", F.struct(*by) > F.col("_last")).drop("_last")
    return out.withColumn("n_frames", F.count("*").over(Window.partitionBy(unit)))


def _recent(hist: DataFrame) -> Column:
    """Ranks after the baseline; all ranks of a history without one."""
    return F.col("recent") if "recent" in hist.columns else F.lit(True)


def rank_baseline(hist: DataFrame, unit: str) -> DataFrame:
    """Median and population deviation (at least 5) of a unit's ranks in the archive's first frames."""
    return hist.where("not recent").groupBy(unit).agg(F.median("rank").alias("base_rank"), F.greatest(F.stddev_pop("rank"), F.lit(5.0)).alias("base_std"), F.max("n_base").alias("n_base"), F.max("n_frames").alias("n_frames"))


def unit_signals(hist: DataFrame, unit: str, n_units: int | Column | None = None, window: int = 5, share: float = 0.9) -> DataFrame:
    """One row per unit with at least two ranks after the baseline, out of one shuffle by unit.

    ``base_rank, base_std, recent_rank, drop, thin``: median of the last ``window``
    ranks after the baseline against it, in deviations; ``thin`` where there are
    fewer. ``n, slope``: ranks in that window, and their least-squares slope, NULL
    where the window is not full. ``longest_run, n_recent, pct_bad``: runs in the
    worst tenth among ranks after the baseline, and the part of them spent there.
    """
    rows = hist.withColumn("_new", _recent(hist)).withColumn("_last", F.col("_new") & (F.col("from_end") <= window) if "from_end" in hist.columns else F.lit(False))
    n = F.lit(n_units) if isinstance(n_units, int) else F.lit(None) if n_units is None else n_units
    rows = rows.withColumn("_bad", F.coalesce(F.col("_new") & (F.col("rank") > share * n), F.lit(False)).cast("int"))
    by = Window.partitionBy(unit).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    # A run is what stands between two good ranks.
    rows = rows.withColumn("_run", F.sum(1 - F.col("_bad")).over(by))
    rows = rows.withColumn("_len", F.sum("_bad").over(Window.partitionBy(unit, "_run")))
    rank, idx = F.col("rank").cast("double"), F.col("frame_idx").cast("double")
    only = lambda c, x: F.when(F.col(c), x)
    out = rows.groupBy(unit).agg(
        F.median(F.when(~F.col("_new"), rank)).alias("base_rank"), F.greatest(F.stddev_pop(F.when(~F.col("_new"), rank)), F.lit(5.0)).alias("base_std"), F.median(only("_last", rank)).alias("recent_rank"),
        F.count_if("_new").alias("n_recent"), F.count_if("_last").alias("n"), F.regr_slope(only("_last", rank), only("_last", idx)).alias("slope"),
        F.max("_len").alias("longest_run"), F.try_divide(100.0 * F.sum("_bad"), F.count_if("_new")).alias("pct_bad"),
    )
    out = out.withColumn("drop", (F.col("recent_rank") - F.col("base_rank")) / F.when(F.col("base_rank").isNotNull(), F.col("base_std")))
    out = out.withColumn("thin", F.col("n_recent") < window).withColumn("slope", F.when(F.col("n") >= window, F.col("slope")))
    return out.where("n_recent >= 2")


def rank_drop(hist: DataFrame, unit: str, window: int = 5, threshold: float = 3.0, warn: bool = False) -> DataFrame:
    """Units whose median of the last ranks after the baseline fell behind by more than ``threshold`` deviations.

    Units with fewer than two ranks after the baseline, or none in it, are skipped;
    ``thin`` marks those with fewer than ``window``. ``warn`` returns all units.
    """
    both = unit_signals(hist, unit, window=window).where("drop is not null").select(unit, "base_rank", "base_std", "recent_rank", "drop", "thin")
    return both if warn else both.where(F.col("drop") > threshold)


def rank_trend(hist: DataFrame, unit: str, window: int = 5, threshold: float | None = 2.0) -> DataFrame:
    """Least-squares slope of the last ranks after the baseline; only units with a full window there, above ``threshold``."""
    out = unit_signals(hist, unit, window=window).where("slope is not null").select(unit, "n", "slope")
    return out if threshold is None else out.where(F.col("slope") > threshold)


def bottom_runs(hist: DataFrame, unit: str, n_units: int | Column, share: float = 0.9, least: int | None = 3) -> DataFrame:
    """Longest run of ranks after the baseline in the worst tenth, and the part of these ranks spent there."""
    out = unit_signals(hist, unit, n_units, share=share).select(unit, "longest_run", F.col("n_recent").alias("n_frames"), "pct_bad")
    return out if least is None else out.where(F.col("longest_run") >= least)


def signal_report(signals: DataFrame, unit: str, drop: float = 3.0, slope: float = 2.0, run: int = 3, top: int | None = 10) -> DataFrame:
    """``degradation_report`` out of ``unit_signals``, in one pass over it."""
    parts = (("rank_drop", F.col("drop"), F.col("drop") > drop), ("trend", F.col("slope"), F.col("slope") > slope), ("persistent", F.col("longest_run").cast("double"), F.col("longest_run") >= run))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("signal"), F.when(met, value).alias("severity")) for name, value, met in parts)))
    return _placed(signals.select(unit, each.alias("s")).select("s.signal", unit, "s.severity").where("severity is not null"), unit, top)


def _placed(rows: DataFrame, unit: str, top: int | None) -> DataFrame:
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("severity"), unit)))
    return rows if top is None else rows.where(F.col("position") <= top)


def degradation_report(drops: DataFrame, trends: DataFrame, runs: DataFrame, unit: str, top: int | None = 10) -> DataFrame:
    """The three signals in one list: ``signal, unit, severity, position``, worst first."""
    parts = [
        drops.select(F.lit("rank_drop").alias("signal"), unit, F.col("drop").alias("severity")),
        trends.select(F.lit("trend").alias("signal"), unit, F.col("slope").alias("severity")),
        runs.select(F.lit("persistent").alias("signal"), unit, F.col("longest_run").cast("double").alias("severity")),
    ]
    return _placed(parts[0].unionByName(parts[1]).unionByName(parts[2]), unit, top)


def flagged_units(report: DataFrame, unit: str) -> DataFrame:
    """Units with any signal, and the number of signals."""
    return report.groupBy(unit).agg(F.countDistinct("signal").alias("n_signals"))


def frame_summary(ranks: DataFrame, frame: str, unit: str, which=None, top: int = 5) -> DataFrame:
    """The best and worst units of a frame (by default the last): ``side, position, unit, rank, composite``."""
    if which is None:
        last = ranks.agg(F.max(frame).alias(frame))
        rows = ranks.join(F.broadcast(last), frame)
    else:
        rows = ranks.where(F.col(frame) == which)
    rows = rows.where("rank is not null")
    best = rows.withColumn("position", F.row_number().over(Window.partitionBy(frame).orderBy("rank", unit))).withColumn("side", F.lit("best"))
    worst = rows.withColumn("position", F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("rank"), unit))).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).where(F.col("position") <= top).select("side", "position", frame, unit, "rank", "composite")


def degradation_scatter(hist: DataFrame, flagged: DataFrame, unit: str, window: int = 5) -> DataFrame:
    """Baseline rank against the median of the last ranks of each unit, with its flag."""
    recent = hist.where(F.col("from_end") <= window).groupBy(unit).agg(F.median("rank").alias("recent_rank"))
    out = rank_baseline(hist, unit).select(unit, "base_rank").join(recent, unit)
    return out.join(flagged.select(unit, F.lit(True).alias("flagged")), unit, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def rank_matrix(hist: DataFrame, unit: str, n_frames: int) -> DataFrame:
    """One row per unit, one column ``f<k>`` per frame number, in order of the median rank."""
    wide = hist.groupBy(unit).pivot("frame_idx", list(range(1, n_frames + 1))).agg(F.first("rank"))
    wide = wide.select(unit, *(F.col(str(k)).alias(f"f{k}") for k in range(1, n_frames + 1)))
    middle = hist.groupBy(unit).agg(F.median("rank").alias("median_rank"))
    return wide.join(middle, unit).orderBy("median_rank", unit)


def rank_rows(hist: DataFrame, unit: str) -> DataFrame:
    """The matrix in long form, for any number of frames: ``unit, frame_idx, rank, median_rank``."""
    return hist.select(unit, "frame_idx", "rank", F.median("rank").over(Window.partitionBy(unit)).alias("median_rank"))


def feature_series(obs: DataFrame, ts: str, unit: str, feature: str, units: list | None = None) -> DataFrame:
    """Time series of one feature of chosen units."""
    rows = obs if units is None else obs.where(F.col(unit).isin(*units))
    return rows.select(ts, unit, F.lit(feature).alias("feature"), F.col(feature).alias("value"))


def student_p(r2: float, n: float) -> float:
    """Two-sided p-value of a regression slope from R2 and the number of points.

    Student's t tail by the incomplete beta function's continued fraction.
    """
    if n is None or r2 is None or not n > 2:
        return float("nan")
    if r2 >= 1:
        return 0.0
    v = n - 2
    x = 1 - r2  # v / (v + t^2)
    a, b = v / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # Lentz' evaluation of the continued fraction.
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    p = front * (f - 1)
    return min(1.0, max(0.0, 1 - p if flip else p))


def drift_regression(obs: DataFrame, ts: str, features: list[str], unit: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Linear drift per feature: slope per day, intercept, R2, p-value, significance.

    Hours count from the first frame, which is a one-row aggregate.
    """
    keys = [unit] if unit else []
    obs = observations(obs, features)
    start = obs.agg(F.min(ts).alias("_start"))
    rows = obs.join(F.broadcast(start)).withColumn("hours", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 3.6e9)
    rows = rows.unpivot([*keys, "hours"], features, "feature", "value")
    fit = rows.groupBy(*keys, "feature").agg(
        (F.regr_slope("value", "hours") * 24).alias("slope_per_day"), F.regr_intercept("value", "hours").alias("intercept"), F.regr_r2("value", "hours").alias("r2"), F.regr_count("value", "hours").alias("n")
    )

    @F.pandas_udf("double")
    def tail(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) for a, b in zip(r2.astype(float), n.astype(float), strict=True)], dtype=np.float64)

    return fit.withColumn("p_value", tail("r2", "n")).withColumn("significant", F.col("p_value") < alpha)


def trend_line(obs: DataFrame, fit: DataFrame, ts: str, feature: str) -> DataFrame:
    """Values of the fitted line of one feature at each time."""
    start = obs.agg(F.min(ts).alias("_start"))
    one = fit.where(F.col("feature") == feature).select("slope_per_day", "intercept")
    hours = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 3.6e9
    return obs.select(ts).join(F.broadcast(start)).join(F.broadcast(one)).select(ts, (F.col("intercept") + F.col("slope_per_day") / 24 * hours).alias("trend"))
