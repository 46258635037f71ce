"""Baselines and exploratory statistics per facet.

Feature tables are wide, ``(frame, unit, feature columns)``, and grouped once
per key; sums and covariances combine before the shuffle. Exact medians keep
the values of one unit together; ``approx=True`` bounds that for very long
histories.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetwatch.operators.ranks import percentiles
from facetwatch.schemas import long, observations

#: Scale of the median absolute deviation, and the least spread.
MAD_SCALE, FLOOR = 1.4826, 1e-6


def stacked(df: DataFrame, keys: list[str], features: list[str], columns: dict[str, str]) -> DataFrame:
    """Long form of ``<prefix>_<feature>`` columns: one row per key and feature.

    ``columns`` maps output names to prefixes.
    """
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"{p}_{f}").alias(c) for c, p in columns.items())) for f in features)))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def robust_baseline(obs: DataFrame, unit: str, features: list[str], approx: bool = False) -> DataFrame:
    """Median and scaled MAD of each feature per unit: ``unit, feature, median, mad``.

    One shuffle by unit serves both medians. MAD is at least 1e-6.
    """
    obs = observations(obs.select(unit, *features), features)
    if approx:
        middle = obs.groupBy(unit).agg(*(F.approx_percentile(f, 0.5, 10_000).alias(f"m_{f}") for f in features))
        both = obs.join(middle, unit)
        grouped = both.groupBy(unit).agg(*(F.first(f"m_{f}").alias(f"med_{f}") for f in features), *(F.approx_percentile(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 10_000).alias(f"dev_{f}") for f in features))
    else:
        w = Window.partitionBy(unit)
        both = obs.withColumns({f"m_{f}": F.median(f).over(w) for f in features})
        grouped = both.groupBy(unit).agg(*(F.first(f"m_{f}").alias(f"med_{f}") for f in features), *(F.median(F.abs(F.col(f) - F.col(f"m_{f}"))).alias(f"dev_{f}") for f in features))
    grouped = grouped.withColumns({f"mad_{f}": F.greatest(F.col(f"dev_{f}") * MAD_SCALE, F.when(F.col(f"dev_{f}").isNotNull(), F.lit(FLOOR))) for f in features})
    return stacked(grouped, [unit], features, {"median": "med", "mad": "mad"})


def covariances(obs: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """Sample covariance of every feature pair over complete rows, per unit: ``cov_i_j``."""
    obs = observations(obs, features)
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    k = range(len(features))
    pairs = [F.covar_samp(F.when(whole, F.col(features[i])), F.when(whole, F.col(features[j]))).alias(f"cov_{i}_{j}") for i, j in combinations_with_replacement(k, 2)]
    return obs.groupBy(unit).agg(F.count_if(whole).alias("n_complete"), F.count("*").alias("n_rows"), *pairs)


def vector_baseline(obs: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """Median, standard deviation and inverse covariance per unit, as arrays.

    The covariance falls back to the diagonal of variances where fewer than
    k + 2 rows are complete; fewer than k + 2 rows in all are an error.
    """
    k = len(features)
    obs = observations(obs.select(unit, *features), features)
    spread = obs.groupBy(unit).agg(
        F.array(*(F.median(f) for f in features)).alias("median"), F.array(*(F.greatest(F.stddev_pop(f), F.lit(FLOOR)) for f in features)).alias("std")
    )
    both = spread.join(covariances(obs, unit, features), unit)
    pairs = list(combinations_with_replacement(range(k), 2))
    packed = both.select(unit, "median", "std", "n_complete", "n_rows", F.array(*(F.col(f"cov_{i}_{j}") for i, j in pairs)).alias("cov"))
    schema = packed.select(unit, "median", "std").schema.add("cov_inv", T.ArrayType(T.DoubleType())).add("n_complete", T.LongType())

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for n, total, std, cov in zip(rows["n_complete"], rows["n_rows"], rows["std"], rows["cov"], strict=True):
                if total < k + 2:
                    raise ValueError(f"a vector baseline of {k} features needs {k + 2} rows; a unit has {total}")
                c = np.zeros((k, k))
                if n < k + 2:
                    c[np.diag_indices(k)] = np.array(std, float) ** 2
                else:
                    for (i, j), v in zip(pairs, cov, strict=True):
                        c[i, j] = c[j, i] = v
                c += np.eye(k) * FLOOR
                out.append(np.linalg.inv(c).ravel().tolist() if np.isfinite(c).all() else None)
            yield rows[[unit, "median", "std"]].assign(cov_inv=out, n_complete=rows["n_complete"])

    return packed.mapInPandas(invert, schema)


def stat_baseline(obs: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """Mean, sample deviation, range and 5th and 95th percentiles per unit and feature."""
    obs = observations(obs.select(unit, *features), features)
    aggs = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "p95": lambda c: F.percentile(c, 0.95), "p05": lambda c: F.percentile(c, 0.05)}
    grouped = obs.groupBy(unit).agg(*(a(f).alias(f"{p}_{f}") for f in features for p, a in aggs.items()))
    return stacked(grouped, [unit], features, {p: p for p in aggs})


def unit_spread(obs: DataFrame, unit: str, feature: str, above: float | None = None) -> DataFrame:
    """Mean and population deviation of one feature per unit, optionally those that vary more than ``above``."""
    out = observations(obs, [feature]).groupBy(unit).agg(F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("std"))
    return out if above is None else out.where(F.col("std") > above)


def overall_spread(obs: DataFrame, unit: str, feature: str) -> DataFrame:
    """Means over units of the per-unit mean and deviation: one row."""
    return unit_spread(obs, unit, feature).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.count("*").alias("n_units"))


def coef_variation(obs: DataFrame, unit: str, features: list[str], sample: bool = False) -> DataFrame:
    """Deviation over mean per unit and feature; population deviation unless ``sample``."""
    obs, std = observations(obs, features), F.stddev_samp if sample else F.stddev_pop
    grouped = obs.groupBy(unit).agg(*(F.try_divide(std(f), F.avg(f)).alias(f"cv_{f}") for f in features))
    return stacked(grouped, [unit], features, {"cv": "cv"})


def relative_mad(obs: DataFrame, unit: str, feature: str, by: str) -> DataFrame:
    """MAD over median of the ratio ``feature / by`` per unit."""
    ratio = observations(obs, [feature, by]).select(unit, F.try_divide(F.col(feature), F.col(by)).alias("ratio"))
    base = robust_baseline(ratio, unit, ["ratio"])
    return base.select(unit, "median", "mad", F.try_divide(F.col("mad"), F.col("median")).alias("rel_mad"))


def corr_pairs(obs: DataFrame, features: list[str], unit: str | None = None) -> DataFrame:
    """Pearson correlation of every feature pair, per unit or overall, from one aggregation."""
    obs = observations(obs, features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    keys = [unit] if unit else []
    grouped = obs.groupBy(*keys).agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs))))
    return grouped.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def feature_summary(obs: DataFrame, features: list[str]) -> DataFrame:
    """Mean, sample deviation and sample variance of each feature over all rows."""
    rows = long(observations(obs, features), [], features)
    return rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("var"))


def above_mean(baseline_obs: DataFrame, new: DataFrame, unit: str, feature: str) -> DataFrame:
    """Rows of ``new`` whose feature is above the unit's mean in the baseline."""
    model = observations(baseline_obs, [feature]).groupBy(unit).agg(F.avg(feature).alias("mean"))
    return observations(new, [feature]).join(model, unit).where(F.col(feature) > F.col("mean"))


def score_percentiles(df: DataFrame, score: str, at: list[float] = [0.01, 0.05, 0.5, 0.95], by: list[str] | None = None) -> DataFrame:  # noqa: B006
    """Exact percentiles of a score: one row per percentile (and group), from ranks in ranges of values."""
    return percentiles(observations(df, [score]), score, at, by or [])


def common_mode(obs: DataFrame, frame: str, features: list[str]) -> DataFrame:
    """Each feature minus its mean in the frame."""
    w = Window.partitionBy(frame)
    return observations(obs, features).withColumns({f: F.col(f) - F.avg(f).over(w) for f in features})


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins over the data range; the right edge belongs to the last bin.

    The range is one small aggregate that is broadcast; no window over all rows.
    """
    df = observations(df.select(column), [column]).where(F.col(column).isNotNull())
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col(column)
    k = F.when(hi == lo, F.lit(bins // 2 + 1)).otherwise(F.least(F.lit(bins), F.floor((x - lo) / (hi - lo) * bins).cast("int") + 1))
    return df.join(F.broadcast(ends)).select(k.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))

