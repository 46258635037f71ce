"""Scores of observations against a baseline or against their own frame.

Baselines have one row per unit (and feature). They are joined by equality on
the unit; the planner broadcasts them where their measured size allows. Frame
statistics are windows over the frame. NULL features never count as outliers
and do not disturb the statistics of their frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.baseline import MAD_SCALE
from facetwatch.schemas import COMPOSITE_FEATURES, LOWER_IS_BETTER, long, observations


def z_scores(obs: DataFrame, baseline: DataFrame, frame: str, unit: str, features: list[str]) -> DataFrame:
    """``frame, unit, feature, value, median, mad, z`` with z = (value - median) / mad."""
    rows = long(observations(obs.select(frame, unit, *features), features), [frame, unit], features)
    return rows.join(baseline, [unit, "feature"]).withColumn("z", F.try_divide(F.col("value") - F.col("median"), F.col("mad")))


def feature_outliers(scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows whose z is beyond the threshold, with ``side`` high or low."""
    side = F.when(F.col("z") > threshold, "high").when(F.col("z") < -threshold, "low")
    return scored.withColumn("side", side).where("side is not null")


def outlier_lists(outliers: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Sorted units per ``by`` columns."""
    return outliers.groupBy(*by).agg(F.sort_array(F.collect_set(unit)).alias("units"))


def outlier_rows(outliers: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Each unit once per ``by`` columns, with the number of units there: the lists as rows, for any number of units."""
    rows = outliers.select(*by, unit).distinct()
    return rows.join(rows.groupBy(*by).agg(F.count("*").alias("n_units")), by)


def _vector(features: list[str]) -> Column:
    return F.array(*map(F.col, features))


def mahalanobis(obs: DataFrame, vbaseline: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """``obs`` with ``mahalanobis``: the squared form is held at zero before the root."""
    k = len(features)
    both = observations(obs, features).join(vbaseline.select(unit, "median", "cov_inv"), unit)
    both = both.withColumn("_d", F.zip_with(_vector(features), "median", lambda a, b: a - b))
    d, c = F.col("_d"), F.col("cov_inv")
    form = sum((d[i] * c[i * k + j] * d[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return both.withColumn("mahalanobis", F.sqrt(F.greatest(form, F.when(form.isNotNull(), F.lit(0.0))))).drop("_d", "median", "cov_inv")


def euclidean(obs: DataFrame, vbaseline: DataFrame, unit: str, features: list[str], standardize: bool = True) -> DataFrame:
    """``obs`` with ``euclidean`` distance to the median vector, by default in standard deviations."""
    both = observations(obs, features).join(vbaseline.select(unit, "median", "std"), unit)
    d = [(F.col(f) - F.col("median")[i]) / (F.col("std")[i] if standardize else 1.0) for i, f in enumerate(features)]
    return both.withColumn("euclidean", F.sqrt(sum((x * x for x in d), F.lit(0.0)))).drop("median", "std")


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(obs: DataFrame, vbaseline: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """``obs`` with ``cosine`` distance to the median vector."""
    both = observations(obs, features).join(vbaseline.select(unit, "median"), unit).withColumn("_v", _vector(features))
    value = 1 - dot("_v", "median") / (F.sqrt(dot("_v", "_v")) * F.sqrt(dot("median", "median")) + 1e-12)
    return both.withColumn("cosine", value).drop("_v", "median")


def frame_cut(df: DataFrame, frame: str, score: str, n_std: float = 3.0) -> DataFrame:
    """Rows above mean + n population deviations of their frame."""
    w = Window.partitionBy(frame)
    out = observations(df, [score]).withColumn("cut", F.avg(score).over(w) + n_std * F.stddev_pop(score).over(w))
    return out.where(F.col(score) > F.col("cut"))


def band_outliers(obs: DataFrame, spread: DataFrame, unit: str, feature: str, width: float = 2.5) -> DataFrame:
    """Rows outside median +- width * std; ``spread`` has ``unit, median, std``."""
    both = observations(obs, [feature]).join(spread, unit)
    both = both.withColumn("low", F.col("median") - width * F.col("std")).withColumn("high", F.col("median") + width * F.col("std"))
    return both.where((F.col(feature) < F.col("low")) | (F.col(feature) > F.col("high")))


def median_std(obs: DataFrame, unit: str, feature: str) -> DataFrame:
    """``unit, median, std`` (population) of one feature, the input of :func:`band_outliers`."""
    return observations(obs, [feature]).groupBy(unit).agg(F.median(feature).alias("median"), F.stddev_pop(feature).alias("std"))


def signed(z: Column, feature: Column | str = "feature", lower_is_better: list[str] = LOWER_IS_BETTER) -> Column:
    """z with its sign flipped for features that are better when lower."""
    feature = F.col(feature) if isinstance(feature, str) else feature
    return F.when(feature.isin(*lower_is_better), -z).otherwise(z) if lower_is_better else z


def signed_composite(scored: DataFrame, frame: str, unit: str, lower_is_better: list[str] = LOWER_IS_BETTER, limit: float = 3.0) -> DataFrame:
    """Mean signed z over the features of a unit; ``flag`` where it is beyond the limit."""
    out = scored.groupBy(frame, unit).agg(F.avg(signed(F.col("z"), "feature", lower_is_better)).alias("composite"))
    return out.withColumn("flag", F.coalesce(F.abs("composite") > limit, F.lit(False)))


def sigma_rows(obs: DataFrame, stat: DataFrame, frame: str, unit: str, features: list[str], n_std: float = 3.0) -> DataFrame:
    """Per feature: bounds, z, and ``anomalous``, against a statistical baseline (mean, std)."""
    rows = long(observations(obs.select(frame, unit, *features), features), [frame, unit], features)
    rows = rows.join(stat.select(unit, "feature", "mean", "std"), [unit, "feature"])
    rows = rows.withColumns({"lower": F.col("mean") - n_std * F.col("std"), "upper": F.col("mean") + n_std * F.col("std"), "z": F.try_divide(F.col("value") - F.col("mean"), F.col("std"))})
    return rows.withColumn("anomalous", F.coalesce((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.lit(False)))


def sigma_decision(rows: DataFrame, frame: str, unit: str) -> DataFrame:
    """Number of anomalous features, whether there is any, and the largest |z|."""
    out = rows.groupBy(frame, unit).agg(F.count_if("anomalous").alias("n_anomalous"), F.max(F.abs("z")).alias("max_abs_z"))
    return out.withColumn("is_anomaly", F.col("n_anomalous") > 0)


def sigma_report(rows: DataFrame, frame: str, unit: str, top: int = 5) -> DataFrame:
    """The features with the largest |z| of each unit in a frame."""
    w = Window.partitionBy(frame, unit).orderBy(F.desc(F.abs("z")), "feature")
    return rows.where("z is not null").withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)


def frame_z(df: DataFrame, frame: str, columns: list[str], least: float | None = None) -> DataFrame:
    """Robust z of each column within its frame, in columns ``z_<name>``.

    ``least``: at a MAD of at most this, and for frames of fewer than two
    values, z is 0 and NULL; without it a MAD of 0 gives NULL.
    """
    w = Window.partitionBy(frame)
    df = observations(df, columns)
    df = df.withColumns({f"_m_{c}": F.median(c).over(w) for c in columns} | {f"_n_{c}": F.count(c).over(w) for c in columns})
    df = df.withColumns({f"_d_{c}": F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).over(w) * MAD_SCALE for c in columns})

    def z(c: str) -> Column:
        raw = F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_d_{c}"))
        if least is None:
            return raw
        raw = F.when(F.col(f"_d_{c}") <= least, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(raw)
        return F.when(F.col(f"_n_{c}") >= 2, raw)

    return df.withColumns({f"z_{c}": z(c) for c in columns}).drop(*(f"_{p}_{c}" for p in "mnd" for c in columns))


def robust_frame_outliers(obs: DataFrame, frame: str, feature: str, sigma: float = 3.0) -> DataFrame:
    """Rows whose robust z within the frame is beyond sigma."""
    return frame_z(obs, frame, [feature]).where(F.abs(f"z_{feature}") > sigma)


def composite_of(df: DataFrame, features: list[str], lower_is_better: list[str]) -> Column:
    """Mean of the signed ``z_<feature>`` columns that are not NULL."""
    terms = [-F.col(f"z_{f}") if f in lower_is_better else F.col(f"z_{f}") for f in features]
    known = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms), F.lit(0))
    return F.try_divide(sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)), known)


def composite_outliers(obs: DataFrame, frame: str, features: list[str] = COMPOSITE_FEATURES, lower_is_better: list[str] = LOWER_IS_BETTER, below: float = -1.2) -> DataFrame:
    """Rows whose mean signed robust z within the frame is below a limit."""
    z = frame_z(obs, frame, features)
    return z.withColumn("composite", composite_of(z, features, lower_is_better)).where(F.col("composite") < below)


def mean_abs_z(obs: DataFrame, group: list[str], features: list[str], above: float | None = 2.0) -> DataFrame:
    """Mean |z| over features, with mean and population deviation of the group."""
    obs, w = observations(obs, features), Window.partitionBy(*group)
    z = obs.withColumns({f"z_{f}": F.try_divide(F.col(f) - F.avg(f).over(w), F.stddev_pop(f).over(w)) for f in features})
    known = sum((F.when(F.col(f"z_{f}").isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    out = z.withColumn("mean_abs_z", F.try_divide(sum((F.coalesce(F.abs(f"z_{f}"), F.lit(0.0)) for f in features), F.lit(0.0)), known)).drop(*(f"z_{f}" for f in features))
    return out if above is None else out.where(F.col("mean_abs_z") > above)


def consecutive_pairs(obs: DataFrame, frame: str, part: Column | None = None) -> DataFrame:
    """Each frame with the one before it: ``frame_a, frame_b``.

    ``part`` (a day, a month) must not fall while frames rise. Frames are paired
    within their part, and the last frame of a part with the first of the next; only
    the table of parts is one ordered partition. Without ``part`` all frames are one.
    """
    frames = obs.select(frame).distinct().withColumn("_part", F.lit(0) if part is None else part)
    inner = frames.select(F.lag(frame).over(Window.partitionBy("_part").orderBy(frame)).alias("frame_a"), F.col(frame).alias("frame_b"))
    ends = frames.groupBy("_part").agg(F.min(frame).alias("frame_b"), F.max(frame).alias("_last"))
    outer = ends.select(F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("frame_b")).alias("frame_a"), "frame_b")
    return inner.unionByName(outer).where("frame_a is not null")


def frame_pair_diff(obs: DataFrame, pairs: DataFrame, frame: str, unit: str, features: list[str]) -> DataFrame:
    """Unit by unit, two frames in values standardized over both together.

    ``frame_a, frame_b, unit, distance, d_<feature>``. The statistics of a pair
    come from per-frame sums, so no row is grouped twice; a feature that is
    constant over a pair counts as 0.
    """
    obs = observations(obs.select(frame, unit, *features), features)
    sums = obs.groupBy(frame).agg(*(a for i, f in enumerate(features) for a in (F.count(f).alias(f"n{i}"), F.sum(f).alias(f"s{i}"), F.sum(F.col(f) * F.col(f)).alias(f"q{i}"))))

    def side(k: str) -> DataFrame:
        return sums.select(F.col(frame).alias(f"frame_{k}"), *(F.col(c).alias(f"{c}{k}") for c in sums.columns if c != frame))

    both = pairs.join(side("a"), "frame_a").join(side("b"), "frame_b")
    std = {}
    for i in range(len(features)):
        n, s, q = (F.col(f"{c}{i}a") + F.col(f"{c}{i}b") for c in "nsq")
        std[f"std{i}"] = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    both = both.withColumns(std).select("frame_a", "frame_b", *std)
    a = obs.select(F.col(frame).alias("frame_a"), unit, *(F.col(f).alias(f"a{i}") for i, f in enumerate(features)))
    b = obs.select(F.col(frame).alias("frame_b"), unit, *(F.col(f).alias(f"b{i}") for i, f in enumerate(features)))
    rows = both.join(a, "frame_a").join(b, ["frame_b", unit])
    d = [F.when(F.col(f"std{i}") > 1e-12, (F.col(f"b{i}") - F.col(f"a{i}")) / F.col(f"std{i}")).otherwise(F.when((F.col(f"b{i}") - F.col(f"a{i}")).isNotNull(), F.lit(0.0))) for i in range(len(features))]
    return rows.select("frame_a", "frame_b", unit, F.sqrt(sum((x * x for x in d), F.lit(0.0))).alias("distance"), *(x.alias(f"d_{f}") for x, f in zip(d, features, strict=True)))


def pair_report(diffs: DataFrame, unit: str, features: list[str], top: int = 10, top_features: int = 3) -> DataFrame:
    """The units that differ most between two frames, and the features they differ in.

    Columns ``position``, and ``reasons`` as text ``feature=+1.23; ...``.
    """
    w = Window.partitionBy("frame_a", "frame_b").orderBy(F.desc("distance"), unit)
    best = diffs.where("distance is not null").withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
    rows = F.array(*(F.struct((-F.abs(f"d_{f}")).alias("size"), F.lit(f).alias("feature"), F.col(f"d_{f}").alias("d")) for f in features))
    first = F.slice(F.array_sort(rows), 1, top_features)
    text = F.transform(first, lambda r: F.format_string("%s=%+.2f", r["feature"], r["d"]))
    return best.select("frame_a", "frame_b", unit, "position", "distance", F.array_join(text, "; ").alias("reasons"))


def vote(outliers: DataFrame, frame: str, unit: str, strategy: str = "union", min_votes: int = 2, feature: str = "feature") -> DataFrame:
    """Units flagged by enough features: one for ``union``, ``min_votes`` for ``voting``."""
    if strategy not in ("union", "voting"):
        raise ValueError(f"unknown strategy {strategy}")
    votes = outliers.groupBy(frame, unit).agg(F.countDistinct(feature).alias("votes"))
    return votes.where(F.col("votes") >= (1 if strategy == "union" else min_votes))


def max_abs_z(scored: DataFrame, frame: str, unit: str) -> DataFrame:
    """Ranking score: the largest |z| over features."""
    return scored.groupBy(frame, unit).agg(F.max(F.abs("z")).alias("score"))

