"""Registered queries: the library's operators over the warehouse tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwatch.functions import colours as colour
from facetwatch.functions import patches, times
from facetwatch.operators import baseline, geometry, metrics, ml, score, selection, temporal
from facetwatch.plans.inputs import COLOURS, E_FEATURES, L_FEATURES, L_LOWER, LONG_L, OBS_E, OBS_L, PIXELS, SUSPECTS, colours, obs_e, obs_l, pixels, read, suspects, vectors
from facetwatch.operators.lineage import scratch
from facetwatch.sources import annotations, calibration, store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rnd(df, digits: int = 4, *names: str):
    """Rounds double columns (all of them, or the named ones)."""
    cols = names or [c for c, t in df.dtypes if t == "double"]
    # The small step takes ties off the border between two decimals, here and in SQL alike.
    return df.withColumns({c: F.round(F.col(c) + 10.0 ** -(digits + 5), digits) + F.lit(0.0) for c in cols})


def _r(*names: str, digits: int = 4) -> str:
    """The same in SQL: ``name`` or ``name=expression``."""
    out = []
    for n in names:
        name, _, e = n.partition("=")
        out.append(f"round({e or name} + 1e-{digits + 5}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


# Baselines.

_BASE = LONG_L + """, med AS (SELECT unit, feature, median(value) AS median FROM lng GROUP BY 1, 2),
    base AS (SELECT unit, feature, any_value(med.median) AS median, greatest(1.4826 * median(abs(value - med.median)), 1e-6) AS mad FROM lng JOIN med USING (unit, feature) GROUP BY 1, 2)"""
_Z = _BASE + """, z AS (SELECT frame, unit, feature, value, median, mad, (value - median) / mad AS z FROM lng JOIN base USING (unit, feature))"""


@query(f"WITH {_BASE} SELECT unit, feature, {_r('median', 'mad')} FROM base")
def robust_baseline(spark, sf_dir):
    return rnd(baseline.robust_baseline(obs_l(spark, sf_dir), "unit", L_FEATURES))


@query(f"""WITH {LONG_L} SELECT unit, feature, {_r("mean=avg(value)", "std=stddev_samp(value)", "min=min(value)", "max=max(value)", "p95=quantile_cont(value, 0.95)", "p05=quantile_cont(value, 0.05)")}
    FROM lng GROUP BY unit, feature""")
def stat_baseline(spark, sf_dir):
    return rnd(baseline.stat_baseline(obs_l(spark, sf_dir), "unit", L_FEATURES))


@query(f"""WITH {OBS_L} SELECT unit, count(*) AS n_complete, {_r("cov_0_0=covar_samp(quantity, quantity)", "cov_0_1=covar_samp(quantity, price)", "cov_1_1=covar_samp(price, price)", digits=2)}
    FROM obs GROUP BY unit""")
def cov_baseline(spark, sf_dir):
    return rnd(baseline.covariances(obs_l(spark, sf_dir), "unit", ["quantity", "price"]).drop("n_rows"), 2)


@query(f"WITH {OBS_L} SELECT unit, {_r('mean=avg(quantity)', 'std=stddev_pop(quantity)')} FROM obs GROUP BY unit HAVING stddev_pop(quantity) > 5")
def unit_spread(spark, sf_dir):
    return rnd(baseline.unit_spread(obs_l(spark, sf_dir), "unit", "quantity", 5.0))


@query(f"WITH {OBS_L}, u AS (SELECT unit, avg(quantity) AS m, stddev_pop(quantity) AS s FROM obs GROUP BY unit) SELECT {_r('mean=avg(m)', 'std=avg(s)')}, count(*) AS n_units FROM u")
def overall_spread(spark, sf_dir):
    return rnd(baseline.overall_spread(obs_l(spark, sf_dir), "unit", "quantity"))


@query(f"WITH {LONG_L} SELECT unit, feature, {_r('cv=stddev_pop(value) / avg(value)')} FROM lng GROUP BY unit, feature")
def coef_variation(spark, sf_dir):
    return rnd(baseline.coef_variation(obs_l(spark, sf_dir), "unit", L_FEATURES))


@query(f"""WITH {OBS_L}, r AS (SELECT unit, quantity / price AS x FROM obs), m AS (SELECT unit, median(x) AS median FROM r GROUP BY unit),
    d AS (SELECT unit, any_value(m.median) AS median, greatest(1.4826 * median(abs(x - m.median)), 1e-6) AS mad FROM r JOIN m USING (unit) GROUP BY unit)
    SELECT unit, {_r('median', 'mad', digits=7)}, {_r('rel_mad=mad / median')} FROM d""")
def relative_mad(spark, sf_dir):
    return rnd(rnd(baseline.relative_mad(obs_l(spark, sf_dir), "unit", "quantity", "price"), 7, "median", "mad"), 4, "rel_mad")


_CORR = [(a, b) for i, a in enumerate(L_FEATURES) for b in L_FEATURES[i + 1 :]]


@query(f"WITH {OBS_L} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r(f'corr=corr({a}, {b})')} FROM obs" for a, b in _CORR))
def corr_pairs(spark, sf_dir):
    return rnd(baseline.corr_pairs(obs_l(spark, sf_dir), L_FEATURES))


@query(f"WITH {OBS_L} " + " UNION ALL ".join(f"SELECT unit, '{a}' AS feature_a, '{b}' AS feature_b, {_r(f'corr=corr({a}, {b})')} FROM obs GROUP BY unit" for a, b in _CORR))
def corr_pairs_by_unit(spark, sf_dir):
    return rnd(baseline.corr_pairs(obs_l(spark, sf_dir), L_FEATURES, "unit"))


@query(f"WITH {LONG_L} SELECT feature, {_r('mean=avg(value)', 'std=stddev_samp(value)', 'var=var_samp(value)', digits=3)} FROM lng GROUP BY feature")
def feature_summary(spark, sf_dir):
    return rnd(baseline.feature_summary(obs_l(spark, sf_dir), L_FEATURES), 3)


@query(f"""WITH {OBS_L}, m AS (SELECT unit, avg(quantity) AS mean FROM obs WHERE frame < '1998-01' GROUP BY unit)
    SELECT frame, unit, {_r('quantity', 'mean')} FROM obs JOIN m USING (unit) WHERE frame >= '1998-01' AND quantity > mean""")
def above_mean(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    out = baseline.above_mean(obs.where("frame < '1998-01'"), obs.where("frame >= '1998-01'"), "unit", "quantity")
    return rnd(out.select("frame", "unit", "quantity", "mean"))


@query(f"""WITH {OBS_L}, p AS (SELECT unnest([0.01, 0.05, 0.5, 0.95])::DOUBLE AS percentile) SELECT percentile, {_r("value=CASE percentile WHEN 0.01 THEN a WHEN 0.05 THEN b WHEN 0.5 THEN c ELSE d END")}
    FROM p, (SELECT quantile_cont(price, 0.01) AS a, quantile_cont(price, 0.05) AS b, quantile_cont(price, 0.5) AS c, quantile_cont(price, 0.95) AS d FROM obs)""")
def score_percentiles(spark, sf_dir):
    return rnd(rnd(baseline.score_percentiles(obs_l(spark, sf_dir), "price"), 4, "value"), 2, "percentile")


@query(f"WITH {OBS_L} SELECT frame, unit, " + _r(*(f"{f}={f} - avg({f}) OVER (PARTITION BY frame)" for f in L_FEATURES)) + " FROM obs")
def common_mode(spark, sf_dir):
    return rnd(baseline.common_mode(obs_l(spark, sf_dir), "frame", L_FEATURES))


@query(f"""WITH {OBS_L}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM obs)
    SELECT least(50, floor((price - lo) / (hi - lo) * 50)::INTEGER + 1) AS bin, count(*) AS n FROM obs, e GROUP BY 1""")
def score_hist(spark, sf_dir):
    return baseline.histogram(obs_l(spark, sf_dir), "price", 50)


# Scores.


@query(f"WITH {_Z} SELECT frame, unit, feature, {_r('z')} FROM z")
def z_scores(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    return rnd(score.z_scores(obs, baseline.robust_baseline(obs, "unit", L_FEATURES), "frame", "unit", L_FEATURES).select("frame", "unit", "feature", "z"))


@query(f"WITH {_Z} SELECT frame, unit, feature, CASE WHEN z > 3 THEN 'high' ELSE 'low' END AS side, {_r('z')} FROM z WHERE abs(z) > 3")
def feature_outliers(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    scored = score.z_scores(obs, baseline.robust_baseline(obs, "unit", L_FEATURES), "frame", "unit", L_FEATURES)
    return rnd(score.feature_outliers(scored).select("frame", "unit", "feature", "side", "z"))


_EARLY = LONG_L + """, med AS (SELECT unit, feature, median(value) AS median FROM lng WHERE frame < '1997-01' GROUP BY 1, 2),
    base AS (SELECT unit, feature, any_value(med.median) AS median, greatest(1.4826 * median(abs(value - med.median)), 1e-6) AS mad FROM lng JOIN med USING (unit, feature) WHERE frame < '1997-01' GROUP BY 1, 2),
    o AS (SELECT frame, unit, feature, (value - median) / mad AS z FROM lng JOIN base USING (unit, feature) WHERE frame >= '1997-01' AND abs((value - median) / mad) > 3)"""


def _new_outliers(spark, sf_dir):
    """The first two years are the baseline, the rest is new."""
    obs = obs_l(spark, sf_dir)
    base = baseline.robust_baseline(obs.where("frame < '1997-01'"), "unit", L_FEATURES)
    return score.feature_outliers(score.z_scores(obs.where("frame >= '1997-01'"), base, "frame", "unit", L_FEATURES))


@query(f"WITH {_EARLY} SELECT frame, unit, count(DISTINCT feature) AS votes FROM o GROUP BY frame, unit")
def vote_union(spark, sf_dir):
    return score.vote(_new_outliers(spark, sf_dir), "frame", "unit", "union")


@query(f"WITH {_EARLY} SELECT frame, unit, count(DISTINCT feature) AS votes FROM o GROUP BY frame, unit HAVING count(DISTINCT feature) >= 2")
def vote_k(spark, sf_dir):
    return score.vote(_new_outliers(spark, sf_dir), "frame", "unit", "voting", 2)


@query(f"WITH {_EARLY} SELECT frame, unit, {_r('score=max(abs(z))')} FROM o GROUP BY frame, unit")
def max_abs_z(spark, sf_dir):
    return rnd(score.max_abs_z(_new_outliers(spark, sf_dir), "frame", "unit"))


@query(f"WITH {_EARLY}, u AS (SELECT DISTINCT frame, feature, unit FROM o) SELECT frame, feature, unit, count(*) OVER (PARTITION BY frame, feature) AS n_units FROM u")
def outlier_lists(spark, sf_dir):
    return score.outlier_rows(_new_outliers(spark, sf_dir), "unit", ["frame", "feature"])


@query(f"""WITH {_Z}, s AS (SELECT frame, unit, avg(CASE WHEN feature IN ('discount', 'tax') THEN -z ELSE z END) AS composite FROM z GROUP BY frame, unit)
    SELECT frame, unit, {_r('composite')}, abs(composite) > 1.5 AS flag FROM s""")
def signed_composite(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    scored = score.z_scores(obs, baseline.robust_baseline(obs, "unit", L_FEATURES), "frame", "unit", L_FEATURES)
    return rnd(score.signed_composite(scored, "frame", "unit", L_LOWER, 1.5))


_VEC = OBS_L + """, b AS (SELECT unit, median(quantity) AS mq, median(tax) AS mt, greatest(stddev_pop(quantity), 1e-6) AS sq, greatest(stddev_pop(tax), 1e-6) AS st,
    covar_samp(quantity, quantity) + 1e-6 AS a, covar_samp(quantity, tax) AS b, covar_samp(tax, tax) + 1e-6 AS c FROM obs GROUP BY unit)"""


@query(f"""WITH {_VEC} SELECT frame, unit, {_r("mahalanobis=sqrt(greatest((c * (quantity - mq) * (quantity - mq) - 2 * b * (quantity - mq) * (tax - mt) + a * (tax - mt) * (tax - mt)) / (a * c - b * b), 0))")}
    FROM obs JOIN b USING (unit)""")
def mahalanobis_2d(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    vb = baseline.vector_baseline(obs, "unit", ["quantity", "tax"])
    return rnd(score.mahalanobis(obs, vb, "unit", ["quantity", "tax"]).select("frame", "unit", "mahalanobis"))


def _minor(rows: list[int], columns: list[int]) -> str:
    """The determinant of a part of the covariance ``k<i>_<j>``, written out."""
    if not rows:
        return "1.0"
    first, rest = rows[0], rows[1:]
    return "(" + " + ".join(f"{'-' if i % 2 else ''}k{min(first, c)}_{max(first, c)} * {_minor(rest, [x for x in columns if x != c])}" for i, c in enumerate(columns)) + ")"


_K4 = range(len(L_FEATURES))
_VEC4 = OBS_L + ", b AS (SELECT unit, " + ", ".join(f"median({f}) AS m{i}" for i, f in enumerate(L_FEATURES)) + ", " + ", ".join(f"covar_samp({L_FEATURES[i]}, {L_FEATURES[j]}){' + 1e-6' if i == j else ''} AS k{i}_{j}" for i in _K4 for j in _K4 if i <= j) + " FROM obs GROUP BY unit HAVING count(*) >= 6)"
_FORM4 = " + ".join(f"{'-' if (i + j) % 2 else ''}({L_FEATURES[i]} - m{i}) * ({L_FEATURES[j]} - m{j}) * {_minor([x for x in _K4 if x != i], [x for x in _K4 if x != j])}" for i in _K4 for j in _K4)


@query(f"WITH {_VEC4} SELECT frame, unit, {_r(f'mahalanobis=sqrt(greatest(({_FORM4}) / {_minor(list(_K4), list(_K4))}, 0))', digits=3)} FROM obs JOIN b USING (unit)")
def mahalanobis_all(spark, sf_dir):
    """Distance to the vector baseline over all four features."""
    obs = obs_l(spark, sf_dir)
    return rnd(score.mahalanobis(obs, baseline.vector_baseline(obs, "unit", L_FEATURES), "unit", L_FEATURES).select("frame", "unit", "mahalanobis"), 3)


@query(f"""WITH {_VEC} SELECT frame, unit, {_r("euclidean=sqrt(((quantity - mq) / sq) * ((quantity - mq) / sq) + ((tax - mt) / st) * ((tax - mt) / st))")} FROM obs JOIN b USING (unit)""")
def euclidean_std(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    vb = baseline.vector_baseline(obs, "unit", ["quantity", "tax"])
    return rnd(score.euclidean(obs, vb, "unit", ["quantity", "tax"]).select("frame", "unit", "euclidean"))


@query(f"""WITH {_VEC} SELECT frame, unit, {_r("cosine=1 - (quantity * mq + tax * mt) / (sqrt(quantity * quantity + tax * tax) * sqrt(mq * mq + mt * mt) + 1e-12)", digits=8)} FROM obs JOIN b USING (unit)""")
def cosine_to_median(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    vb = baseline.vector_baseline(obs, "unit", ["quantity", "tax"])
    return rnd(score.cosine(obs, vb, "unit", ["quantity", "tax"]).select("frame", "unit", "cosine"), 8)


@query(f"""WITH {OBS_L}, s AS (SELECT frame, unit, price, avg(price) OVER (PARTITION BY frame) + 1.5 * stddev_pop(price) OVER (PARTITION BY frame) AS cut FROM obs)
    SELECT frame, unit, {_r('price', 'cut')} FROM s WHERE price > cut""")
def frame_cut(spark, sf_dir):
    return rnd(score.frame_cut(obs_l(spark, sf_dir), "frame", "price", 1.5).select("frame", "unit", "price", "cut"))


@query(f"""WITH {OBS_L}, b AS (SELECT unit, median(price) AS median, stddev_pop(price) AS std FROM obs GROUP BY unit)
    SELECT frame, unit, {_r('price', 'low=median - 2.5 * std', 'high=median + 2.5 * std')} FROM obs JOIN b USING (unit) WHERE price < median - 2.5 * std OR price > median + 2.5 * std""")
def band_outliers(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    return rnd(score.band_outliers(obs, score.median_std(obs, "unit", "price"), "unit", "price").select("frame", "unit", "price", "low", "high"))


_SIGMA = LONG_L + """, st AS (SELECT unit, feature, avg(value) AS mean, stddev_samp(value) AS std FROM lng GROUP BY 1, 2),
    sg AS (SELECT frame, unit, feature, value, mean - 2 * std AS lower, mean + 2 * std AS upper, CASE WHEN std <> 0 THEN (value - mean) / std END AS z,
           coalesce(value < mean - 2 * std OR value > mean + 2 * std, false) AS anomalous FROM lng JOIN st USING (unit, feature))"""


def _sigma(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    return score.sigma_rows(obs, baseline.stat_baseline(obs, "unit", L_FEATURES), "frame", "unit", L_FEATURES, 2.0)


@query(f"WITH {_SIGMA} SELECT frame, unit, count(*) FILTER (WHERE anomalous) AS n_anomalous, {_r('max_abs_z=max(abs(z))')}, count(*) FILTER (WHERE anomalous) > 0 AS is_anomaly FROM sg GROUP BY frame, unit")
def sigma_decision(spark, sf_dir):
    return rnd(score.sigma_decision(_sigma(spark, sf_dir), "frame", "unit"))


@query(f"""WITH {_SIGMA}, p AS (SELECT *, row_number() OVER (PARTITION BY frame, unit ORDER BY round(abs(z), 6) DESC, feature) AS position FROM sg WHERE z IS NOT NULL)
    SELECT frame, unit, feature, position::INTEGER AS position, {_r('z=round(z, 6)', 'lower', 'upper')}, anomalous FROM p WHERE position <= 2""")
def sigma_report(spark, sf_dir):
    rows = _sigma(spark, sf_dir).withColumn("z", F.round("z", 6))
    return rnd(score.sigma_report(rows, "frame", "unit", 2).select("frame", "unit", "feature", "position", "z", "lower", "upper", "anomalous"))


_FZ = OBS_L + """, fm AS (SELECT frame, median(quantity) AS m FROM obs GROUP BY frame), fd AS (SELECT frame, any_value(m) AS m, 1.4826 * median(abs(quantity - m)) AS d FROM obs JOIN fm USING (frame) GROUP BY frame)"""


@query(f"WITH {_FZ} SELECT frame, unit, {_r('z_quantity=(quantity - m) / d')} FROM obs JOIN fd USING (frame) WHERE d <> 0 AND abs((quantity - m) / d) > 2")
def robust_frame_outliers(spark, sf_dir):
    return rnd(score.robust_frame_outliers(obs_l(spark, sf_dir), "frame", "quantity", 2.0).select("frame", "unit", "z_quantity"))


_COMP = LONG_L + """, m1 AS (SELECT frame, feature, median(value) AS m, count(value) AS k FROM lng GROUP BY 1, 2),
    m2 AS (SELECT frame, feature, any_value(m) AS m, any_value(k) AS k, 1.4826 * median(abs(value - m)) AS d FROM lng JOIN m1 USING (frame, feature) GROUP BY 1, 2),
    zs AS (SELECT frame, unit, feature, CASE WHEN d <= 1e-10 THEN 0 ELSE (value - m) / d END * CASE WHEN feature IN ('discount', 'tax') THEN -1 ELSE 1 END AS z FROM lng JOIN m2 USING (frame, feature) WHERE k >= 2),
    comp AS (SELECT frame, unit, round(avg(z), 6) AS composite FROM zs GROUP BY frame, unit)"""


@query(f"WITH {_COMP} SELECT frame, unit, {_r('composite')} FROM comp WHERE composite < -1.2")
def composite_outliers(spark, sf_dir):
    obs = temporal.composite_score(obs_l(spark, sf_dir), "frame", L_FEATURES, L_LOWER).withColumn("composite", F.round("composite", 6))
    return rnd(obs.where("composite < -1.2").select("frame", "unit", "composite"))


@query(f"""WITH {OBS_L}, z AS (SELECT frame, unit, """ + " + ".join(f"abs(({f} - avg({f}) OVER (PARTITION BY unit)) / stddev_pop({f}) OVER (PARTITION BY unit))" for f in L_FEATURES) + f""" AS s FROM obs)
    SELECT frame, unit, {_r('mean_abs_z=s / 4')} FROM z WHERE s / 4 > 1.5""")
def mean_abs_z(spark, sf_dir):
    return rnd(score.mean_abs_z(obs_l(spark, sf_dir), ["unit"], L_FEATURES, 1.5).select("frame", "unit", "mean_abs_z"))


_PAIR = OBS_L + """, fr AS (SELECT frame_a, frame_b FROM (SELECT lag(frame) OVER (ORDER BY frame) AS frame_a, frame AS frame_b FROM (SELECT DISTINCT frame FROM obs)) WHERE frame_a IS NOT NULL),
    un AS (SELECT frame_a, frame_b, obs.* FROM fr JOIN obs ON frame IN (frame_a, frame_b)), sd AS (SELECT frame_a, frame_b, """ + ", ".join(f"stddev_pop({f}) AS s_{f}" for f in L_FEATURES) + """ FROM un GROUP BY 1, 2),
    df AS (SELECT frame_a, frame_b, a.unit, """ + ", ".join(f"CASE WHEN s_{f} > 1e-12 THEN (b.{f} - a.{f}) / s_{f} ELSE 0 END AS d_{f}" for f in L_FEATURES) + """ FROM sd JOIN obs a ON a.frame = frame_a JOIN obs b ON b.frame = frame_b AND b.unit = a.unit)"""
_DISTANCE = "sqrt(" + " + ".join(f"d_{f} * d_{f}" for f in L_FEATURES) + ")"


def _pair_diffs(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    return score.frame_pair_diff(obs, score.consecutive_pairs(obs, "frame", F.substring("frame", 1, 4)), "frame", "unit", L_FEATURES)


@query(f"WITH {_PAIR} SELECT frame_a, frame_b, unit, {_r(f'distance={_DISTANCE}', *(f'd_{f}' for f in L_FEATURES))} FROM df")
def frame_pair_diff(spark, sf_dir):
    return rnd(_pair_diffs(spark, sf_dir))


@query(f"""WITH {_PAIR}, t AS (SELECT *, round({_DISTANCE}, 6) AS distance FROM df), p AS (SELECT *, row_number() OVER (PARTITION BY frame_a, frame_b ORDER BY distance DESC, unit) AS position FROM t),
    r AS (SELECT *, list_sort([{', '.join(f"{{'s': -abs(d_{f}), 'f': '{f}', 'd': d_{f}}}" for f in L_FEATURES)}])[1:3] AS three FROM p WHERE position <= 10)
    SELECT frame_a, frame_b, unit, position::INTEGER AS position, {_r('distance')}, array_to_string([printf('%s=%+.2f', x.f, x.d) FOR x IN three], '; ') AS reasons FROM r""")
def pair_top_units(spark, sf_dir):
    return rnd(score.pair_report(_pair_diffs(spark, sf_dir).withColumn("distance", F.round("distance", 6)), "unit", L_FEATURES))


# Ranking and history.

_RANK = _COMP + """, cm AS (SELECT frame, median(composite) AS m, count(composite) AS k FROM comp GROUP BY frame), cd AS (SELECT frame, any_value(m) AS m, any_value(k) AS k, 1.4826 * median(abs(composite - m)) AS d FROM comp JOIN cm USING (frame) GROUP BY frame),
    fr AS (SELECT frame, unit, composite, floor(rank() OVER (PARTITION BY frame ORDER BY composite DESC) + (count(*) OVER (PARTITION BY frame, composite) - 1) / 2.0)::INTEGER AS rank,
           CASE WHEN k >= 2 THEN CASE WHEN d <= 1e-10 THEN 0 ELSE (composite - m) / d END END AS z FROM comp JOIN cd USING (frame)),
    h AS (SELECT frame, unit, rank, row_number() OVER (PARTITION BY unit ORDER BY frame) AS frame_idx, row_number() OVER (PARTITION BY unit ORDER BY frame DESC) AS from_end, count(*) OVER (PARTITION BY unit) AS n_frames FROM fr),
    ff AS (SELECT frame, row_number() OVER (ORDER BY frame) AS frame_no, count(*) OVER () AS n_all FROM (SELECT DISTINCT frame FROM fr)),
    hb AS (SELECT h.*, least(n_all, greatest(10, floor(n_all * 0.3)))::INTEGER AS n_base, frame_no > least(n_all, greatest(10, floor(n_all * 0.3))) AS recent FROM h JOIN ff USING (frame)),
    rb AS (SELECT unit, median(rank) AS base_rank, greatest(stddev_pop(rank), 5.0) AS base_std, max(n_base) AS n_base, max(n_frames) AS n_frames FROM hb WHERE NOT recent GROUP BY unit)"""


def _ranks(spark, sf_dir):
    return temporal.frame_rank(obs_l(spark, sf_dir), "frame", "unit", L_FEATURES, L_LOWER, digits=6)


def _history(spark, sf_dir):
    return temporal.with_counts(temporal.history(_ranks(spark, sf_dir), "frame", "unit"), "unit", "frame")


@query(f"WITH {_COMP} SELECT frame, unit, {_r('composite')} FROM comp")
def composite_score(spark, sf_dir):
    return rnd(temporal.composite_score(obs_l(spark, sf_dir), "frame", L_FEATURES, L_LOWER).select("frame", "unit", F.round("composite", 6).alias("composite")))


@query(f"WITH {_RANK} SELECT frame, unit, {_r('composite', 'z')}, rank FROM fr")
def frame_rank(spark, sf_dir):
    return rnd(_ranks(spark, sf_dir))


@query(f"WITH {_RANK} SELECT unit, base_rank, {_r('base_std')}, n_base, n_frames FROM rb")
def rank_baseline(spark, sf_dir):
    return rnd(temporal.rank_baseline(_history(spark, sf_dir), "unit"))


_DROP = _RANK + """, rk AS (SELECT unit, frame_idx, from_end, rank FROM hb WHERE recent), en AS (SELECT unit, count(*) AS n_recent FROM rk GROUP BY unit HAVING count(*) >= 2),
    dr AS (SELECT unit, recent_rank, base_rank, (recent_rank - base_rank) / base_std AS drop, n_recent < 5 AS thin
    FROM rb JOIN (SELECT unit, median(rank) AS recent_rank FROM rk WHERE from_end <= 5 GROUP BY unit) USING (unit) JOIN en USING (unit)),
    tn AS (SELECT unit, count(*) AS n, regr_slope(rank, frame_idx) AS slope FROM rk JOIN en USING (unit) WHERE from_end <= 5 GROUP BY unit HAVING count(*) >= 5),
    nu AS (SELECT count(DISTINCT unit) AS n FROM fr),
    bd AS (SELECT unit, frame_idx, rank > 0.9 * (SELECT n FROM nu) AS bad FROM rk JOIN en USING (unit)),
    isl AS (SELECT unit, bad, frame_idx - row_number() OVER (PARTITION BY unit, bad ORDER BY frame_idx) AS island FROM bd),
    rn AS (SELECT unit, bad, island, count(*) AS n FROM isl GROUP BY 1, 2, 3),
    ru AS (SELECT unit, max(CASE WHEN bad THEN n ELSE 0 END) AS longest_run, sum(n)::BIGINT AS n_frames, 100.0 * sum(CASE WHEN bad THEN n ELSE 0 END) / sum(n) AS pct_bad FROM rn GROUP BY unit)"""


@query(f"WITH {_DROP} SELECT unit, recent_rank, base_rank, {_r('drop')}, thin FROM dr")
def rank_drop(spark, sf_dir):
    return rnd(temporal.rank_drop(_history(spark, sf_dir), "unit", warn=True).select("unit", "recent_rank", "base_rank", "drop", "thin"))


@query(f"WITH {_DROP} SELECT unit, n, {_r('slope')} FROM tn WHERE slope > 2")
def rank_trend(spark, sf_dir):
    return rnd(temporal.rank_trend(_history(spark, sf_dir), "unit"))


def _n_units(hist):
    return hist.select("unit").distinct().agg(F.count("*").alias("_units"))


def _runs(hist, least):
    return temporal.bottom_runs(hist.join(F.broadcast(_n_units(hist))), "unit", F.col("_units"), least=least)


@query(f"WITH {_DROP} SELECT unit, longest_run, n_frames, {_r('pct_bad')} FROM ru WHERE longest_run >= 1")
def bottom_runs(spark, sf_dir):
    return rnd(_runs(_history(spark, sf_dir), 1))


_REPORT = _DROP + """, sig AS (SELECT 'rank_drop' AS signal, unit, round(drop, 6) AS severity FROM dr WHERE drop > 1 UNION ALL SELECT 'trend', unit, round(slope, 6) FROM tn WHERE slope > 2 UNION ALL SELECT 'persistent', unit, longest_run::DOUBLE FROM ru WHERE longest_run >= 2),
    rp AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY severity DESC, unit)::INTEGER AS position FROM sig)"""


def _signals(hist):
    signals = temporal.unit_signals(hist.join(F.broadcast(_n_units(hist))), "unit", F.col("_units"))
    return temporal.signal_report(signals.withColumns({c: F.round(c, 6) for c in ("drop", "slope")}), "unit", drop=1.0, run=2, top=None)


@query(f"WITH {_REPORT} SELECT signal, unit, {_r('severity')}, position FROM rp WHERE position <= 10")
def degradation_report(spark, sf_dir):
    return rnd(_signals(_history(spark, sf_dir)).where("position <= 10"))


@query(f"WITH {_REPORT} SELECT unit, count(DISTINCT signal) AS n_signals FROM rp GROUP BY unit")
def flagged_units(spark, sf_dir):
    return temporal.flagged_units(_signals(_history(spark, sf_dir)), "unit")


@query(f"""WITH {_RANK}, l AS (SELECT * FROM fr WHERE frame = (SELECT max(frame) FROM fr)),
    b AS (SELECT 'best' AS side, row_number() OVER (ORDER BY rank, unit)::INTEGER AS position, frame, unit, rank, composite FROM l UNION ALL SELECT 'worst', row_number() OVER (ORDER BY rank DESC, unit)::INTEGER, frame, unit, rank, composite FROM l)
    SELECT side, position, frame, unit, rank, {_r('composite')} FROM b WHERE position <= 5""")
def frame_summary(spark, sf_dir):
    return rnd(temporal.frame_summary(_ranks(spark, sf_dir), "frame", "unit"))


@query(f"""WITH {_REPORT}, rc AS (SELECT unit, median(rank) AS recent_rank FROM hb WHERE from_end <= 5 GROUP BY unit)
    SELECT unit, base_rank, recent_rank, unit IN (SELECT unit FROM rp) AS flagged FROM rb JOIN rc USING (unit)""")
def degradation_scatter(spark, sf_dir):
    hist = _history(spark, sf_dir)
    return temporal.degradation_scatter(hist, temporal.flagged_units(_signals(hist), "unit"), "unit")


@query(f"WITH {_RANK} SELECT unit, frame_idx::INTEGER AS frame_idx, rank, median(rank) OVER (PARTITION BY unit) AS median_rank FROM hb")
def rank_matrix(spark, sf_dir):
    return temporal.rank_rows(_history(spark, sf_dir), "unit")


@query(f"WITH {OBS_L} SELECT frame, unit, 'price' AS feature, {_r('value=price')} FROM obs")
def feature_series(spark, sf_dir):
    return rnd(temporal.feature_series(obs_l(spark, sf_dir), "frame", "unit", "price"))


@query(f"""WITH hh AS (SELECT (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 3.6e9 AS hours, value FROM events)
    SELECT 'value' AS feature, {_r('slope_per_day=24 * regr_slope(value, hours)', 'intercept=regr_intercept(value, hours)', 'r2=regr_r2(value, hours)', digits=6)}, regr_count(value, hours)::BIGINT AS n, sqrt(regr_r2(value, hours) / (1 - regr_r2(value, hours)) * (regr_count(value, hours) - 2)) > 1.96 + 2.4 / regr_count(value, hours) AS significant FROM hh""")
def drift_regression(spark, sf_dir):
    return rnd(temporal.drift_regression(read(spark, sf_dir, "events"), "ts", ["value"]).drop("p_value"), 6)


# Detection quality.


@query(f"""WITH {SUSPECTS}, p AS (SELECT frame, unit FROM sc WHERE score > 3000), j AS (SELECT coalesce(p.frame, t.frame) AS frame, p.unit AS a, t.unit AS b FROM p FULL JOIN tr t ON p.frame = t.frame AND p.unit = t.unit),
    c AS (SELECT frame, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (WHERE b IS NULL) AS fp, count(*) FILTER (WHERE a IS NULL) AS fn FROM j GROUP BY frame),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
    SELECT frame, tp, fp, fn, {_r("precision", "recall", "f1=CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END", "iou=CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END")} FROM r""")
def detection_metrics(spark, sf_dir):
    scored, truth = suspects(spark, sf_dir)
    return rnd(metrics.detection_metrics(scored.where("score > 3000"), truth, ["frame", "unit"], ["frame"]))


@query(f"""WITH {SUSPECTS}, p AS (SELECT frame, unit FROM sc WHERE score > 3000 AND frame IN (SELECT frame FROM tr)), c AS (SELECT count(*) FILTER (WHERE p.unit IS NOT NULL AND t.unit IS NOT NULL) AS tp, count(*) FILTER (WHERE t.unit IS NULL) AS fp,
    count(*) FILTER (WHERE p.unit IS NULL) AS fn FROM p FULL JOIN tr t ON p.unit = t.unit), r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
    SELECT tp, fp, fn, {_r("precision", "recall", "f1=2 * precision * recall / (precision + recall)", "iou=tp / (tp + fp + fn)")} FROM r""")
def micro_metrics(spark, sf_dir):
    scored, truth = suspects(spark, sf_dir)
    return rnd(metrics.micro_metrics(scored.where("score > 3000"), truth, scored, "frame", "unit"))


@query(f"""WITH {SUSPECTS}, r AS (SELECT sc.frame, sc.unit, row_number() OVER (PARTITION BY sc.frame ORDER BY score DESC, sc.unit) AS pos, (tr.unit IS NOT NULL)::INTEGER AS hit FROM sc LEFT JOIN tr ON sc.unit = tr.unit),
    c AS (SELECT *, sum(hit) OVER (PARTITION BY frame ORDER BY pos) AS cum FROM r) SELECT frame, sum(hit)::BIGINT AS n_truth, {_r('ap=sum(hit * cum / pos) / sum(hit)')} FROM c GROUP BY frame HAVING sum(hit) > 0""")
def avg_precision(spark, sf_dir):
    scored, truth = suspects(spark, sf_dir)
    return rnd(metrics.average_precision(scored, truth, ["frame", "unit"], "score", ["frame"]))


@query(f"""WITH {SUSPECTS}, r AS (SELECT sc.frame, sc.unit, row_number() OVER (PARTITION BY sc.frame ORDER BY score DESC, sc.unit) AS pos, (tr.unit IS NOT NULL)::INTEGER AS hit FROM sc LEFT JOIN tr ON sc.unit = tr.unit)
    SELECT frame, sum(hit)::BIGINT AS n_truth, sum(CASE WHEN pos <= 20 THEN hit ELSE 0 END)::BIGINT AS n_found, {_r('recall=sum(CASE WHEN pos <= 20 THEN hit ELSE 0 END) / sum(hit)')} FROM r GROUP BY frame HAVING sum(hit) > 0""")
def recall_at_k(spark, sf_dir):
    scored, truth = suspects(spark, sf_dir)
    return rnd(metrics.recall_at_k(scored, truth, ["frame", "unit"], "score", ["frame"], 20))


@query(f"WITH {OBS_L}, r AS (SELECT frame, unit, price, row_number() OVER (PARTITION BY frame ORDER BY price DESC, unit)::INTEGER AS position FROM obs) SELECT frame, unit, {_r('price')}, position FROM r WHERE position <= 5")
def top_suspects(spark, sf_dir):
    return rnd(metrics.top_suspects(obs_l(spark, sf_dir).select("frame", "unit", "price"), ["frame"], ["unit"], "price", 5))


@query(f"""WITH {_EARLY}, tu AS (SELECT frame, unit FROM obs WHERE frame >= '1997-01' AND price > 45000), f AS (SELECT DISTINCT feature, frame, unit FROM o),
    c AS (SELECT feature, count(t.unit) AS tp, count(*) FILTER (WHERE t.unit IS NULL) AS fp, (SELECT count(*) FROM tu) - count(t.unit) AS fn FROM f LEFT JOIN tu t ON f.frame = t.frame AND f.unit = t.unit GROUP BY feature),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
    SELECT feature, tp, fp, fn, {_r("precision", "recall", "f1=CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END", "iou=CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END")} FROM r""")
def detector_metrics(spark, sf_dir):
    truth = obs_l(spark, sf_dir).where("frame >= '1997-01' and price > 45000").select("frame", "unit")
    return rnd(metrics.detector_metrics(_new_outliers(spark, sf_dir), truth, ["frame", "unit"]))


# Selection, times, completeness.


@query("SELECT event_id, 'IRCamM1T' || strftime(ts, '%Y%m%d_%H%M%S') || 'M.jpg' AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken, strftime(ts, '%d/%m %H:%M') AS label FROM events")
def parse_frame_time(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/a/"), times.camera_name("ts")).alias("path"))
    ts = times.frame_time("path")
    return rows.select("event_id", times.base_name("path").alias("name"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("taken"), times.time_label(ts).alias("label"))


@query("SELECT event_id FROM events WHERE hour(ts) >= 7 AND hour(ts) < 10")
def morning_frames(spark, sf_dir):
    return selection.hours_between(read(spark, sf_dir, "events"), "ts").select("event_id")


@query("SELECT event_id FROM events WHERE 'IRCamM1T' || strftime(ts, '%Y%m%d_%H%M%S') || 'M.jpg' GLOB '*2024011*_12*M.jpg'")
def name_like(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("name", times.camera_name("ts"))
    return selection.name_like(rows, "name", "*2024011*_12*M.jpg").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS k FROM events) WHERE k % 7 = 0")
def nth_frame(spark, sf_dir):
    return selection.every_nth(read(spark, sf_dir, "events"), 7, F.date_format("ts", "yyyy-MM-dd"), "event_id").select("event_id")


@query(f"""WITH {OBS_E}, n AS (SELECT count(DISTINCT user_id) AS n_expected FROM events)
    SELECT frame, n_expected, count(DISTINCT unit) AS n_present, count(*) FILTER (WHERE avg_value IS NULL) AS n_null, {_r('pct=100.0 * count(DISTINCT unit) / any_value(n_expected)')} FROM obs, n GROUP BY frame, n_expected""")
def completeness(spark, sf_dir):
    obs = obs_e(spark, sf_dir)
    return rnd(selection.completeness(obs, obs, obs, "frame", "unit", "avg_value"))


@query(f"WITH {OBS_E}, g AS (SELECT * FROM (SELECT DISTINCT frame FROM obs), (SELECT DISTINCT unit FROM obs)) SELECT frame, unit FROM g EXCEPT SELECT frame, unit FROM obs")
def missing_cells(spark, sf_dir):
    obs = obs_e(spark, sf_dir)
    return selection.missing_cells(obs, obs, obs, "frame", "unit")


@query(f"WITH {OBS_E}, b AS (SELECT DISTINCT frame FROM obs WHERE right(frame, 2)::INTEGER % 7 = 0) SELECT frame, unit, {_r('avg_value')} FROM obs WHERE frame NOT IN (SELECT frame FROM b)")
def exclude_frames(spark, sf_dir):
    obs = obs_e(spark, sf_dir)
    bad = obs.select("frame").distinct().where(F.substring("frame", 9, 2).cast("int") % 7 == 0)
    return rnd(selection.select_features(selection.exclude_frames(obs, bad, "frame"), ["frame", "unit"], E_FEATURES, ["avg_value"]))


@query(f"WITH {OBS_E} SELECT frame, unit, 'avg_value' AS feature, {_r('value=avg_value')} FROM obs UNION ALL SELECT frame, unit, 'max_value', {_r('value=max_value')} FROM obs UNION ALL SELECT frame, unit, 'n', {_r('value=n')} FROM obs")
def obs_long(spark, sf_dir):
    return rnd(selection.observation_rows(obs_e(spark, sf_dir), ["frame", "unit"], E_FEATURES))


@query("SELECT vec_id AS frame, (k // 4)::INTEGER AS mirror_id, " + ", ".join(f"round(embedding[4 * (k // 4) + {i + 1}]::DOUBLE + 1e-10, 5) + 0.0 AS f{i}" for i in range(4)) + " FROM embeddings, (SELECT unnest(range(0, 64, 4)) AS k)")
def tensor_rows(spark, sf_dir):
    cells, names = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda m: F.slice(F.col("embedding"), m * 4 + 1, F.lit(4))), [f"f{i}" for i in range(4)]
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), cells.alias("cells"))
    out = selection.flatten(rows, "frame", "cells", names)
    return rnd(out.withColumns({f: F.col(f).cast("double") for f in names}), 5)


@query("SELECT event_type, count(*) AS n, avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS mean_k FROM events GROUP BY event_type")
def props_json(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("p.k").alias("mean_k"))


# Patches.


@query(f"""WITH {PIXELS}, m AS (SELECT patch, median(v) AS med FROM px GROUP BY patch), a AS (SELECT patch, count(*) AS n, any_value(med) AS median, stddev_pop(v) / (avg(v) + 1e-8) AS cov, 1.4826 * median(abs(v - med)) / (any_value(med) + 1e-8) AS robust_cov,
    (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / (any_value(med) + 1e-8) AS iqr_norm, (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / (any_value(med) + 1e-8) AS rng_norm, avg((v >= 250)::INTEGER) AS sat_frac FROM px JOIN m USING (patch) GROUP BY patch)
    SELECT patch, n, {_r('median', 'cov', 'robust_cov', 'iqr_norm', 'rng_norm', 'sat_frac')} FROM a""")
def patch_photometric(spark, sf_dir):
    return rnd(patches.photometric(pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS}, s AS (SELECT patch, avg(v) AS m, stddev_pop(v) AS s, min(v) AS min, max(v) AS max FROM px GROUP BY patch)
    SELECT patch, {_r("mean=any_value(m)", "std=any_value(s)", "skew=avg((v - m) * (v - m) * (v - m)) / (any_value(s) ** 3)", "kurt=avg((v - m) * (v - m) * (v - m) * (v - m)) / (any_value(s) ** 4) - 3")}, any_value(min) AS min, any_value(max) AS max FROM px JOIN s USING (patch) GROUP BY patch""")
def patch_moments(spark, sf_dir):
    return rnd(patches.moments(pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS}, c AS (SELECT patch, floor(v * 32 / 256) AS b, count(*) AS n FROM px GROUP BY 1, 2), e AS (SELECT patch, -sum(n / 64.0 * log2(n / 64.0)) AS entropy FROM c GROUP BY patch)
    SELECT patch, {_r('entropy=any_value(entropy)', 'p75=quantile_cont(v, 0.75)', 'bright=avg((v > 200)::INTEGER)', 'dark=avg((v < 50)::INTEGER)')} FROM px JOIN e USING (patch) GROUP BY patch""")
def patch_hist_entropy(spark, sf_dir):
    return rnd(patches.histogram_entropy(pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS}, s AS (SELECT patch, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY patch)
    SELECT patch, y, x, v, round((v - lo) * 255.0 / (hi - lo)) + 0.0 AS stretched, {_r('standard=(v - m) / s')} FROM px JOIN s USING (patch)""")
def patch_minmax(spark, sf_dir):
    return rnd(patches.min_max(pixels(spark, sf_dir)))


@query(f"WITH {PIXELS} SELECT label, y, x, {_r('mean=avg(v)', 'median=median(v)')}, count(*) AS n FROM px JOIN embeddings ON patch = vec_id GROUP BY label, y, x")
def mean_patch(spark, sf_dir):
    px = pixels(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch"), "label"), "patch")
    return rnd(patches.mean_patch(px, "label"))


def _sql_kernel(kernel, alias):
    return " + ".join(f"({w}) * a_{dy + 1}_{dx + 1}" for (dy, dx), w in sorted(kernel.items())) + f" AS {alias}"


_NEAR = PIXELS + ", nb AS (SELECT c.patch, c.y, c.x, c.v, " + ", ".join(f"max(CASE WHEN n.y = c.y + ({dy}) AND n.x = c.x + ({dx}) THEN n.v END) AS a_{dy + 1}_{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + """
    FROM px c JOIN px n ON n.patch = c.patch AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_NEAR}, g AS (SELECT patch, {_sql_kernel(patches.SOBEL_X, 'gx')}, {_sql_kernel(patches.SOBEL_Y, 'gy')}, {_sql_kernel(patches.LAPLACE, 'lap')} FROM nb)
    SELECT patch, {_r('sobel_mean=avg(sqrt(gx * gx + gy * gy))', 'laplacian_mean=avg(abs(lap))', 'laplacian_std=stddev_pop(abs(lap))')} FROM g GROUP BY patch""")
def patch_edges(spark, sf_dir):
    return rnd(patches.edges(pixels(spark, sf_dir)))


_GLCM = PIXELS + """, q AS (SELECT patch, y, x, floor(v * 16 / 256)::INTEGER AS i FROM px), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) t(angle, dy, dx)),
    pr AS (SELECT a.patch, angle, a.i, b.i AS j FROM q a, o, q b WHERE b.patch = a.patch AND b.y = a.y + dy AND b.x = a.x + dx), sy AS (SELECT * FROM pr UNION ALL SELECT patch, angle, j, i FROM pr),
    ct AS (SELECT patch, angle, i, j, count(*) AS n FROM sy GROUP BY 1, 2, 3, 4), sh AS (SELECT patch, angle, i, j, n / sum(n) OVER (PARTITION BY patch, angle) AS p FROM ct),
    mm AS (SELECT patch, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * i) AS mi, sum(p * j) AS mj, sum(p * i * i) AS ii, sum(p * j * j) AS jj, sum(p * i * j) AS ij FROM sh GROUP BY 1, 2),
    cc AS (SELECT *, CASE WHEN ii - mi * mi > 1e-12 AND jj - mj * mj > 1e-12 THEN (ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)) ELSE 1 END AS correlation FROM mm)"""


@query(f"WITH {_GLCM} SELECT patch, {_r('contrast=avg(contrast)', 'dissimilarity=avg(dissimilarity)', 'homogeneity=avg(homogeneity)', 'energy=avg(energy)', 'correlation=avg(correlation)')} FROM cc GROUP BY patch")
def patch_glcm(spark, sf_dir):
    return rnd(patches.glcm_features(patches.glcm(pixels(spark, sf_dir))))


@query(f"WITH {PIXELS}, s AS (SELECT patch, least(4, x // 1) AS segment, avg(v) AS mean FROM px WHERE y < 2 GROUP BY 1, 2) SELECT patch, {_r('sun_score=max(mean) - median(mean)')} FROM s GROUP BY patch")
def patch_sun(spark, sf_dir):
    return rnd(patches.sun_score(pixels(spark, sf_dir), 8))


def _sql_lbp():
    ks = patches.lbp_kernels()
    cols = ", ".join(_sql_kernel(k, n) for n, k in ks.items())
    bits = [f"(n{p} >= -1e-9)::INTEGER" for p in range(8)]
    turns = " + ".join(f"abs({bits[p]} - {bits[p - 1]})" for p in range(8))
    return f"""WITH {_NEAR}, k AS (SELECT patch, {cols} FROM nb), c AS (SELECT patch, CASE WHEN {turns} <= 2 THEN {' + '.join(bits)} ELSE 9 END AS code FROM k), h AS (SELECT patch, code, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT patch, sum(n)::BIGINT AS places, {_r('lbp_entropy=log2(sum(n)) - sum(n * log2(n)) / sum(n)', 'lbp_uniformity=max(n) / sum(n)', 'lbp_nonuniform=sum(CASE WHEN code = 9 THEN n ELSE 0 END) / sum(n)')} FROM h GROUP BY patch"""


@query(_sql_lbp())
def patch_lbp(spark, sf_dir):
    return rnd(patches.lbp_features(pixels(spark, sf_dir)))


@query(f"""WITH {_NEAR}, g AS (SELECT patch, y, x, a_1_2 - a_1_0 AS gx, a_2_1 - a_0_1 AS gy FROM nb),
    t AS (SELECT patch, y // 4 AS cell_y, x // 4 AS cell_x, sqrt(gx * gx + gy * gy) AS mag, ((degrees(atan2(gy::DOUBLE, gx::DOUBLE)) % 180) + 180) % 180 AS turn FROM g),
    s AS (SELECT patch, cell_y, cell_x, (floor(round(turn / 20, 9)) % 9)::INTEGER AS bin, sum(mag) AS w FROM t GROUP BY 1, 2, 3, 4)
    SELECT patch, cell_y::BIGINT AS cell_y, cell_x::BIGINT AS cell_x, bin, {_r('value=w / (sqrt(sum(w * w) OVER (PARTITION BY patch)) + 1e-12)')} FROM s""")
def patch_hog(spark, sf_dir):
    return rnd(patches.hog(pixels(spark, sf_dir)))


_NCC = """b AS (SELECT label, vec_id, embedding FROM embeddings), e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS k FROM b), m AS (SELECT vec_id, avg(e) AS m FROM e GROUP BY vec_id),
    c AS (SELECT label, vec_id, k, e - m AS c FROM e JOIN m USING (vec_id)), n AS (SELECT vec_id, sqrt(sum(c * c)) AS n FROM c GROUP BY vec_id), s AS (SELECT label, vec_id, k, c / n AS s FROM c JOIN n USING (vec_id) WHERE n > 1e-6),
    f AS (SELECT vec_id FROM b WHERE vec_id < (SELECT min(vec_id) + 0.1 * (max(vec_id) - min(vec_id) + 1) FROM b)),
    p AS (SELECT x.label, x.vec_id, y.vec_id AS bank, sum(x.s * y.s) AS ncc FROM s x JOIN s y ON x.label = y.label AND x.k = y.k AND x.vec_id <> y.vec_id WHERE y.vec_id IN (SELECT vec_id FROM f) GROUP BY 1, 2, 3)"""


@query(f"WITH {_NCC} SELECT label, vec_id, {_r('max_ncc=max(ncc)', 'median_ncc=median(ncc)', 'residual_rms=sqrt(greatest(2 - 2 * max(ncc), 0) / 64)')}, max_by(bank, ncc) AS best_key FROM p GROUP BY label, vec_id")
def ncc_bank(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    # The bank is all patches of the baseline period, the first tenth of the ids; a frame's patches meet those of their own unit.
    period = rows.agg((F.min("vec_id") + 0.1 * (F.max("vec_id") - F.min("vec_id") + 1)).alias("end"))
    bank = rows.join(F.broadcast(period), F.col("vec_id") < F.col("end")).drop("end")
    return rnd(patches.best_match(rows, bank, "label", "vec_id", "embedding"))


# Colour, and families of features.


def _moments(c: str, prefix: str) -> list[str]:
    m, sd = f"avg({c})", f"stddev_pop({c})"
    powers = [f"avg({c}::DOUBLE ** {k})" for k in (2, 3, 4)]
    third = f"({powers[1]} - 3 * {m} * {powers[0]} + 2 * {m} ** 3)"
    fourth = f"({powers[2]} - 4 * {m} * {powers[1]} + 6 * {m} ** 2 * {powers[0]} - 3 * {m} ** 4)"
    return [f"{prefix}mean={m}", f"{prefix}std={sd}", f"{prefix}skew={third} / {sd} ** 3", f"{prefix}kurt={fourth} / {sd} ** 4 - 3"]


@query(f"""WITH {COLOURS}, a AS (SELECT patch, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(h) AS hm, stddev_pop(h) AS hd, avg(s) AS sm, stddev_pop(s) AS sd, avg(val) AS vm, stddev_pop(val) AS vd, 1 - 1 / (1 + var_pop(v)) AS smoothness FROM hs GROUP BY patch),
    n AS (SELECT patch, floor(h * 16 / 180)::INTEGER AS bin, count(*) AS n FROM hs GROUP BY 1, 2), e AS (SELECT patch, -sum(n / (64 + 1e-6) * log2(n / (64 + 1e-6) + 1e-6)) AS hue_entropy, arg_max(bin, n * 100 - bin) AS hue_peak FROM n GROUP BY patch),
    w AS (SELECT patch, v, count(*) AS n FROM hs GROUP BY 1, 2), u AS (SELECT patch, sum((n / (64 + 1e-6)) ** 2) AS uniformity FROM w GROUP BY patch)
    SELECT patch, {_r('r_ratio=r / (r + g + b)', 'g_ratio=g / (r + g + b)', 'b_ratio=b / (r + g + b)', 'rg_ratio=r / (g + 1e-6)', 'rb_ratio=r / (b + 1e-6)', 'gb_ratio=g / (b + 1e-6)', 'hue_mean=hm', 'hue_std=hd', 'sat_mean=sm', 'sat_std=sd', 'val_mean=vm', 'val_std=vd', 'hue_entropy', 'uniformity', 'smoothness')}, hue_peak
    FROM a JOIN e USING (patch) JOIN u USING (patch)""")
def patch_colour_ratios(spark, sf_dir):
    return rnd(colour.colour_ratios(colours(spark, sf_dir)))


def _sql_glcm(levels: int, distance: int, symmetric: bool, angles: int, tag: str) -> str:
    """CTE ``cc<tag>`` with the measures of each patch and angle; needs ``px``."""
    at = [(0, 1), (-1, 1), (-1, 0), (-1, -1)][:angles]
    rows = ", ".join(f"({k}, {dy * distance}, {dx * distance})" for k, (dy, dx) in enumerate(at))
    both = f"SELECT * FROM pr{tag}" + (f" UNION ALL SELECT patch, angle, j, i FROM pr{tag}" if symmetric else "")
    return f"""q{tag} AS (SELECT patch, y, x, floor(v * {levels} / 256)::INTEGER AS i FROM px), o{tag} AS (SELECT * FROM (VALUES {rows}) t(angle, dy, dx)),
    pr{tag} AS (SELECT a.patch, angle, a.i, b.i AS j FROM q{tag} a, o{tag} o, q{tag} b WHERE b.patch = a.patch AND b.y = a.y + dy AND b.x = a.x + dx), sy{tag} AS ({both}),
    ct{tag} AS (SELECT patch, angle, i, j, count(*) AS n FROM sy{tag} GROUP BY 1, 2, 3, 4), sh{tag} AS (SELECT patch, angle, i, j, n / sum(n) OVER (PARTITION BY patch, angle) AS p FROM ct{tag}),
    mm{tag} AS (SELECT patch, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * i) AS mi, sum(p * j) AS mj, sum(p * i * i) AS ii, sum(p * j * j) AS jj, sum(p * i * j) AS ij FROM sh{tag} GROUP BY 1, 2),
    cc{tag} AS (SELECT *, CASE WHEN ii - mi * mi > 1e-12 AND jj - mj * mj > 1e-12 THEN (ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)) ELSE 1 END AS correlation FROM mm{tag})"""


def _sql_near(radius: int) -> str:
    """CTE ``nb<radius>``: every place with its square of neighbours; needs ``px``."""
    span = range(-radius, radius + 1)
    cells = ", ".join(f"max(CASE WHEN n.y = c.y + ({dy}) AND n.x = c.x + ({dx}) THEN n.v END) AS a_{dy + radius}_{dx + radius}" for dy in span for dx in span)
    inner = f"BETWEEN {radius} AND {7 - radius}"
    return f"nb{radius} AS (SELECT c.patch, c.y, c.x, c.v, {cells} FROM px c JOIN px n ON n.patch = c.patch AND abs(n.y - c.y) <= {radius} AND abs(n.x - c.x) <= {radius} WHERE c.y {inner} AND c.x {inner} GROUP BY 1, 2, 3, 4)"


def _sql_codes(points: int, radius: int) -> str:
    """CTE ``hc<radius>``: counts of patterns; needs ``nb<radius>``."""
    cols = ", ".join(" + ".join(f"({w})::DOUBLE * a_{dy + radius}_{dx + radius}" for (dy, dx), w in sorted(k.items())) + f" AS {n}" for n, k in patches.lbp_kernels(points, float(radius)).items())
    bits = [f"(n{p} >= -1e-9)::INTEGER" for p in range(points)]
    turns = " + ".join(f"abs({bits[p]} - {bits[p - 1]})" for p in range(points))
    return f"k{radius} AS (SELECT patch, {cols} FROM nb{radius}), cd{radius} AS (SELECT patch, CASE WHEN {turns} <= 2 THEN {' + '.join(bits)} ELSE {points + 1} END AS code FROM k{radius}), hc{radius} AS (SELECT patch, code, count(*) AS n FROM cd{radius} GROUP BY 1, 2)"


_GRAD = f"gr AS (SELECT patch, {_sql_kernel(patches.SOBEL_X, 'gx')}, {_sql_kernel(patches.SOBEL_Y, 'gy')}, {_sql_kernel(patches.LAPLACE, 'lap')}, (v > a_1_2 AND v > a_1_0 AND v > a_2_1 AND v > a_0_1)::INTEGER AS peak FROM nb1)"
_FIVE = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")


@query(f"WITH {PIXELS}, {_sql_glcm(256, 1, False, 4, '')} SELECT patch, {_r(*(f'{c}=avg({c})' for c in _FIVE))} FROM cc GROUP BY patch")
def patch_glcm_plain(spark, sf_dir):
    return rnd(patches.glcm_features(patches.glcm(pixels(spark, sf_dir), 256, symmetric=False)))


@query(f"""WITH {PIXELS}, {_sql_glcm(16, 1, True, 4, '')}, kept AS (SELECT * FROM sy WHERE i > 0 AND j > 0), n2 AS (SELECT patch, angle, i, j, count(*) AS n FROM kept GROUP BY 1, 2, 3, 4), s2 AS (SELECT *, n / sum(n) OVER (PARTITION BY patch, angle) AS p FROM n2),
    m2 AS (SELECT patch, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * i) AS mi, sum(p * j) AS mj, sum(p * i * i) AS ii, sum(p * j * j) AS jj, sum(p * i * j) AS ij FROM s2 GROUP BY 1, 2),
    g2 AS (SELECT *, CASE WHEN ii - mi * mi > 1e-12 AND jj - mj * mj > 1e-12 THEN (ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)) ELSE 1 END AS correlation FROM m2) SELECT patch, {_r(*(f"{c}=avg({c})" for c in _FIVE))} FROM g2 GROUP BY patch""")
def patch_glcm_masked(spark, sf_dir):
    return rnd(patches.glcm_features(patches.glcm(pixels(spark, sf_dir), drop_zero=True)))


@query(f"""WITH {PIXELS}, {_sql_near(1)}, {_sql_codes(8, 1)}, {_sql_glcm(256, 1, False, 1, '')}, l AS (SELECT patch, sum(n * code) / sum(n) AS lbp_mean, sqrt(greatest(sum(n * code * code) / sum(n) - (sum(n * code) / sum(n)) ** 2, 0)) AS lbp_std, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS lbp_entropy FROM hc1 GROUP BY patch)
    SELECT patch, {_r('lbp_mean', 'lbp_std', 'lbp_entropy', *_FIVE)} FROM l JOIN cc USING (patch)""")
def patch_ranking(spark, sf_dir):
    return rnd(patches.ranking(pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS}, {_sql_near(1)}, {_sql_codes(8, 1)}, {_GRAD}, {_sql_glcm(256, 1, True, 1, '')}, c AS (SELECT patch, v, count(*) AS n FROM px GROUP BY 1, 2), e AS (SELECT patch, -sum(n / 64.0 * log2(n / 64.0)) AS entropy FROM c GROUP BY patch),
    m AS (SELECT patch, avg(sqrt(gx * gx + gy * gy)) AS gradient_mean, stddev_pop(sqrt(gx * gx + gy * gy)) AS gradient_std FROM gr GROUP BY patch), d AS (SELECT patch, max(n) / sum(n) AS lbp_dominance FROM hc1 GROUP BY patch)
    SELECT patch, {_r('entropy', 'gradient_mean', 'gradient_std', 'homogeneity', 'correlation', 'contrast', 'lbp_dominance')} FROM e JOIN m USING (patch) JOIN d USING (patch) JOIN cc USING (patch)""")
def patch_degradation(spark, sf_dir):
    return rnd(patches.degradation(pixels(spark, sf_dir)))


@query(f"WITH {PIXELS} SELECT patch, {_r('mean=avg(v)', 'std=stddev_pop(v)', 'min=min(v)', 'max=max(v)', 'p25=quantile_cont(v, 0.25)', 'p75=quantile_cont(v, 0.75)', 'median=median(v)', 'range=max(v) - min(v)')} FROM px GROUP BY patch")
def patch_statistics(spark, sf_dir):
    return rnd(patches.statistics(pixels(spark, sf_dir)))


# Geometry, from a table's own rows: a row of facets per nation, its size from the customers there.


def _dish(spark, sf_dir):
    sizes = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count("*") % 20 + 5).alias("size"))
    return geometry.row_table_of(sizes, "c_nationkey", "size")


_DISH = """sz AS (SELECT c_nationkey AS row, count(*) % 20 + 5 AS size FROM customer GROUP BY 1), rt AS (SELECT row, size, coalesce(sum(size) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sz),
    ce AS (SELECT row, size, first, unnest(range(size)) AS col FROM rt)"""
_EDGES = _DISH + """, e1 AS (SELECT first + col AS a, first + col + 1 AS b FROM ce WHERE col + 1 < size UNION ALL
    SELECT c.first + c.col, n.first + c.col + s.d FROM ce c JOIN rt n ON n.row = c.row + 1, (SELECT unnest([-1, 0, 1]) AS d) s WHERE (CASE WHEN n.size < c.size THEN s.d IN (-1, 0) WHEN n.size > c.size THEN s.d IN (0, 1) ELSE s.d IN (-1, 0, 1) END) AND c.col + s.d BETWEEN 0 AND n.size - 1),
    ed AS (SELECT DISTINCT least(a, b)::INTEGER AS a, greatest(a, b)::INTEGER AS b FROM e1)"""


@query(f"WITH {_DISH} SELECT (first + col)::INTEGER AS mirror_id, row::INTEGER AS row, col::INTEGER AS col, {_r('x=col - (size - 1) / 2', 'y=row * sqrt(3.0) / 2')} FROM ce")
def hex_positions(spark, sf_dir):
    return rnd(geometry.hex_positions(_dish(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT a, b FROM ed")
def hex_edges(spark, sf_dir):
    return geometry.undirected(geometry.hex_edges(_dish(spark, sf_dir)))


@query(f"WITH {_EDGES}, tw AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed) SELECT a AS mirror_id, count(*) AS n_neighbours FROM tw GROUP BY a")
def neighbour_count(spark, sf_dir):
    return geometry.neighbour_count(geometry.hex_edges(_dish(spark, sf_dir)))


@query("""WITH r AS (SELECT s_nationkey AS row, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1), c AS (SELECT row, unnest(range(a, b + 1)) AS grid_id FROM r)
    SELECT (row_number() OVER (ORDER BY row, grid_id) - 1)::INTEGER AS mirror_id, row, grid_id FROM c""")
def grid_map(spark, sf_dir):
    r = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("row")).agg(F.min("s_suppkey").alias("grid_id_start"), F.max("s_suppkey").alias("grid_id_stop"))
    return geometry.grid_map(r)


# Frame rules, annotations, stored tables.


@query(f"""WITH {_NEAR}, g AS (SELECT patch, {_sql_kernel(patches.LAPLACE, 'lap')} FROM nb), l AS (SELECT patch, stddev_pop(lap) AS sharpness FROM g GROUP BY patch),
    q AS (SELECT patch, avg(v) AS mean_brightness, avg((v > 190)::INTEGER) AS bright_saturated_frac FROM px GROUP BY patch)
    SELECT patch, {_r('mean_brightness', 'bright_saturated_frac', 'sharpness', digits=6)} FROM q JOIN l USING (patch) WHERE round(mean_brightness, 6) > 100 AND round(bright_saturated_frac, 6) < 0.025 AND round(sharpness, 6) > 25""")
def good_frames(spark, sf_dir):
    px = pixels(spark, sf_dir)
    sharp = patches.convolve(px, {"lap": patches.LAPLACE}).groupBy("patch").agg(F.round(F.stddev_pop("lap"), 6).alias("sharpness"))
    light = px.groupBy("patch").agg(F.round(F.avg("v"), 6).alias("mean_brightness"), F.round(F.avg((F.col("v") > 190).cast("double")), 6).alias("bright_saturated_frac"))
    return rnd(selection.good_frames(light.join(sharp, "patch")), 6)


@query(f"""WITH {PIXELS}, m AS (SELECT patch, round(stddev_pop(v), 6) AS sat_mean, 100.0 * avg((v > 200)::INTEGER) AS overexposed_pct, 100.0 * avg((v BETWEEN 110 AND 140)::INTEGER) AS gray_pct, round(avg(v) / 381, 6) AS blue_ratio FROM px GROUP BY patch),
    r AS (SELECT patch, concat_ws('; ', CASE WHEN sat_mean < 30 THEN printf('low saturation (%.1f)', round(sat_mean + 1e-9, 1)) END, CASE WHEN overexposed_pct > 2 THEN printf('overexposed (%.1f%%)', round(overexposed_pct + 1e-9, 1)) END,
        CASE WHEN gray_pct > 45 THEN printf('gray sky (%.1f%%)', round(gray_pct + 1e-9, 1)) END, CASE WHEN blue_ratio < 0.33 THEN printf('little blue (%.2f)', round(blue_ratio + 1e-9, 2)) END) AS reasons FROM m)
    SELECT patch, reasons, CASE WHEN reasons = '' THEN 'GOOD' ELSE 'BAD' END AS verdict FROM r""")
def weather_verdict(spark, sf_dir):
    v = F.col("v")
    share = lambda c: 100 * F.avg(c.cast("double"))
    m = pixels(spark, sf_dir).groupBy("patch").agg(F.round(F.stddev_pop(v), 6).alias("sat_mean"), share(v > 200).alias("overexposed_pct"), share(v.between(110, 140)).alias("gray_pct"), F.round(F.avg(v) / 381, 6).alias("blue_ratio"))
    return selection.classify_weather(m, 30, 2, 45, 0.33).select("patch", "reasons", "verdict")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS file, array_to_string(list_sort(list(DISTINCT user_id % 249)), ',') AS marked FROM events WHERE event_type = 'error' GROUP BY 1""")
def annotation_lists(spark, sf_dir):
    marks = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), (F.col("user_id") % 249).alias("mirror_id"))
    return annotations.annotation_lists(marks).select("file", F.array_join(F.transform("marked_mirrors", lambda m: m.cast("string")), ",").alias("marked"))


@query(f"WITH {OBS_L} SELECT unit AS mirror_id, count(*) AS n_observations, count(DISTINCT frame) AS n_frames FROM obs GROUP BY ROLLUP (unit)")
def crop_info(spark, sf_dir):
    return store.crop_info(obs_l(spark, sf_dir).select(F.col("unit").alias("mirror_id"), F.col("frame").alias("frame_id")))


@query(f"WITH {OBS_L} SELECT unit AS mirror_id, row_number() OVER (PARTITION BY unit ORDER BY frame) - 1 AS entry, frame AS frame_id FROM obs")
def crop_manifest(spark, sf_dir):
    rows = obs_l(spark, sf_dir).select(F.col("unit").alias("mirror_id"), F.col("frame").alias("frame_id"), F.col("frame").alias("ts"))
    return store.crop_manifest(rows).select("mirror_id", F.col("entry").cast("long").alias("entry"), "frame_id")


@query(f"WITH {_RANK} SELECT frame, unit, rank FROM fr")
def rank_table(spark, sf_dir):
    """Ranks are written as a table and read again, a row for each unit of a frame."""
    path = scratch(spark, "ranks")
    store.write_table(_ranks(spark, sf_dir).select("frame", "unit", "rank"), path)
    return store.read_table(spark, path)


@query(f"WITH {OBS_L} SELECT frame, unit, {_r(*L_FEATURES)}, (SELECT count(DISTINCT frame) FROM obs) AS n_images, (SELECT count(DISTINCT unit) FROM obs) AS n_mirrors FROM obs")
def stored_observations(spark, sf_dir):
    """Observations are written by day with their metadata, and read again."""
    path = scratch(spark, "observations")
    store.write_observations(obs_l(spark, sf_dir).withColumn("ts", F.to_timestamp("frame", "yyyy-MM")), path, frame="frame", unit="unit")
    obs, meta = store.read_observations(spark, path)
    return rnd(obs.select("frame", "unit", *L_FEATURES).join(F.broadcast(meta.select("n_images", "n_mirrors"))))


@query(f"WITH {_Z} SELECT frame, unit, feature, {_r('z')} FROM z")
def stored_baseline(spark, sf_dir):
    """A baseline is written and read again, and observations are scored against it."""
    obs, path = obs_l(spark, sf_dir), scratch(spark, "baseline")
    store.write_table(baseline.robust_baseline(obs, "unit", L_FEATURES), path)
    return rnd(score.z_scores(obs, store.read_table(spark, path), "frame", "unit", L_FEATURES).select("frame", "unit", "feature", "z"))


@query("""SELECT mirror_id, place, mirror_id::BIGINT * 100 + place AS x, place * place AS y
    FROM (SELECT c_nationkey::INTEGER AS mirror_id, unnest(range(count(*) % 5 + 3)) AS place FROM customer GROUP BY 1)""")
def stored_calibration(spark, sf_dir):
    """Polygons are written as a calibration file and read again."""
    n = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("mirror_id")).agg((F.count("*") % 5 + 3).cast("int").alias("n"))
    points = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct((F.col("mirror_id") * 100 + k).alias("x"), (k * k).alias("y")))
    path = scratch(spark, "calibration")
    calibration.write_calibration(n.select("mirror_id", points.alias("points")), "image.jpg", path)
    facets = calibration.read_calibration(spark, path)
    return facets.select("mirror_id", F.posexplode("points").alias("place", "p")).select("mirror_id", F.col("place").cast("long").alias("place"), F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS file, (user_id % 249)::INTEGER AS mirror_id FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def stored_annotations(spark, sf_dir):
    """Annotations are written as JSON and read again."""
    marks = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("file"), (F.col("user_id") % 249).cast("int").alias("mirror_id"))
    path = scratch(spark, "annotations")
    annotations.write_annotations(marks, path)
    return spark.read.schema("file string, marked_mirrors array<int>").json(path).select("file", F.explode("marked_mirrors").alias("mirror_id"))


@query("""WITH p AS (SELECT s_suppkey // 10 AS i, s_suppkey % 10 AS j, s_acctbal AS x, s_nationkey AS y FROM supplier)
    SELECT a.i * 9 + a.j AS grid_id, round(a.x + b.x + c.x + d.x + 1e-9, 4) + 0.0 AS sum_x, (a.y + b.y + c.y + d.y)::BIGINT AS sum_y, 5 AS n_points FROM p a JOIN p b ON b.i = a.i AND b.j = a.j + 1 JOIN p c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN p d ON d.i = a.i + 1 AND d.j = a.j""")
def grid_polygons(spark, sf_dir):
    """Cells of a grid of crossing points, here the suppliers in rows of ten."""
    rows = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("i"), (F.col("s_suppkey") % 10).alias("j"), F.col("s_acctbal").cast("double").alias("x"), F.col("s_nationkey").alias("y"))
    corners = F.slice("points", 1, 4)
    total = lambda k, zero: F.aggregate(corners, F.lit(zero), lambda s, p: s + p[k])
    out = geometry.grid_cells(rows, 10).select("grid_id", total("x", 0.0).alias("sum_x"), F.aggregate(corners, F.lit(0).cast("long"), lambda s, p: s + p["y"]).alias("sum_y"), F.size("points").alias("n_points"))
    return rnd(out)


_LIGHT = """l AS (SELECT patch, stddev_pop(lap) AS sharpness FROM g GROUP BY patch),
    q AS (SELECT patch, avg(v) AS mean_brightness, avg((v > 190)::INTEGER) AS bright_saturated_frac, abs(avg(v) FILTER (WHERE x < 4) - avg(v) FILTER (WHERE x >= 4)) AS lr_asymmetry FROM px GROUP BY patch),
    w AS (SELECT patch, round(mean_brightness, 6) AS mean_brightness, round(bright_saturated_frac, 6) AS bright_saturated_frac, round(lr_asymmetry, 6) AS lr_asymmetry, round(sharpness, 6) AS sharpness FROM q JOIN l USING (patch))"""


def _light(spark, sf_dir):
    px = pixels(spark, sf_dir)
    v, six = F.col("v"), lambda c: F.round(c, 6)
    sharp = patches.convolve(px, {"lap": patches.LAPLACE}).groupBy("patch").agg(six(F.stddev_pop("lap")).alias("sharpness"))
    side = F.abs(F.avg(F.when(F.col("x") < 4, v)) - F.avg(F.when(F.col("x") >= 4, v)))
    light = px.groupBy("patch").agg(six(F.avg(v)).alias("mean_brightness"), six(F.avg((v > 190).cast("double"))).alias("bright_saturated_frac"), six(side).alias("lr_asymmetry"))
    return light.join(sharp, "patch")


def _frame_rule(rule: str, sql: str):
    def run(spark, sf_dir):
        return rnd(selection.good_frames(_light(spark, sf_dir), rule), 6)

    run.__name__ = f"{rule}_rule_frames"
    query(f"WITH {_NEAR}, g AS (SELECT patch, {_sql_kernel(patches.LAPLACE, 'lap')} FROM nb), {_LIGHT} SELECT patch, {_r('mean_brightness', 'bright_saturated_frac', 'lr_asymmetry', 'sharpness', digits=6)} FROM w WHERE {sql}")(run)


_frame_rule("morning", "mean_brightness > 100 AND mean_brightness < 145 AND sharpness > 25")
_frame_rule("even", "lr_asymmetry < 10 AND mean_brightness > 80 AND sharpness > 20")


# Clusters and models.


@query("""SELECT label, vec_id FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = a.label AND b.vec_id <> a.vec_id
    AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.15)""")
def dbscan_noise(spark, sf_dir):
    return ml.neighbour_noise(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 1.15)


@query("""WITH RECURSIVE e AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id <> a.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.15),
    r AS (SELECT DISTINCT label, a AS v, a AS root FROM e UNION SELECT r.label, e.b, r.root FROM r JOIN e ON e.a = r.v WHERE e.b > r.root), c AS (SELECT label, v, min(root) AS root FROM r GROUP BY 1, 2),
    k AS (SELECT label, v, dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS cluster FROM c)
    SELECT m.label, coalesce(k.cluster, -1)::INTEGER AS cluster, count(*) AS n FROM embeddings m LEFT JOIN k ON k.v = m.vec_id GROUP BY 1, 2""")
def dbscan_groups(spark, sf_dir):
    rows = ml.dbscan(read(spark, sf_dir, "embeddings"), "label", ["vec_id"], "embedding", 1.15, 2)
    return rows.groupBy("label", "cluster").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS k FROM embeddings), c AS (SELECT label, k, avg(e) AS c FROM e GROUP BY 1, 2),
    d AS (SELECT e.vec_id, c.label, sum(e * c) / (sqrt(sum(e * e)) * sqrt(sum(c * c)) + 1e-12) AS cos FROM e JOIN c USING (k) GROUP BY 1, 2)
    SELECT vec_id, round(round(max(cos), 6) + 1e-9, 4) + 0.0 AS max_cos, round(max(cos), 6) < 0.35 AS is_ood FROM d GROUP BY vec_id""")
def ood_prototypes(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    out = ml.out_of_distribution(rows, ml.label_centres(rows, "label", "embedding", 64), "embedding", 0.35)
    return rnd(out.select("vec_id", F.round("max_cos", 6).alias("max_cos"), (F.round("max_cos", 6) < 0.35).alias("is_ood")))


@query(f"WITH {LONG_L} SELECT feature, {_r('variance=var_pop(value)')} FROM lng GROUP BY feature HAVING var_pop(value) > 0.1")
def variance_select(spark, sf_dir):
    return rnd(ml.variance_select(obs_l(spark, sf_dir), L_FEATURES))


@query("SELECT vec_id, label, " + ", ".join(f"round((embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i + 1}]::DOUBLE) OVER () + 1e-9, 4) + 0.0 AS v{i}" for i in range(64)) + " FROM embeddings")
def standardize(spark, sf_dir):
    return rnd(ml.standardize(vectors(spark, sf_dir), [f"v{i}" for i in range(64)]))


@query()
def kmeans_sizes(spark, sf_dir):
    return ml.cluster_sizes(ml.kmeans(read(spark, sf_dir, "embeddings"), "embedding", 10)[0])


@query()
def pca_variance(spark, sf_dir):
    return rnd(ml.explained(obs_l(spark, sf_dir), L_FEATURES))


@query()
def pca_loadings(spark, sf_dir):
    return rnd(ml.top_loadings(obs_l(spark, sf_dir), L_FEATURES, 2))


@query()
def pca_outliers(spark, sf_dir):
    return rnd(ml.pca_outliers(obs_l(spark, sf_dir), L_FEATURES, 2).select("frame", "unit", "distance"))


_STD2 = OBS_L + """, st AS (SELECT count(*) AS n, corr(quantity, tax) AS r, avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(tax) AS mt, stddev_pop(tax) AS tt FROM obs),
    z2 AS (SELECT frame, unit, (quantity - mq) / sq AS a, (tax - mt) / tt AS b, r, n FROM obs, st)"""


@query(f"WITH {_STD2} SELECT component::INTEGER AS component, {_r('share=CASE component WHEN 0 THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END', 'cumulative=CASE component WHEN 0 THEN (1 + abs(r)) / 2 ELSE 1 END')} FROM st, (SELECT unnest([0, 1]) AS component)")
def pca_variance_2d(spark, sf_dir):
    return rnd(ml.explained(obs_l(spark, sf_dir), ["quantity", "tax"]).drop("needed"))


@query(f"""WITH {_STD2}, d AS (SELECT frame, unit, sqrt((a * a - 2 * r * a * b + b * b) / (1 - r * r) * (n - 1) / n) AS distance FROM z2) SELECT frame, unit, {_r('distance')} FROM d WHERE distance > sqrt(-2 * ln(0.025::DOUBLE))""")
def pca_outliers_2d(spark, sf_dir):
    return rnd(ml.pca_outliers(obs_l(spark, sf_dir), ["quantity", "tax"], 2).select("frame", "unit", "distance"))


@query()
def ood_frames(spark, sf_dir):
    """Prototypes by k-means, and how many vectors of each label are far from all of them."""
    rows = read(spark, sf_dir, "embeddings")
    return ml.ood_counts(ml.out_of_distribution(rows, ml.prototypes(rows, "embedding", 30), "embedding", 0.7), "label")


@query()
def isolation_scores(spark, sf_dir):
    return rnd(ml.isolation_forest(obs_l(spark, sf_dir), "frame", ["unit"], L_FEATURES))


@query()
def combined_decision(spark, sf_dir):
    obs = obs_l(spark, sf_dir)
    return ml.combined_decision(score.sigma_decision(_sigma(spark, sf_dir), "frame", "unit"), ml.isolation_forest(obs, "frame", ["unit"], L_FEATURES), ["frame", "unit"])


def entry(spark, sf_dir):
    """Flagship: baseline on the early frames, score the later ones, flag and vote."""
    return vote_union(spark, sf_dir)
