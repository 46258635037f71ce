"""The three workloads from images or stored features to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.operators import baseline, extract, metrics, score, selection, temporal
from facetwatch.schemas import COMPOSITE_FEATURES, FEATURES, LOWER_IS_BETTER


def select_frames(frames: DataFrame, rule: str = "good", hours: tuple[int, int] | None = None) -> DataFrame:
    """Frames of good quality, optionally of some hours of the day."""
    kind = "details" if rule == "even" else "quality"
    good = selection.good_frames(extract.frame_measures(frames, kind), rule).select("frame_id")
    rows = frames if hours is None else selection.hours_between(frames, "ts", *hours)
    return rows.join(good, "frame_id", "left_semi")


def build_baseline(frames: DataFrame, facets: DataFrame, families: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations of the frames, the robust baseline and the vector baseline.

    One pass over the images, one shuffle by facet for each baseline.
    """
    obs = extract.extract(frames, facets, families)
    names = [c for c in obs.columns if c not in ("frame_id", "ts", "mirror_id", "valid")]
    return obs, baseline.robust_baseline(obs, "mirror_id", names), baseline.vector_baseline(obs, "mirror_id", names)


def evaluate(obs: DataFrame, vbaseline: DataFrame, annotations: DataFrame, features: list[str] = FEATURES, n_std: float = 3.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated frames scored by distance and cut per frame: outliers, metrics per frame, totals."""
    truth = annotations.select(F.col("file").alias("frame_id"), "mirror_id")
    there = obs.join(truth.select("frame_id").distinct(), "frame_id", "left_semi")
    scored = score.mahalanobis(there, vbaseline, "mirror_id", features)
    found = score.frame_cut(scored, "frame_id", "mahalanobis", n_std).select("frame_id", "mirror_id", "mahalanobis")
    per = metrics.detection_metrics(found, truth.join(there.select("frame_id").distinct(), "frame_id", "left_semi"), ["frame_id", "mirror_id"], ["frame_id"])
    return found, per, metrics.micro_metrics(found, truth, there, "frame_id", "mirror_id")


def track(obs: DataFrame, frame: str = "frame_id", unit: str = "mirror_id", order: list[str] | None = None, features: list[str] = COMPOSITE_FEATURES, lower: list[str] = LOWER_IS_BETTER, window: int = 5) -> dict[str, DataFrame]:
    """Ranks per frame, their history, and the facets that fall behind.

    ``order`` gives the time order of frames; it must be a total one.
    """
    ranks = temporal.frame_rank(obs, frame, unit, features, lower)
    if order and order != [frame]:
        ranks = ranks.join(obs.select(frame, *(c for c in order if c != frame)).distinct(), frame)
    hist = temporal.with_counts(temporal.history(ranks, frame, unit, order), unit, frame, order)
    n = hist.select(unit).distinct().agg(F.count("*").alias("_units"))
    signals = temporal.unit_signals(hist.join(F.broadcast(n)), unit, F.col("_units"), window)
    report = temporal.signal_report(signals, unit, top=None)
    return {"ranks": ranks, "history": hist, "signals": signals, "report": report, "flagged": temporal.flagged_units(report, unit)}
