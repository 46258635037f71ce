"""Clustering, reduction and model-based outliers, on Spark ML where it has them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetwatch.operators import nearness
from facetwatch.operators.lineage import cut
from facetwatch.operators.score import dot
from facetwatch.schemas import observations


def standardize(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Features minus mean over population deviation; a constant feature becomes 0.

    Mean and deviation are one small aggregate (per group) that is joined back.
    """
    df = observations(df, features)
    stats = df.groupBy(*(by or [])).agg(*(a for i, f in enumerate(features) for a in (F.avg(f).alias(f"_m{i}"), F.stddev_pop(f).alias(f"_s{i}"))))
    both = df.join(stats, by) if by else df.join(F.broadcast(stats))
    out = both.withColumns({f: F.when(F.col(f"_s{i}") > 0, (F.col(f) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.col(f) * 0.0) for i, f in enumerate(features)})
    return out.drop(*(f"_{p}{i}" for p in "ms" for i in range(len(features))))


def elements(df: DataFrame, array: str, n: int, prefix: str = "v") -> DataFrame:
    """An array's first n elements as columns ``v0 ...``."""
    return df.select("*", *(F.col(array)[i].cast("double").alias(f"{prefix}{i}") for i in range(n)))


def pca(df: DataFrame, features: list[str], k: int, scale: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Projection ``pc0 ...`` added to the complete rows; loadings (features x k); explained shares."""
    rows = observations(df, features).dropna(subset=features)
    if scale:
        rows = standardize(rows, features)
    else:
        mean = rows.agg(*(F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)))
        rows = rows.join(F.broadcast(mean)).withColumns({f: F.col(f) - F.col(f"_m{i}") for i, f in enumerate(features)}).drop(*(f"_m{i}" for i in range(len(features))))
    rows = rows.withColumn("_x", array_to_vector(F.array(*features)))
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows)
    out = model.transform(rows).withColumn("_y", vector_to_array("_y")).drop("_x")
    out = out.select("*", *(F.col("_y")[i].alias(f"pc{i}") for i in range(k))).drop("_y")
    return out, model.pc.toArray(), model.explainedVariance.toArray()


def explained(df: DataFrame, features: list[str]) -> DataFrame:
    """``component, share, cumulative`` of all components, and ``needed`` to reach 95 %."""
    _, _, share = pca(df, features, len(features))
    total = np.cumsum(share)
    rows = [(i, float(s), float(c), bool(c - s < 0.95)) for i, (s, c) in enumerate(zip(share, total, strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, needed boolean")


def top_loadings(df: DataFrame, features: list[str], k: int, top: int = 3) -> DataFrame:
    """The features with the largest absolute loading of each component."""
    _, pc, _ = pca(df, features, k)
    rows = [(j, n + 1, features[i], float(abs(pc[i, j]))) for j in range(k) for n, i in enumerate(np.argsort(-np.abs(pc[:, j]), kind="stable")[:top])]
    return df.sparkSession.createDataFrame(rows, "component int, position int, feature string, loading double")


def chi_square_quantile(k: int, share: float = 0.975) -> float:
    """The value that a chi-square variable with ``k`` degrees of freedom stays below with probability ``share``."""

    def below(x: float) -> float:
        # Series of the lower incomplete gamma function, over the complete one.
        term = total = 1.0 / (k / 2)
        n = k / 2
        while term > total * 1e-17:
            n += 1
            term *= x / 2 / n
            total += term
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0

    low, high = 0.0, float(k)
    while below(high) < share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return (low + high) / 2


def pca_outliers(df: DataFrame, features: list[str], k: int, cut: float | None = None, share: float = 0.975) -> DataFrame:
    """Rows whose distance in component space, in standard deviations, is above ``cut``.

    Without ``cut`` it is the root of the chi-square quantile of ``share`` with ``k`` degrees of freedom.
    """
    cut = math.sqrt(chi_square_quantile(k, share)) if cut is None else cut
    rows, _, _ = pca(df, features, k)
    var = rows.agg(*(F.var_samp(f"pc{i}").alias(f"_v{i}") for i in range(k)))
    d = sum((F.col(f"pc{i}") * F.col(f"pc{i}") / F.col(f"_v{i}") for i in range(k)), F.lit(0.0))
    out = rows.join(F.broadcast(var)).withColumn("distance", F.sqrt(d)).drop(*(f"_v{i}" for i in range(k)))
    return out.where(F.col("distance") > cut)


def kmeans(df: DataFrame, features: str | list[str], k: int, seed: int = 42, max_iter: int = 20, cosine: bool = False) -> tuple[DataFrame, np.ndarray]:
    """``cluster`` added to the rows, and the centres. ``features``: columns, or one array column."""
    array = F.col(features) if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features))
    rows = df.withColumn("_x", array_to_vector(F.transform(array, lambda v: v.cast("double")))).where("_x is not null")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_x", predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).drop("_x"), np.array(model.clusterCenters())


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per cluster."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def cluster_members(df: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Sorted ids per cluster."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(unit)).alias("members"))


def dbscan_labels(x: np.ndarray, eps: float, min_samples: int, block: int = 1024) -> np.ndarray:
    """DBSCAN labels of the rows of x, -1 for noise; a point counts as its own neighbour.

    Distances are made block by block; clusters are numbered in row order of
    their first core point, and a border point joins the first cluster that
    reaches it.
    """
    n = len(x)
    labels, sq = np.full(n, -1), (x * x).sum(axis=1)

    def near(rows: np.ndarray) -> np.ndarray:
        d = sq[rows][:, None] + sq[None, :] - 2 * x[rows] @ x.T
        return d <= eps * eps + 1e-12

    core = np.concatenate([near(np.arange(i, min(n, i + block))).sum(axis=1) >= min_samples for i in range(0, n, block)]) if n else np.zeros(0, bool)
    cluster = 0
    for s in np.flatnonzero(core):
        if labels[s] >= 0:
            continue
        labels[s], wave = cluster, np.array([s])
        while len(wave):
            reached = np.zeros(n, bool)
            for i in range(0, len(wave), block):
                reached |= near(wave[i : i + block]).any(axis=0)
            new = np.flatnonzero(reached & (labels < 0))
            labels[new] = cluster
            wave = new[core[new]]
        cluster += 1
    return labels


def _points(df: DataFrame, group: str, keys: list[str], features: str | list[str]) -> DataFrame:
    """``group, keys, _x, _id``: the vector of each row, NULL where an element is missing, and a number of its own."""
    array = F.transform(F.col(features), lambda v: v.cast("double")) if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features))
    rows = df if isinstance(features, str) else observations(df.select(group, *keys, *features), features)
    rows = rows.select(group, *keys, array.alias("_x"))
    missing = F.col("_x").isNull() | F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    return cut(rows.withColumn("_x", F.when(~missing, F.col("_x"))).withColumn("_id", F.monotonically_increasing_id()))


def dbscan(df: DataFrame, group: str, keys: list[str], features: str | list[str], eps: float = 1.75, min_samples: int = 2) -> DataFrame:
    """``group, keys, cluster`` per group; rows with a missing feature get a NULL cluster, noise gets -1.

    ``features``: columns, or one array column. Neighbours come from metric blocks
    (``nearness``), core points from their number, clusters from connected components of
    neighbouring core points. Clusters are numbered in key order of their first core
    point, and a border point joins the first of the clusters that reach it. Rows without a
    group are near to none.
    """
    rows = _points(df, group, keys, features)
    whole = rows.where("_x is not null").select(F.col(group).alias("group"), F.col("_id").alias("id"), F.col("_x").alias("x"), F.struct(*keys).alias("first"))
    named = nearness.dbscan(whole, eps, min_samples, "first")
    out = rows.join(named.withColumnRenamed("id", "_id"), "_id", "left")
    return out.select(group, *keys, F.when(F.col("_x").isNotNull(), F.coalesce("cluster", F.lit(-1))).cast("int").alias("cluster"))


def grouped_kmeans(df: DataFrame, group: str, key: str, array: str, k: int = 3, rounds: int = 20, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``group, key, cluster`` with k centres for each group, fitted for all groups at once; and ``group, cluster, centre``.

    Centres begin at the first k different vectors in order of a hash of the key, and move to
    the means of their rows until nothing changes or ``rounds`` are over. A group's rows lie in
    blocks of about ``block_rows``, which meet the group's centres; means are mergeable sums. A group with fewer
    different vectors than k has fewer clusters; a row of equal distances joins the smaller
    number; rows without a vector, or with a missing element, or without a group, are left out.
    """
    x = F.transform(array, lambda v: v.cast("double"))
    rows = df.select(group, key, x.alias("_x")).where(F.col(group).isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    rows = cut(rows)
    start = rows.groupBy(group, "_x").agg(F.min(F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"))).alias("_o"))
    w = Window.partitionBy(group).orderBy("_o")
    start = start.withColumn("cluster", (F.row_number().over(w) - 1).cast("int")).where(F.col("cluster") < k)
    centres = cut(start.select(group, "cluster", F.col("_x").alias("centre")))
    # Rows lie in blocks of a group; a block meets its group's centres as one row.
    n = rows.groupBy(group).agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))
    blocks = rows.join(n, group).groupBy(group, F.pmod(F.xxhash64(key, F.lit("block")), "_blocks").alias("_block"))
    blocks = cut(blocks.agg(F.collect_list(F.struct(key, "_x")).alias("_r")).select(group, F.col(f"_r.{key}").alias("_keys"), F.flatten("_r._x").alias("_flat")))
    named = blocks.select(group, "_keys").schema

    def met(centres: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
        banks = centres.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("_b"))
        banks = banks.select(group, F.col("_b.cluster").alias("_names"), F.flatten("_b.centre").alias("_bank"))

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    one = {c: batch.column(c)[at] for c in batch.schema.names}
                    names, keys = one["_names"].values.to_numpy(), one["_keys"].values
                    held, flat = (one[c].values.to_numpy(zero_copy_only=False) for c in ("_bank", "_flat"))
                    x, held = flat.reshape(len(keys), -1), held.reshape(len(names), -1)
                    best = np.stack([((x - c) ** 2).sum(axis=1) for c in held]).argmin(axis=0)
                    yield from work(one[group], keys, names, x, best)

        return blocks.join(banks, group).mapInArrow(run, schema)

    def sums(unit, keys, names, x, best):
        there = np.unique(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array([unit.as_py()] * len(there), unit.type), pa.array(names[there], pa.int32()), pa.array(np.bincount(best)[there]), pa.array([x[best == c].sum(axis=0) for c in there], pa.list_(pa.float64()))],
            [group, "cluster", "_n", "_sum"],
        )

    def labels(unit, keys, names, x, best):
        yield pa.RecordBatch.from_arrays([pa.array([unit.as_py()], unit.type), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([names[best]], pa.list_(pa.int32()))], [group, "_keys", "_clusters"])

    summed = T.StructType([named[group], T.StructField("cluster", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_sum", T.ArrayType(T.DoubleType()))])
    for _ in range(rounds):
        means = met(centres, sums, summed).groupBy(group, "cluster").agg(F.sum("_n").alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("_sum"))).alias("_sum"))
        means = means.select(group, "cluster", F.transform("_sum", lambda v: v / F.col("_n")).alias("_mean"))
        moved = centres.join(means, [group, "cluster"], "left").select(group, "cluster", F.coalesce("_mean", "centre").alias("centre"), (F.coalesce("_mean", "centre") != F.col("centre")).alias("_moved"))
        moved = cut(moved)
        centres = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            break
    found = met(centres, labels, T.StructType([named[group], named["_keys"], T.StructField("_clusters", T.ArrayType(T.IntegerType()))]))
    found = found.select(group, F.explode(F.arrays_zip("_keys", "_clusters")).alias("_z"))
    return found.select(group, F.col("_z._keys").alias(key), F.col("_z._clusters").alias("cluster")), centres


def noise(labels: DataFrame) -> DataFrame:
    """Rows that DBSCAN put in no cluster."""
    return labels.where("cluster = -1")


def neighbour_noise(df: DataFrame, group: str, key: str, array: str, eps: float) -> DataFrame:
    """Noise for ``min_samples = 2``: rows without a neighbour within eps in their group."""
    rows = _points(df, group, [key], array)
    whole = rows.where("_x is not null").select(F.col(group).alias("group"), F.col("_id").alias("id"), F.col("_x").alias("x"))
    placed, blocks = nearness.blocked(whole)
    met = nearness.neighbour_counts(placed, cut(nearness.block_pairs(blocks, eps)), blocks, eps).where("n > 0")
    return rows.join(met.select(F.col("id").alias("_id")), "_id", "left_anti").select(group, key)


def _depth_left(k: int) -> float:
    """Mean depth of an unsuccessful search among k points."""
    return 0.0 if k < 2 else 1.0 if k == 2 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k


def isolation_trees(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> list[np.ndarray]:
    """Isolation trees (Liu et al. 2008): per node feature (-1 for a leaf), threshold, left, right, depth."""
    rng, m, out = np.random.default_rng(seed), min(sample, len(x)), []
    limit = int(np.ceil(np.log2(max(m, 2))))
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0, 0, 0, 0]]
        todo = [(0, rng.choice(len(x), m, replace=False), 0)]
        while todo:
            at, own, level = todo.pop()
            lo, hi = x[own].min(axis=0), x[own].max(axis=0)
            free = np.flatnonzero(hi > lo)
            if level >= limit or len(free) == 0:
                nodes[at][4] = level + _depth_left(len(own))
                continue
            f = int(rng.choice(free))
            t = rng.uniform(lo[f], hi[f])
            below = x[own, f] < t
            if below.all() or not below.any():
                nodes[at][4] = level + _depth_left(len(own))
                continue
            nodes[at] = [f, t, len(nodes), len(nodes) + 1, 0]
            todo += [(len(nodes), own[below], level + 1), (len(nodes) + 1, own[~below], level + 1)]
            nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
        out.append(np.array(nodes))
    return out


def forest_scores(forest: list[np.ndarray], x: np.ndarray, sampled: int) -> np.ndarray:
    """Scores of rows; larger is more unusual. ``sampled``: rows that each tree was grown on."""
    depth = np.zeros(len(x))
    for nodes in forest:
        at = np.zeros(len(x), int)
        while len(inner := np.flatnonzero(nodes[at, 0] >= 0)):
            n = nodes[at[inner]]
            at[inner] = np.where(x[inner, n[:, 0].astype(int)] < n[:, 1], n[:, 2], n[:, 3]).astype(int)
        depth += nodes[at, 4]
    return 2.0 ** (-depth / len(forest) / max(_depth_left(sampled), 1e-9))


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Isolation-forest scores of the rows that the trees are drawn from."""
    return forest_scores(isolation_trees(x, trees, sample, seed), x, min(sample, len(x)))


def grow_forest(df: DataFrame, group: str, keys: list[str], features: list[str], trees: int = 100, seed: int = 0, sample: int = 256) -> DataFrame:
    """``group, sampled, tree, node, feature, threshold, below, above, depth``: the nodes of each group's trees, grown once.

    ``feature`` is -1 for a leaf, whose ``depth`` is the mean depth of what it stands for;
    other nodes send values under the threshold to ``below``. A tree is grown on ``sample`` rows,
    drawn from a pool of about ``trees * sample`` of the group's rows (all rows of a smaller
    group) that is chosen by hash; so a task holds a bounded pool and no group.
    """
    rows = observations(df.select(group, *keys, *features), features).dropna(subset=features)
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    draw = F.xxhash64(*keys, F.lit(seed)) / 2.0**64 + 0.5
    pool = rows.join(n, F.col(group).eqNullSafe(F.col("_g"))).where(draw * F.col("_n") < trees * sample).drop("_g", "_n")
    names = ["feature", "threshold", "below", "above", "depth"]
    schema = rows.select(group).schema
    for name, kind in [("sampled", T.LongType()), ("tree", T.IntegerType()), ("node", T.IntegerType()), *zip(names, (T.IntegerType(), T.DoubleType(), T.IntegerType(), T.IntegerType(), T.DoubleType()))]:
        schema = schema.add(name, kind)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values(keys)[features].to_numpy(float)
        forest = isolation_trees(x, trees, sample, seed)
        out = pd.DataFrame(np.concatenate(forest), columns=names).astype({"feature": "int32", "below": "int32", "above": "int32"})
        out.insert(0, "node", np.concatenate([np.arange(len(t)) for t in forest]))
        out.insert(0, "tree", np.repeat(np.arange(len(forest)), [len(t) for t in forest]))
        out.insert(0, "sampled", min(sample, len(x)))
        out.insert(0, group, own[group].iloc[0])
        return out

    return cut(pool.groupBy(group).applyInPandas(run, schema))


def score_forest(df: DataFrame, nodes: DataFrame, group: str, keys: list[str], features: list[str], part_rows: int = 50_000) -> DataFrame:
    """``group, keys, score`` of the complete rows, by their group's trees; larger is more unusual.

    A group's rows come in parts of about ``part_rows``, by hash; each part meets the nodes.
    """
    rows = observations(df.select(group, *keys, *features), features).dropna(subset=features)
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    known = nodes.join(n, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_g", "_parts")
    known = known.toDF(*known.columns)  # columns of its own, for the cogroup
    rows = rows.join(n, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_part", F.pmod(F.xxhash64(*keys, F.lit("part")), F.col("_parts")).cast("int")).drop("_g", "_parts")
    schema = rows.select(group, *keys).schema.add("score", T.DoubleType())

    def run(part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return part[[group, *keys]].assign(score=np.zeros(0))
        nodes = nodes.sort_values(["tree", "node"])
        table, size = nodes[["feature", "threshold", "below", "above", "depth"]].to_numpy(float), nodes.groupby("tree").size().to_numpy()
        forest = np.split(table, np.cumsum(size)[:-1])
        return part[[group, *keys]].assign(score=forest_scores(forest, part[features].to_numpy(float), int(nodes["sampled"].iloc[0])))

    return rows.groupBy(group, "_part").cogroup(known.groupBy(group, "_part")).applyInPandas(run, schema)


def isolation_forest(df: DataFrame, group: str, keys: list[str], features: list[str], contamination: float = 0.05, trees: int = 100, seed: int = 0, sample: int = 256, part_rows: int = 50_000) -> DataFrame:
    """``group, keys, score, is_outlier`` per group; the cut is a percentile of the scores. Trees are grown once, as a table."""
    nodes = grow_forest(df, group, keys, features, trees, seed, sample)
    scored = cut(score_forest(df, nodes, group, keys, features, part_rows))
    top = scored.groupBy(F.col(group).alias("_g")).agg(F.percentile("score", 1 - contamination).alias("_top"))
    return scored.join(top, F.col(group).eqNullSafe(F.col("_g"))).select(group, *keys, "score", (F.col("score") > F.col("_top")).alias("is_outlier"))


def combined_decision(statistical: DataFrame, model: DataFrame, keys: list[str], method: str = "both") -> DataFrame:
    """``is_anomaly``: statistical, ml, or either of them (``both``)."""
    both = statistical.select(*keys, F.col("is_anomaly").alias("_s")).join(model.select(*keys, F.col("is_outlier").alias("_m")), keys, "full_outer")
    s, m = F.coalesce("_s", F.lit(False)), F.coalesce("_m", F.lit(False))
    if method not in ("statistical", "ml", "both"):
        raise ValueError(f"unknown method {method}")
    return both.select(*keys, {"statistical": s, "ml": m, "both": s | m}[method].alias("is_anomaly"))


def label_centres(df: DataFrame, label: str, array: str, n: int) -> DataFrame:
    """Mean vector per label: prototypes without a fit."""
    means = df.groupBy(label).agg(F.array(*(F.avg(F.col(array)[i].cast("double")) for i in range(n))).alias("centre"))
    return means.where(F.col(label).isNotNull())


def ood_counts(scored: DataFrame, frame: str) -> DataFrame:
    """Per frame its vectors, those out of distribution, and their share."""
    return scored.groupBy(frame).agg(F.count("*").alias("n"), F.count_if("is_ood").alias("n_ood"), F.avg(F.col("is_ood").cast("double")).alias("share"))


def out_of_distribution(df: DataFrame, centres: DataFrame, array: str, threshold: float = 0.7, most: int = 10_000) -> DataFrame:
    """``max_cos`` to the prototypes, and ``is_ood`` where it is below the threshold.

    ``centres`` is a few dozen rows (a fitted k or the number of labels); it is
    gathered into one row and broadcast. More than ``most`` of them are an error.
    """
    centres = cut(centres)
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} prototypes")
    bank = centres.agg(F.collect_list("centre").alias("_bank"))
    own = F.sqrt(dot(array, array))
    cos = F.transform("_bank", lambda c: dot(array, c) / (own * F.sqrt(dot(c, c)) + 1e-12))
    out = df.join(F.broadcast(bank)).withColumn("max_cos", F.array_max(cos)).drop("_bank")
    return out.withColumn("is_ood", F.col("max_cos") < threshold)


def prototypes(df: DataFrame, array: str, k: int = 30, seed: int = 42) -> DataFrame:
    """k-means centres of embeddings, one row each."""
    _, centres = kmeans(df, array, k, seed)
    return df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")


def variance_select(df: DataFrame, features: list[str], threshold: float = 0.1) -> DataFrame:
    """Features whose population variance is above the threshold: ``feature, variance``."""
    row = observations(df, features).agg(*(F.var_pop(f).alias(f) for f in features))
    return row.unpivot([], features, "feature", "variance").where(F.col("variance") > threshold)
