"""Hard negatives by exact inner-product search over anchor-clustered shared lists.

Anchors are clustered by direction. Within a cluster with centre ``c`` whose
members lie within the angle ``t`` of it, no member ``u`` can have a product above
``|u| |i| cos(max(0, angle(i, c) - t))`` with a candidate ``i``. Candidates are
sorted by that bound once per cluster, and every member walks the shared list:
it goes on until what it holds is certified, that is, until the bound of all
that follows is below the worst score it would keep. (The bound is Abuzaid et
al.'s, "To Index or Not to Index", 2019.) Two walks give the result: the first
finds an anchor's best rows of its own label, its positives; the second finds, for
each positive, the best rows of other labels whose score lies in a band below
the positive's.

Scale. The stated queries (anchors) meet all rows in blocks: candidates lie in
blocks of at most ``block_rows`` rows, anchors in groups of whole clusters of about
``group_rows`` rows, and one task holds one block and one group at a time. A walk sends on
no more than the rows it keeps, so an anchor gives each block at most ``positives``, or
``positives * negatives``, rows; their best are taken by ranked windows, which keep k rows
before they shuffle. Blocks go by hash over all rows, so a label that a third of the rows
bear is no larger a task than others. Rows that repeat another in full are
counted before they move; no result holds more than k copies of one.

Scores are whole numbers: products are taken in float64 while they are exact
there, else in 64-bit integers; a product that may pass these is an error.

Defined cases: rows with a null label, id or vector, or with a null or
non-finite component, take no part; vectors meet those of equal length only; ties
go to the smaller id; rows that bear the anchor's id are never its positives or
negatives; rows that repeat an id otherwise count each; anchors that repeat an id
with another label or vector are mined each (``variant`` tells them apart), fully
equal ones once; vectors without length are searched like others (all their
products are 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.llm.common import cut, scratch

POSITIVES = "anchor_id long, variant long, label long, cluster int, team int, id long, score long"
NEGATIVES = "anchor_id long, variant long, positive_rank int, id long, score long"


def whole(vector: str, scale: float) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, label, x, dims, copies``: rows that take part, full repeats counted."""
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(vector_col, scale).alias("x"))
    return rows.groupBy("id", "label", "x").agg(F.count("*").alias("copies")).withColumn("dims", F.size("x"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def clustered(anchors: DataFrame, cluster_rows: int, max_clusters: int, group_rows: int) -> DataFrame:
    """Anchors with ``cluster`` (the nearest of the seeds by angle) and ``team``, the group of whole clusters they move in.

    Seeds are anchors drawn evenly by hash, at most ``max_clusters`` for each vector
    length; they decide how far the walks go, not what they find. A cluster above
    ``group_rows`` is split over several teams by hash.
    """
    spark = anchors.sparkSession
    at = F.xxhash64("id", "x")
    counts = {r.dims: r.n for r in anchors.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    seeds: dict[int, np.ndarray] = {}
    for dims, n in counts.items():
        k = min(max_clusters, max(1, n // cluster_rows))
        rows = anchors.where(F.col("dims") == dims).orderBy(at, "id").limit(k).select("x").collect()
        seeds[dims] = _unit(np.array([r.x for r in rows], float).reshape(len(rows), dims))

    def nearest(batches):
        for b in batches:
            cluster = np.zeros(b.num_rows, np.int32)
            lengths, xs = b.column("dims").to_numpy(), b.column("x")
            for dims in np.unique(lengths) if b.num_rows else ():
                rows = np.flatnonzero(lengths == dims)
                x = xs.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims).astype(float)
                cluster[rows] = (_unit(x) @ seeds[dims].T).argmax(axis=1) if dims else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster)], [*b.schema.names, "cluster"])

    rows = anchors.mapInArrow(nearest, "id long, label long, x array<long>, copies long, dims int, cluster int")
    # As many rows as there are clusters, so bounded: which team a cluster begins in, and over how many it is split.
    sizes, plan, team, filled = rows.groupBy("dims", "cluster").agg(F.count("*").alias("n")).orderBy("dims", "cluster").collect(), [], 0, 0
    for before, r in zip([None, *sizes], sizes):
        if filled and (filled + r.n > group_rows or before.dims != r.dims):
            team, filled = team + 1, 0
        parts = -(-r.n // group_rows)
        plan.append((r.dims, r.cluster, team, parts))
        team, filled = (team + parts, 0) if parts > 1 else (team, filled + r.n)
    plan = spark.createDataFrame(plan, "dims int, cluster int, _first int, _parts int")
    rows = rows.join(F.broadcast(plan), ["dims", "cluster"])
    return rows.withColumn("team", (F.col("_first") + F.pmod(at, "_parts")).cast("int")).drop("_first", "_parts")


def _vectors(t: pa.Table, dims: int) -> np.ndarray:
    return t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dims)


def _exact(a: np.ndarray, b: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 where all products are exact in it, else as integers; an error beyond 64 bits."""
    most = max(dims, 1) * max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0))), default=0) * max((abs(int(v)) for v in (b.min(initial=0), b.max(initial=0))), default=0)
    if most >= 1 << 63:
        raise OverflowError("scores do not fit 64 bits")
    return (a, b) if most >= 1 << 53 else (a.astype(float), b.astype(float))


def bounds(members: np.ndarray, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each candidate (direction and length), the most that its product with any member can be, over the member's length."""
    own = _unit(members.astype(float))
    own = own[np.abs(own).sum(axis=1) > 0]  # members without length have no direction; all their products are 0
    centre = own.mean(axis=0) if len(own) else np.zeros(unit.shape[1])
    length = np.linalg.norm(centre)
    if not length:
        return size
    centre = centre / length
    widest = np.arccos(np.clip(own @ centre, -1, 1)).max()
    angle = np.arccos(np.clip(unit @ centre, -1, 1))
    # A small step covers rounding, so that a bound is never below what it bounds.
    return np.maximum(size * np.cos(np.maximum(0, angle - widest)), 0) * (1 + 1e-9) + 1e-6


class Best:
    """The best ``k`` rows of each list: largest score first, then smallest id."""

    def __init__(self, lists: int, k: int):
        self.k, self.score, self.id = k, np.full((lists, k), np.iinfo(np.int64).min), np.zeros((lists, k), np.int64)
        self.n = np.zeros(lists, np.int64)

    @property
    def worst(self) -> np.ndarray:
        """The score that a row must reach to enter."""
        return np.where(self.n >= self.k, self.score[:, -1], np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        if not len(at):
            return
        times = np.minimum(copies, self.k)
        at, score, ids = np.repeat(at, times), np.repeat(score, times), np.repeat(ids, times)
        hit = np.unique(at)
        held = np.arange(self.k)[None, :] < self.n[hit, None]
        at, score, ids = np.concatenate([np.repeat(hit, held.sum(axis=1)), at]), np.concatenate([self.score[hit][held], score]), np.concatenate([self.id[hit][held], ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.score[at[keep], place[keep]], self.id[at[keep], place[keep]] = score[keep], ids[keep]
        self.n[hit] = np.bincount(np.searchsorted(hit, at[keep]), minlength=len(hit))


class Block:
    """Candidates of one task: whole vectors, and their directions and lengths for the bounds."""

    def __init__(self, x: np.ndarray):
        self.x, self.size, self.unit = x, np.linalg.norm(x.astype(float), axis=1), _unit(x.astype(float))


def walk(members: np.ndarray, block: Block, places: np.ndarray, take, certified, first: int = 256) -> int:
    """Walks the list that the members of one cluster share, candidates at ``places`` sorted by bound; returns the number of products taken.

    ``take(rows, places, scores)`` gets scores of member rows at places of the block;
    ``certified(rows, most)`` tells which member rows need nothing whose score is at most
    ``most``, which is all that follows.
    """
    if not len(members) or not len(places):
        return 0
    bound = bounds(members, block.unit[places], block.size[places])
    order = np.argsort(-bound, kind="stable")
    bound, places = bound[order], places[order]
    length = np.linalg.norm(members.astype(float), axis=1)
    active, at, step, taken = np.arange(len(members)), 0, first, 0
    while at < len(places):
        active = active[~certified(active, np.floor(length[active] * bound[at] * (1 + 1e-9) + 1e-6))]
        if not len(active):
            break
        here = places[at : at + max(1, min(step, (1 << 20) // len(active)))]  # bounds the block of scores
        take(active, here, (members[active] @ block.x[here].T).astype(np.int64))
        taken, at, step = taken + len(active) * len(here), at + len(here), step * 2
    return taken


def _positives(k: int, dims_of):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            dims = dims_of(anchors)
            ids, labels, copies = (rows.column(c).to_numpy() for c in ("id", "label", "copies"))
            aid, alabel, variant, cluster = (anchors.column(c).to_numpy() for c in ("id", "label", "variant", "cluster"))
            ax, x = _exact(_vectors(anchors, dims), _vectors(rows, dims), dims)
            best, block = Best(len(aid), k), Block(x)
            for c in np.unique(cluster):
                for label in np.unique(alabel[cluster == c]):
                    mine, theirs = np.flatnonzero((cluster == c) & (alabel == label)), np.flatnonzero(labels == label)

                    def take(active, places, scores, mine=mine):
                        who = mine[active]
                        m, j = np.nonzero((scores >= best.worst[who, None]) & (aid[who, None] != ids[None, places]))
                        best.add(who[m], scores[m, j], ids[places[j]], copies[places[j]])

                    walk(ax[mine], block, theirs, take, lambda active, most, mine=mine: best.worst[mine[active]] > most)
            held = np.arange(k)[None, :] < best.n[:, None]
            at = np.repeat(np.arange(len(aid)), held.sum(axis=1))
            out = [aid[at], variant[at], alabel[at], cluster[at], anchors.column("team").to_numpy()[at], best.id[held], best.score[held]]
        return _table(POSITIVES, out)

    return run


def _negatives(k: int, low: int, high: int, dims_of):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            dims = dims_of(anchors)
            ids, labels, copies = (rows.column(c).to_numpy() for c in ("id", "label", "copies"))
            aid, alabel, variant, cluster = (anchors.column(c).to_numpy() for c in ("id", "label", "variant", "cluster"))
            ax, x = _exact(_vectors(anchors, dims), _vectors(rows, dims), dims)
            scores_of = anchors.column("positives").to_pylist()
            most = max(map(len, scores_of))
            # Bands of whole scores: 100 s lies from low * p to high * p; an empty band where there is no positive.
            floor, ceiling = np.full((len(aid), most), 1, np.int64), np.zeros((len(aid), most), np.int64)
            for a, ps in enumerate(scores_of):
                for j, p in enumerate(ps):
                    floor[a, j], ceiling[a, j] = -(-low * p // 100), high * p // 100
            best, block = [Best(len(aid), k) for _ in range(most)], Block(x)
            for c in np.unique(cluster):
                mine = np.flatnonzero(cluster == c)

                def take(active, places, scores, mine=mine):
                    who = mine[active]
                    other = (alabel[who, None] != labels[None, places]) & (aid[who, None] != ids[None, places])
                    for j, b in enumerate(best):
                        m, i = np.nonzero(other & (scores <= ceiling[who, j, None]) & (scores >= np.maximum(floor[who, j], b.worst[who])[:, None]))
                        b.add(who[m], scores[m, i], ids[places[i]], copies[places[i]])

                def certified(active, bound, mine=mine):
                    who = mine[active]
                    return np.all([(np.maximum(floor[who, j], b.worst[who]) > bound) | (floor[who, j] > ceiling[who, j]) | (b.worst[who] > np.minimum(bound, ceiling[who, j])) for j, b in enumerate(best)], axis=0)

                walk(ax[mine], block, np.arange(len(ids)), take, certified)
            for j, b in enumerate(best):
                held = np.arange(k)[None, :] < b.n[:, None]
                at = np.repeat(np.arange(len(aid)), held.sum(axis=1))
                out.append([aid[at], variant[at], np.full(len(at), j + 1), b.id[held], b.score[held]])
            out = [np.concatenate(c) for c in zip(*out)]
        return _table(NEGATIVES, out)

    return run


def _table(schema: str, columns: list) -> pa.Table:
    names = [f.split() for f in schema.split(", ")]
    kind = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({n: pa.array(columns[i] if columns else [], kind[t]) for i, (n, t) in enumerate(names)})


def _dims(anchors: pa.Table) -> int:
    return int(anchors.column("dims")[0].as_py())


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block_rows: int = 65_536, group_rows: int = 4096, cluster_rows: int = 64, max_clusters: int = 1024,
) -> DataFrame:
    """``anchor_id, variant, positive_rank, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``. For each anchor and each of its first
    ``positives`` rows of the same label: the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    table = scratch(spark, "negatives")
    usable(rows, id_col, label_col, vector_col, scale).write.parquet(table)
    rows = spark.read.parquet(table)
    anchors = cut(clustered(rows.where(is_anchor), cluster_rows, max_clusters, group_rows).withColumn("variant", F.xxhash64("label", "x")).drop("copies"))
    # For each vector length: blocks of bounded rows, no more than tasks can share while they are small, and its teams.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    teams = {r.dims: (r.low, r.high) for r in anchors.groupBy("dims").agg(F.min("team").alias("low"), F.max("team").alias("high")).collect()}
    sizes = [(r.dims, max(1, -(-r.n // block_rows), min(tasks, r.n // 4096)), *teams[r.dims]) for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect() if r.dims in teams]
    sizes = F.broadcast(spark.createDataFrame(sizes, "dims int, _blocks int, _low int, _high int"))
    left = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("id", "label", "x"), "_blocks").cast("int")).withColumn("team", F.explode(F.sequence("_low", "_high"))).drop("_blocks", "_low", "_high")
    spread = lambda a: a.join(sizes, "dims").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks", "_low", "_high")
    key = ["dims", "block", "team"]

    found = left.groupBy(*key).cogroup(spread(anchors).groupBy(*key)).applyInArrow(_positives(positives, _dims), POSITIVES)
    order = [F.desc("score"), F.asc("id")]
    w = Window.partitionBy("anchor_id", "variant").orderBy(*order)
    pairs = cut(found.withColumn("positive_rank", F.row_number().over(w)).where(F.col("positive_rank") <= positives))
    lists = pairs.groupBy(F.col("anchor_id").alias("id"), "variant").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "score"))), lambda s: s["score"]).alias("positives"))

    found = left.groupBy(*key).cogroup(spread(anchors.join(lists, ["id", "variant"])).groupBy(*key)).applyInArrow(_negatives(negatives, low, high, _dims), NEGATIVES)
    w = Window.partitionBy("anchor_id", "variant", "positive_rank").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    found = found.select("anchor_id", "variant", "positive_rank", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = pairs.select("anchor_id", "variant", "positive_rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "variant", "positive_rank"])
