"""Pairs of near vectors within groups, found in metric blocks, and DBSCAN on top of them.

A group's rows go to the nearest of its pivots, which are a bounded sample of it, and
each pivot's rows to blocks of bounded size. A block knows its pivot and its radius.
By the triangle inequality two blocks hold no rows within ``eps`` of each other when
their pivots lie further apart than both radii and ``eps``, so only the other pairs of blocks
meet. Blocks are dealt to a few parts, and a task holds the blocks of two parts: a row is sent
once for each part that it meets, not for each block. There, blocks are passed over by the
same rule around their means, and so are single rows too far from the other block. What a
task sends on grows with its rows, never with the pairs of rows it finds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.operators.lineage import components, cut

MOST_PIVOTS = 64


def blocked(points: DataFrame, pivots: int = MOST_PIVOTS, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``points(group long, id long, x array<double>)`` with ``block``; and blocks ``group, block, pivot, radius``.

    A group has a pivot for every 64 rows, ``pivots`` at most, drawn by hash. Pivots of a group
    are one row of bounded size; rows meet them by group, in a join whose large groups are split.
    """
    counts = points.groupBy("group").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("group").orderBy(F.xxhash64("id"), "id")
    drawn = points.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= pivots)
    drawn = drawn.join(counts, "group").where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / 64)))
    banks = cut(drawn.groupBy("group", "_n").agg(F.collect_list("x").alias("_bank")))
    # A group's rows meet its pivots in parts, each one product of matrices.
    rows = points.select("group", "id", "x").join(counts, "group").withColumn("_part", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / 16_384)).cast("int")).drop("_n")
    held = banks.select("group", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / 16_384).cast("int") - 1)).alias("_part"), "_bank")
    held = held.toDF(*held.columns)  # columns of its own, for the cogroup
    kind = points.schema["group"].dataType.simpleString()

    def nearest(own: pa.Table, bank: pa.Table) -> pa.Table:
        own = own.select(["group", "id", "x"])
        pivot, far = np.zeros(own.num_rows, np.int32), np.zeros(own.num_rows)
        if own.num_rows and bank.num_rows:
            x, b = _matrix(own, "x"), np.array(bank.column("_bank")[0].as_py(), float)
            pivot = ((b * b).sum(axis=1)[None] - 2 * x @ b.T).argmin(axis=1).astype(np.int32)
            far = np.sqrt(((x - b[pivot]) ** 2).sum(axis=1))
        return own.append_column("_pivot", pa.array(pivot)).append_column("_d", pa.array(far))

    rows = cut(rows.groupBy("group", "_part").cogroup(held.groupBy("group", "_part")).applyInArrow(nearest, f"group {kind}, id long, x array<double>, _pivot int, _d double"))
    # A pivot with many rows has several blocks, by hash.
    sizes = cut(rows.groupBy("group", "_pivot").agg(F.ceil(F.count("*") / block_rows).alias("_parts")))
    rows = rows.join(sizes, ["group", "_pivot"]).withColumn("block", (F.col("_pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("_parts"))))
    rows = rows.select("group", "block", "id", "x", "_d", "_pivot")
    blocks = rows.groupBy("group", "block", "_pivot").agg(F.max("_d").alias("radius")).join(banks, "group")
    return rows.drop("_d", "_pivot"), cut(blocks.select("group", "block", F.col("_bank")[F.col("_pivot")].alias("pivot"), "radius"))


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``group, left, right`` of the blocks (``left <= right``) that may hold rows within ``eps``."""
    other = blocks.select("group", *(F.col(c).alias(f"{c}_") for c in ("block", "pivot", "radius")))
    gap = F.sqrt(F.aggregate(F.zip_with("pivot", "pivot_", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = gap <= F.col("radius") + F.col("radius_") + F.lit(eps * (1 + 1e-9) + 1e-9)
    return blocks.join(other, "group").where((F.col("block") <= F.col("block_")) & near).select("group", F.col("block").alias("left"), F.col("block_").alias("right"))


#: A group's blocks are dealt to this many parts at most, more only where a part would have over PART_ROWS rows.
MOST_PARTS, PART_ROWS = 6, 131_072


def _parts(rows: DataFrame) -> DataFrame:
    """``group, block, part``: the blocks of a group in parts of about equal rows, few enough that a row is sent a bounded number of times."""
    sizes = rows.groupBy("group", "block").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy("group"))
    # A small group is one part; beyond that parts are bounded in number, then in rows.
    parts = F.greatest(F.least(F.ceil(total / 2048), F.lit(MOST_PARTS)), F.ceil(total / PART_ROWS))
    return sizes.select("group", "block", F.floor((F.sum("_n").over(order) - F.col("_n")) * parts / total).cast("int").alias("part"))


def _sides(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the left and of the right part of each pair of parts; a row goes only to pairs where its block has a near block, and a part paired with itself is a left side only."""
    parts = cut(_parts(rows))
    named = lambda side: parts.select("group", F.col("block").alias(side), F.col("part").alias(f"_{side}"))
    # Pairs of blocks by number; parts follow the order of blocks, so left parts are never behind right ones.
    met = cut(pairs.join(named("left"), ["group", "left"]).join(named("right"), ["group", "right"]))
    places = [F.col("_left").alias("left"), F.col("_right").alias("right")]
    first = met.select("group", F.col("left").alias("block"), *places)
    second = met.select("group", F.col("right").alias("block"), *places)
    # In a part paired with itself both blocks of a pair are rows of the left side.
    left = first.unionByName(second.where("left = right")).distinct()
    right = second.where("left <> right").distinct()
    return tuple(rows.join(side, ["group", "block"]).select("group", "left", "right", "block", "id", "x", *columns) for side in (left, right))


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)


def _balls(x: np.ndarray, blocks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Row places, centre and radius of each block."""
    order = np.argsort(blocks, kind="stable")
    out = []
    for places in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        if len(places):
            centre = x[places].mean(axis=0)
            out.append((places, centre, float(np.linalg.norm(x[places] - centre, axis=1).max())))
    return out


def _near(left: pa.Table, right: pa.Table, same: bool, eps: float, meet: Callable, step: int = 1 << 20) -> int:
    """Calls ``meet(i, j)`` with row places of near pairs, part by part; returns how many distances were taken.

    Each side's blocks are balls around their own mean; pairs of balls too far apart are
    passed over, and so are rows too far from the other ball. A part with itself gives each pair once.
    """
    a = _matrix(left, "x")
    b = a if same else _matrix(right, "x")
    ones = _balls(a, left.column("block").to_numpy())
    others = ones if same else _balls(b, right.column("block").to_numpy())
    reach, taken = eps * (1 + 1e-9) + 1e-9, 0
    squares = ((a * a).sum(axis=1), (b * b).sum(axis=1))
    slack = eps * eps * 1e-6 + 1e-9 * (1 + float(max(v.max(initial=0) for v in squares)))
    for k, (rows, centre, radius) in enumerate(ones):
        near, twice = [], False
        for m in range(k if same else 0, len(others)):
            places, middle, wide = others[m]
            if same and m == k:
                near, twice = [places], True
            elif np.linalg.norm(centre - middle) <= radius + wide + reach:
                near.append(places[np.linalg.norm(b[places] - centre, axis=1) <= radius + reach])
        # All rows near this ball at once: products of matrices are of some size.
        cols = np.concatenate(near) if near else rows[:0]
        if not len(cols):
            continue
        high = max(1, step // len(cols))
        for at in range(0, len(rows), high):
            part = rows[at : at + high]
            rough = squares[0][part][:, None] + squares[1][cols][None] - 2 * a[part] @ b[cols].T
            # Products round; what passes with some slack is measured again by its differences.
            i, j = np.nonzero(rough <= eps * eps + slack)
            if twice:  # the ball's own rows come first, in the same order
                once = j > i + at
                i, j = i[once], j[once]
            i, j = part[i], cols[j]
            keep = ((a[i] - b[j]) ** 2).sum(axis=1) <= eps * eps + 1e-12
            taken += rough.size
            meet(i[keep], j[keep])
    return taken


def _run(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(same, left, right)`` for each pair of parts; ``same``: the pair is a part with itself, and ``right`` is empty."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return work(key[1].as_py() == key[2].as_py(), left, right)

    left, right = _sides(rows, pairs, columns)
    right = right.toDF(*right.columns)  # columns of its own, for the cogroup
    return left.groupBy("group", "left", "right").cogroup(right.groupBy("group", "left", "right")).applyInArrow(run, schema)


def _both(left: pa.Table, right: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([left.column(column).to_numpy(), right.column(column).to_numpy()])


def neighbour_counts(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, eps: float) -> DataFrame:
    """``id, n, measured``: rows within ``eps`` of each row, itself left out; rows without any are left out.

    ``measured`` adds up to the distances taken, as a measure of what the blocks spared.
    """

    def work(same: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        n, shift = np.zeros(left.num_rows + right.num_rows, np.int64), 0 if same else left.num_rows

        def meet(i, j):
            np.add.at(n, i, 1)
            np.add.at(n, j + shift, 1)

        taken = _near(left, right, same, eps, meet)
        cost = np.zeros(len(n), np.int64)
        cost[:1] = taken
        ids = _both(left, right, "id")
        return pa.table({"id": ids, "n": n, "measured": cost}).filter(pa.array((n > 0) | (cost > 0)))

    return _run(rows, pairs, blocks, [], work, "id long, n long, measured long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"))


def core_links(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b``: links that join near core rows up, from ``rows`` that are all core; a pair of parts sends at most one for each of its rows.

    A row that has a near row is at an end of some link.
    """

    def work(same: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        root, shift = np.arange(left.num_rows + right.num_rows), 0 if same else left.num_rows

        def meet(i, j):
            j = j + shift
            while True:
                p, q = root[i], root[j]
                differ = p != q
                if not differ.any():
                    return
                i, j = i[differ], j[differ]
                np.minimum.at(root, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
                while (root[root] != root).any():
                    root[:] = root[root]

        if same or right.num_rows:
            _near(left, right, same, eps, meet)
        ids, moved = _both(left, right, "id"), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[moved], "b": ids[root[moved]]})

    return _run(rows, pairs, blocks, [], work, "a long, b long")


def border_clusters(rows: DataFrame, pairs: DataFrame, blocks: DataFrame, eps: float) -> DataFrame:
    """``id, cluster``: for rows without a ``cluster``, the smallest cluster within ``eps``."""

    def work(same: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.iinfo(np.int64).max
        shift = 0 if same else left.num_rows
        own = np.concatenate([t.column("cluster").fill_null(-1).to_numpy() for t in (left, right)])
        best = np.full(len(own), none)

        def meet(i, j):
            j = j + shift
            for u, v in ((i, j), (j, i)):
                open_ = (own[u] < 0) & (own[v] >= 0)
                np.minimum.at(best, u[open_], own[v[open_]])

        if same or right.num_rows:
            _near(left, right, same, eps, meet)
        ids, hit = _both(left, right, "id"), best < none
        return pa.table({"id": ids[hit], "cluster": best[hit]})

    return _run(rows, pairs, blocks, ["cluster"], work, "id long, cluster long").groupBy("id").agg(F.min("cluster").alias("cluster"))


def dbscan(points: DataFrame, eps: float, min_samples: int, first: str, block_rows: int = 4096) -> DataFrame:
    """``id, cluster`` of ``points(group, id long, x array<double>)``; noise has no row. A row counts as its own neighbour.

    Clusters of a group are numbered from 0 in order of their first core row by the column
    ``first``; a border row joins the first of the clusters that reach it. Up to ``min_samples``
    2 every row with a neighbour is core: links alone tell which those are, no row is a border,
    and distances are taken once.
    """
    rows, blocks = blocked(points, block_rows=block_rows)
    pairs = cut(block_pairs(blocks, eps))
    core = rows.select("group", "id")
    if min_samples > 2:
        core = cut(core.join(neighbour_counts(rows, pairs, blocks, eps).where(F.col("n") + 1 >= min_samples).select("id"), "id", "left_semi"))
        links = core_links(rows.join(core.select("id"), "id", "left_semi"), pairs, blocks, eps)
    else:
        links = core_links(rows, pairs, blocks, eps)
    core = core.join(components(links).withColumnRenamed("node", "id"), "id", "inner" if min_samples == 2 else "left").withColumn("component", F.coalesce("component", "id"))
    order = core.join(points.select("id", F.col(first).alias("_first")), "id").groupBy("group", "component").agg(F.min("_first").alias("_first"))
    order = order.select("component", (F.dense_rank().over(Window.partitionBy("group").orderBy("_first")) - 1).cast("long").alias("cluster"))
    core = cut(core.join(order, "component").select("id", "cluster"))
    if min_samples <= 2:
        return core
    return core.unionByName(border_clusters(rows.join(core, "id", "left"), pairs, blocks, eps))
