"""Masks, nearest-pixel fill and connected edges of patches, as Spark jobs over ``patch, y, x, v``.

Connected parts are found without holding a patch in a task: pixels become runs
of their row by a window, runs meet overlapping runs of the next row in an
equality join on patch and row, and ``components_in_parts`` joins them up, bands of rows first. Patches may have
any key; where it is a whole number it must be below 2 ** 39, and sides at most 4096
pixels, so that a pixel is one number. Places start at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.functions.patches import LAPLACE, SOBEL_X, SOBEL_Y, convolve, dealt, lbp_codes, neighbours
from facetwatch.operators.lineage import components, components_in_parts, cut

SIDE = 12
#: Rows of a patch, as a power of two, whose runs are joined up in one task.
BAND = 8
#: Tangent of 22.5 degrees in 15 bits, and thresholds of the edge measure.
TAN_22 = 13573
LOW, HIGH = 50, 150


def place_id(rows: DataFrame, x: str = "x") -> Column:
    """A name for each pixel of each patch that sorts in raster order: one number, or patch and place together."""
    if rows.schema["patch"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct("patch", F.col("y").cast("int").alias("y"), F.col(x).cast("int").alias("x"))
    return F.shiftleft(F.col("patch").cast("long"), 2 * SIDE) + F.shiftleft(F.col("y").cast("long"), SIDE) + F.col(x).cast("long")


def runs(pixels: DataFrame, bit: Column, mark: Column | None = None) -> DataFrame:
    """``patch, y, first, last, bit, node``: stretches of a row whose pixels have the same bit; ``node`` is the first pixel's number.

    With ``mark`` also ``any``: whether one of the pixels has it.
    """
    w = Window.partitionBy("patch", "y").orderBy("x")
    rows = pixels.select("patch", "y", "x", bit.alias("bit"), *([] if mark is None else [mark.alias("_mark")]))
    starts = F.coalesce((F.lag("bit").over(w) != F.col("bit")) | (F.lag("x").over(w) != F.col("x") - 1), F.lit(True))
    rows = rows.withColumn("_new", starts).withColumn("first", F.last(F.when(F.col("_new"), F.col("x")), ignorenulls=True).over(w))
    return rows.groupBy("patch", "y", "first", "bit").agg(F.max("x").alias("last"), *([] if mark is None else [F.max("_mark").alias("any")])).withColumn("node", place_id(pixels, "first"))


def _touching(a: DataFrame, b: DataFrame, slack: int = 0) -> DataFrame:
    """Node pairs of runs that lie above one another; ``slack`` 1 also links runs that meet at a corner."""
    low = b.select("patch", (F.col("y") - 1).alias("y"), *(F.col(c).alias(f"{c}_") for c in ("first", "last", "bit", "node")))
    both = a.join(low, ["patch", "y"]).where((F.col("first") <= F.col("last_") + slack) & (F.col("first_") <= F.col("last") + slack))
    return both.select(F.col("node").alias("a"), F.col("node_").alias("b"), "bit", "bit_")


def _labelled(parts: DataFrame, links: DataFrame, node: str = "node", label: str = "part") -> DataFrame:
    """``parts`` with the smallest node that each hangs together with."""
    # Pixels of a patch and some of its rows lie together: the number without its lower digits. Only links between such bands are left for rounds.
    band = (lambda c: F.shiftright(c, SIDE + BAND)) if links.schema["a"].dataType.simpleString() == "bigint" else None
    found = (components_in_parts(links, band) if band else components(links)).select(F.col("node").alias(node), F.col("component").alias(label))
    return parts.join(found, node, "left").withColumn(label, F.coalesce(label, node))


def patch_mask(pixels: DataFrame, threshold: float = 0) -> DataFrame:
    """``patch, y, x`` of the largest part above a threshold, its holes filled.

    Parts hang together by sides. A hole is background that does not reach the border of the
    patch. Holes are filled before the largest part is chosen; of equal parts the one
    whose first pixel in raster order comes first. A patch without a pixel above has no rows.
    """
    ends = pixels.groupBy("patch").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    found = cut(runs(pixels, F.col("v") > threshold))
    found = cut(_labelled(found, _touching(found, found).where("bit = bit_")).join(ends, "patch"))
    border = (F.col("y") == 0) | (F.col("y") == F.col("_h")) | (F.col("first") == 0) | (F.col("last") == F.col("_w"))
    outside = found.where(~F.col("bit")).groupBy("part").agg(F.max(border).alias("open")).where("open").select("part")
    inside = cut(found.drop("_h", "_w").join(outside, "part", "left_anti"))
    # Parts and holes that touch, above one another or side by side, are one part of the filled mask.
    names = inside.select("node", "part")
    above = _touching(inside, inside).where("bit <> bit_").select("a", "b")
    right = inside.select("patch", "y", (F.col("last") + 1).alias("first"), F.col("node").alias("a"))
    beside = right.join(inside.select("patch", "y", "first", F.col("node").alias("b")), ["patch", "y", "first"]).select("a", "b")
    links = above.unionByName(beside).join(names.select(F.col("node").alias("a"), F.col("part").alias("p")), "a").join(names.select(F.col("node").alias("b"), F.col("part").alias("q")), "b")
    whole = cut(_labelled(inside, links.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "part", "mask"))
    sizes = whole.groupBy("patch", "mask").agg(F.sum(F.col("last") - F.col("first") + 1).alias("size"))
    top = sizes.groupBy("patch").agg(F.min_by("mask", F.struct(-F.col("size"), "mask")).alias("mask"))
    return whole.join(top, ["patch", "mask"]).select("patch", "y", F.explode(F.sequence("first", "last")).alias("x"))


def padded(pixels: DataFrame, values: tuple[str, ...] = ("v",), mirror: bool = False) -> DataFrame:
    """``pixels`` with one more pixel on each side: the border's own, or with ``mirror`` the one behind it (a side of one pixel repeats it)."""
    w = Window.partitionBy("patch")
    rows = pixels.select("patch", "y", "x", *values, F.max("y").over(w).alias("_h"), F.max("x").over(w).alias("_w"))
    step = (lambda end: F.least(F.lit(1), F.col(end))) if mirror else (lambda end: F.lit(0))

    def spread(c: str, end: str) -> Column:
        before, after = F.when(F.col(c) == step(end), F.lit(-1)), F.when(F.col(c) == F.col(end) - step(end), F.col(end) + 1)
        return F.explode(F.array_compact(F.array(F.col(c), before, after)))

    return rows.withColumn("y", spread("y", "_h")).withColumn("x", spread("x", "_w")).drop("_h", "_w")


def gradients(pixels: DataFrame, mirror: bool = False) -> DataFrame:
    """``patch, y, x, gx, gy, lap`` of every pixel; ``mirror`` says what counts beyond the border, see ``padded``."""
    return convolve(pixels, {"gx": SOBEL_X, "gy": SOBEL_Y, "lap": LAPLACE}, border="mirror" if mirror else "repeat")


#: Weight of the trace in the corner measure, and the share of the largest that makes a corner.
CORNER_K, CORNER_SHARE = 0.04, 0.01


def corners(pixels: DataFrame) -> DataFrame:
    """``patch, direction_std, corner_density``: spread of the gradient's direction, and the share of pixels with a strong corner measure.

    The structure tensor is a second sum, over squares of two by two pixels, of products of
    gradients; a corner's measure is above a hundredth of the largest in its patch.
    """
    g = gradients(pixels, mirror=True)
    turns = g.groupBy("patch").agg(F.stddev_pop(F.atan2("gy", "gx")).alias("direction_std"))
    parts = ("xx", "yy", "xy")
    products = padded(g.select("patch", "y", "x", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy")), parts, mirror=True)
    spread = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1)).alias(c)
    sums = products.select("patch", spread("y"), "x", *parts).select("patch", "y", spread("x"), *parts).groupBy("patch", "y", "x").agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in parts))
    # Squares reach one pixel up and left; those below the lower and right border are of no pixel.
    ends = pixels.groupBy("patch").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    sums = sums.join(ends, "patch").where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= F.col("_h")) & (F.col("x") <= F.col("_w")))
    trace = F.col("xx") + F.col("yy")
    scored = sums.withColumn("_r", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - CORNER_K * trace * trace)
    top = F.max("_r").over(Window.partitionBy("patch"))
    share = scored.withColumn("_c", (F.col("_r") > CORNER_SHARE * top).cast("double")).groupBy("patch").agg(F.avg("_c").alias("corner_density"))
    return turns.join(share, "patch")


AROUND = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def thin_edges(gradient: DataFrame) -> DataFrame:
    """``patch, y, x, m``: pixels whose ``m = |gx| + |gy|`` is the largest across the edge.

    Along rows and columns the second of two equal neighbours counts as smaller, across
    corners both must be smaller; beyond the border the strength is 0.
    """
    ax, ay = F.abs("gx"), F.abs("gy")
    way = F.when(ay * (1 << 15) < ax * TAN_22, 0).when(ay * (1 << 15) > ax * (TAN_22 + (1 << 16)), 1).when((F.col("gx") < 0) != (F.col("gy") < 0), 2).otherwise(3)
    rows = gradient.select("patch", "y", "x", (ax + ay).alias("m"), way.alias("way"))
    near = neighbours(rows, "m", AROUND, ["way"], F.lit(0.0))
    m = F.col("m")
    top = [(m > F.col("w")) & (m >= F.col("e")), (m > F.col("n")) & (m >= F.col("s")), (m > F.col("ne")) & (m > F.col("sw")), (m > F.col("nw")) & (m > F.col("se"))]
    chosen = F.when(F.col("way") == 0, top[0]).when(F.col("way") == 1, top[1]).when(F.col("way") == 2, top[2]).otherwise(top[3])
    return near.where(chosen).select("patch", "y", "x", "m")


def canny(gradient: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``patch, y, x`` of edge pixels: thin edges above ``low`` that hang together, by sides or corners, with one above ``high``."""
    # The strongest pixel of a line goes with it, so that no pixel is looked up afterwards, and lines are made where the thin edges are.
    lines = cut(runs(thin_edges(gradient).where(F.col("m") > low), F.lit(True), F.col("m") > high))
    parts = cut(_labelled(lines, _touching(lines, lines, slack=1).select("a", "b")))
    seeds = parts.where("any").select("part").distinct()
    return parts.join(seeds, "part", "left_semi").select("patch", "y", F.explode(F.sequence("first", "last")).alias("x"))


def edge_density(pixels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``patch, edge_density``: the share of pixels on edges."""
    hits = canny(gradients(pixels), low, high).groupBy("patch").agg(F.count("*").alias("_e"))
    return pixels.groupBy("patch").agg(F.count("*").alias("_n")).join(hits, "patch", "left").select("patch", (F.coalesce("_e", F.lit(0)) / F.col("_n")).alias("edge_density"))


def nearest_inside(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """``pixels`` with ``from_y, from_x`` and ``v`` of the nearest pixel in the mask: exact Euclidean distance, of equal ones the first in raster order.

    Two passes: up and down each column by windows, then along each row over the row's
    columns, which are one array. Patches without a mask have no rows.
    """
    rows = pixels.select("patch", "y", "x", "v").join(mask.select("patch", "y", "x", F.lit(True).alias("_in")), ["patch", "y", "x"], "left")
    w = Window.partitionBy("patch", "x").orderBy("y")
    # A pixel of the mask goes with its level, so that no level is looked up afterwards.
    here = F.when(F.col("_in"), F.struct("y", "v"))
    up = F.last(here, ignorenulls=True).over(w)
    down = F.first(here, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    columns = rows.select("patch", "y", "x", up.alias("_up"), down.alias("_down"))
    near = F.when(F.col("_down").isNull() | (F.col("y") - F.col("_up.y") <= F.col("_down.y") - F.col("y")), F.col("_up")).otherwise(F.col("_down"))
    columns = columns.select("patch", "y", "x", near.alias("_near"))
    lines = columns.groupBy("patch", "y").agg(F.collect_list("x").alias("_xs"), F.collect_list(F.when(F.col("_near").isNotNull(), F.struct(F.col("x").cast("long").alias("x"), F.col("_near.y").cast("long").alias("y"), F.col("_near.v").alias("v")))).alias("_line"))
    spread = lines.where(F.size("_line") > 0).select("patch", "y", F.explode("_xs").alias("x"), "_line")
    best = F.array_min(F.transform("_line", lambda c: F.struct(((c["x"] - F.col("x")) * (c["x"] - F.col("x")) + (c["y"] - F.col("y")) * (c["y"] - F.col("y"))).alias("d"), c["y"].alias("y"), c["x"].alias("x"), c["v"].alias("v"))))
    out = spread.select("patch", "y", "x", best.alias("_b"))
    return out.select("patch", "y", "x", F.col("_b.y").alias("from_y"), F.col("_b.x").alias("from_x"), F.col("_b.v").alias("v"))


def core(mask: DataFrame, radius: int = 1) -> DataFrame:
    """``patch, y, x`` of mask pixels whose whole square of neighbours is in the mask."""
    spread = lambda c: F.explode(F.array(*(F.col(c) + d for d in range(-radius, radius + 1)))).alias(c)
    sent = mask.select("patch", spread("y"), "x").select("patch", "y", spread("x"))
    return sent.groupBy("patch", "y", "x").agg(F.count("*").alias("_n")).where(F.col("_n") == (2 * radius + 1) ** 2).drop("_n")


def masked_edges(pixels: DataFrame, mask: DataFrame, least: int = 10) -> DataFrame:
    """``patch, core_pixels, sobel_mean, laplacian_mean, laplacian_std, edge_density`` over the core of the mask.

    Background is taken from the nearest pixel inside, so that the mask's border is no edge.
    NULL below ``least`` pixels in the core; patches without a mask have no row.
    """
    filled = cut(nearest_inside(pixels, mask).select("patch", "y", "x", "v"))
    slopes = cut(gradients(dealt(filled)))
    edge = canny(slopes).withColumn("_e", F.lit(1))
    inner = slopes.join(core(mask), ["patch", "y", "x"]).join(edge, ["patch", "y", "x"], "left")
    mag, lap = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.abs("lap")
    out = inner.groupBy("patch").agg(F.count("*").alias("n"), F.avg(mag).alias("sobel_mean"), F.avg(lap).alias("laplacian_mean"), F.stddev_pop(lap).alias("laplacian_std"), (F.count("_e") / F.count("*")).alias("edge_density"))
    n = F.coalesce("n", F.lit(0))
    return mask.select("patch").distinct().join(out, "patch", "left").select("patch", n.alias("core_pixels"), *(F.when(n >= least, F.col(c)).alias(c) for c in ("sobel_mean", "laplacian_mean", "laplacian_std", "edge_density")))


def masked_lbp(pixels: DataFrame, mask: DataFrame, points: int = 8, radius: int = 1, least: int = 20) -> DataFrame:
    """``patch, core_pixels, lbp_entropy, lbp_nonuniform`` of the patterns over the core of the mask, which is eroded by ``radius``.

    NULL below ``least`` pixels in the core; patches without a mask have no row.
    """
    codes = lbp_codes(pixels, points, float(radius)).join(core(mask, radius), ["patch", "y", "x"])
    counts = codes.groupBy("patch", "code").agg(F.count("*").cast("double").alias("_n"))
    n, t = F.col("_n"), F.sum("_n")
    out = counts.groupBy("patch").agg(t.cast("long").alias("n"), (F.log2(t) - F.sum(n * F.log2(n)) / t).alias("lbp_entropy"), (F.sum(F.when(F.col("code") == points + 1, n).otherwise(0.0)) / t).alias("lbp_nonuniform"))
    size = F.coalesce("n", F.lit(0))
    return mask.select("patch").distinct().join(out, "patch", "left").select("patch", size.alias("core_pixels"), *(F.when(size >= least, F.col(c)).alias(c) for c in ("lbp_entropy", "lbp_nonuniform")))
