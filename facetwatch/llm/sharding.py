"""Sharding by a weighted hash tree: region, rack, shard.

A node of the tree has children with weights; a leaf is a shard and its weight
its share of the rows, an inner node weighs as much as its leaves. A key
descends from the root: each child draws ``ln(u) / weight`` with ``u`` in (0, 1)
from the hash of key and child, and the largest draw is entered. So a child gets
keys in proportion to its weight, a draw hangs on nothing but key, child and
weight, and a changed weight moves keys only into or out of the subtrees that
hold the change; elsewhere all draws stay as they were:

* weights that shift within a rack move keys within that rack only;
* one more shard in a rack moves keys into its region only;
* :func:`grown` puts one more shard into a region of its own, so the only keys
  that move are those that enter the new shard: the ``key`` law.

Scale. A shard is found per row by hashing (built-in functions, no shuffle, no
state), so texts never move. :func:`numbered` gives gapless slots with one
shuffle of a few numbers per row: rows that agree in all of them are counted
before they move, a shard is cut into buckets by hash, each bucket is numbered
on its own, and buckets are put behind one another by the running sum of their
counts. So neither a large shard nor a repeated row becomes one task's sort.

Defined cases: null ids share one key (the hash of nothing) and so one shard;
rows that repeat an id go to one shard and have slots of their own; null text has
no bytes and the CRC-32 of nothing (0), its size is 1; ids that are equal as text
(1 and '1') go alike; other columns are ignored by the digest and kept by
:func:`place`, whose result columns replace columns of their names; an empty
table gives an empty result. Weights must be above 0.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetwatch.llm.common import cut

#: A node: children by name, or the weight of a shard.
Tree = Union[Mapping[str, "Tree"], float, int]
LEVELS = ("region", "rack")


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """A tree of equal shards, named by their numbers in order."""
    number = iter(range(regions * racks * shards))
    return {f"r{r}": {f"r{r}k{k}": {str(next(number)): 1.0 for _ in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree, shard: int | str, weight: float = 1.0) -> Tree:
    """The tree with one more shard as a rack and region of its own; keys move into it and nowhere else."""
    if str(shard) in leaves(tree):
        raise ValueError(f"shard {shard} is in the tree")
    return {**tree, f"r+{shard}": {f"r+{shard}k": {str(shard): weight}}}


def leaves(tree: Tree) -> list[str]:
    """Names of the shards."""
    return [x for name, below in tree.items() for x in (leaves(below) if isinstance(below, Mapping) else [name])]


def weight(tree: Tree) -> float:
    """Sum of the weights below a node."""
    total = float(sum(map(weight, tree.values()))) if isinstance(tree, Mapping) else float(tree)
    if not total > 0:
        raise ValueError("weights must be above 0")
    return total


def _tables(tree: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children and weights of each node; the root is ''."""
    out, here = [], {"": tree}
    while any(isinstance(x, Mapping) for x in here.values()):
        if not all(isinstance(x, Mapping) for x in here.values()):
            raise ValueError("all shards must lie at the same depth")
        out.append({name: [(child, weight(below)) for child, below in node.items()] for name, node in here.items()})
        here = {child: below for node in here.values() for child, below in node.items()}
        if len(here) < sum(len(x) for x in out[-1].values()):
            raise ValueError("nodes of a level need names of their own")
    return out


def draw(key: Column, child: Column, share: Column) -> Column:
    """``ln(u) / weight``; u from the upper 53 bits of the hash of key and child."""
    u = (F.shiftrightunsigned(F.xxhash64(key, child), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.log(u) / share


def path(key: Column, tree: Tree) -> list[Column]:
    """The node that a key enters at each level, the shard last; equal draws go to the larger name."""
    out: list[Column] = []
    at = F.lit("")
    for nodes in _tables(tree):
        entries = [x for name, kids in nodes.items() for x in (F.lit(name), F.array(*(F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in kids)))]
        kids = F.element_at(F.create_map(*entries), at)
        at = F.array_max(F.transform(kids, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]
        out.append(at)
    return out


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, and ``region`` and ``rack`` where the tree has three levels; all columns stay."""
    steps = path(F.col(id_col).cast("string"), tree)
    return docs.withColumns(dict(zip(LEVELS if len(steps) == 3 else (), steps)) | {shard_col: steps[-1]})


def numbered(rows: DataFrame, shard_col: str, slot_col: str = "slot", bucket_rows: int = 1_000_000) -> DataFrame:
    """Narrow rows with a slot from 0 in their shard, without gaps; in order of hash bucket and values.

    Rows that agree in all columns are one group until they get their slots. A
    shard has one bucket for ``bucket_rows`` different rows of the whole table, at least 64.
    """
    names = rows.columns
    groups = cut(rows.groupBy(*names).agg(F.count("*").alias("_n")))
    buckets = max(64, groups.count() // bucket_rows)
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*(c for c in names if c != shard_col)), F.lit(buckets)))
    counts = groups.groupBy(shard_col, "_bucket").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(shard_col).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard_col, "_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    groups = groups.join(counts, F.col(shard_col).eqNullSafe(F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    first = F.col("_first") + F.col("_before")
    return groups.select(*names, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(slot_col))


def shard_digest(docs: DataFrame, tree: Tree | None = None, one_more: int | None = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, CRC-32 of the text, law, region, rack, shard, slot, and the shard with one more."""
    tree = even_tree() if tree is None else tree
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = place(rows, tree)
    if one_more is not None:
        rows = rows.withColumn("grown_shard", path(F.col("doc_id").cast("string"), grown(tree, one_more))[-1])
    return numbered(rows, "shard").withColumn("law", F.lit("key"))
