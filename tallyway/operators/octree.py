"""Point clouds as an octree: building the levels of detail, descending the hierarchy of nodes, reading points at a density.

A node is (depth, kx, ky, kz), the cube of side root.side / 2**depth in that place. Its grid has ``span`` cells a side and each cell holds one
point at most, so the nodes down to a depth are an even sample of the whole cloud, finer with each level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.operators.iterate import cut

KEY = ("depth", "kx", "ky", "kz")
#: Depth whose nodes name the folders of a store; deeper nodes lie in their ancestor's.
FOLDER_DEPTH = 3
#: Classes that are kept: everything but noise and what was withheld.
KEPT_CLASSES = (1, 2, 3, 4, 5, 6, 9)


@dataclass(frozen=True)
class Root:
    """The cube of the root node."""

    x: float
    y: float
    z: float
    side: float
    span: int = 128

    def spacing(self, depth: int) -> float:
        """Distance of neighbouring points of all depths down to this one."""
        return self.side / (self.span * 2**depth)

    def depth_for(self, density: float) -> int:
        """The shallowest depth that has ``density`` points a square unit."""
        return max(0, math.ceil(math.log2(self.side * math.sqrt(density) / self.span)))


@dataclass(frozen=True)
class Box:
    """A box seen from above, without its upper edges."""

    x0: float
    y0: float
    x1: float
    y1: float

    def holds(self) -> Column:
        return (F.col("x") >= self.x0) & (F.col("x") < self.x1) & (F.col("y") >= self.y0) & (F.col("y") < self.y1)


def _cells(root: Root, depth: int, per_side: int) -> list[Column]:
    """Place of a point among the cells of a depth; points on the root's upper faces count to the last cell."""
    most = per_side * 2**depth
    at = lambda c, low: F.least(F.greatest(F.floor((F.col(c) - low) * most / root.side), F.lit(0)), F.lit(most - 1)).cast("bigint")
    return [at("x", root.x), at("y", root.y), at("z", root.z)]


def built(points: DataFrame, root: Root, depth: int, key: str) -> DataFrame:
    """``points`` with the node that holds each: the shallowest whose cell no point of smaller ``key`` (unique) holds; at ``depth`` all that are left.

    A level is one aggregate over cells, combined before it is shuffled, and what it took leaves by key, so that a crowded cell
    makes no task large.
    """
    left, placed = cut(points.select(key, "x", "y", "z")), []
    for d in range(depth):
        taken = cut(left.groupBy(*[c.alias(n) for c, n in zip(_cells(root, d, root.span), ("cx", "cy", "cz"), strict=True)]).agg(F.min(key).alias(key)))
        placed.append(taken.select(key, F.lit(d).alias("depth")))
        left = cut(left.join(taken.select(key), key, "left_anti"))
        if left.isEmpty():
            break
    depths = reduce(DataFrame.unionByName, [*placed, left.select(key, F.lit(depth).alias("depth"))])
    by_depth = F.array(*[F.array(*_cells(root, d, 1)) for d in range(depth + 1)])
    node = F.element_at(by_depth, F.col("depth") + 1)
    return points.join(depths, key).withColumn("node", node).select(*points.columns, "depth", *[F.col("node")[k].alias(n) for k, n in enumerate(KEY[1:])])


def hierarchy(store: DataFrame) -> DataFrame:
    """Each node that has points, and how many."""
    return store.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def overlaps(root: Root, box: Box) -> Column:
    """Whether the node's cube, seen from above, overlaps the box; touching isn't overlapping."""
    step = root.side / F.pow(F.lit(2.0), F.col("depth"))
    x0, y0 = root.x + step * F.col("kx"), root.y + step * F.col("ky")
    return (x0 < box.x1) & (x0 + step > box.x0) & (y0 < box.y1) & (y0 + step > box.y0)


def descended(nodes: DataFrame, root: Root, box: Box, depth: int) -> DataFrame:
    """The nodes of ``nodes(depth, kx, ky, kz, n)`` that overlap ``box`` down to ``depth`` and are reached from the root.

    Level by level the children of what was found are joined to the hierarchy; below a node without points or outside of the box nothing is
    looked at. The frames grow with what the box holds, and each level asks for its own depth alone.
    """
    fits = overlaps(root, box) & (F.col("n") > 0)
    level = cut(nodes.filter("depth = 0").filter(fits))
    found, halves = [level], F.array(F.lit(0), F.lit(1))
    for d in range(1, depth + 1):
        if level.isEmpty():
            break
        children = level.select("kx", "ky", "kz")
        for c in ("kx", "ky", "kz"):
            children = children.withColumn("half", F.explode(halves)).withColumn(c, F.col(c) * 2 + F.col("half")).drop("half")
        level = cut(nodes.filter(F.col("depth") == d).filter(fits).join(children, ["kx", "ky", "kz"]).select(*KEY, "n"))
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def folder() -> Column:
    """The store's folder of a node: its ancestor at FOLDER_DEPTH, or itself, as one number of a Morton-like order."""
    up = F.greatest(F.col("depth") - FOLDER_DEPTH, F.lit(0)).cast("int")
    part = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), up)).cast("bigint")
    return (part("kx") * 4**FOLDER_DEPTH + part("ky") * 2**FOLDER_DEPTH + part("kz")).cast("int")


def written(store: DataFrame, path: str) -> None:
    """The store by depth and folder, a bounded number of both; rows of a node lie together in it. Large folders are split among tasks."""
    rows = store.withColumn("folder", folder())
    rows.hint("rebalance", "depth", "folder").sortWithinPartitions("depth", "folder", *KEY[1:]).write.mode("overwrite").partitionBy("depth", "folder").parquet(path)


def keys_written(keys: DataFrame, path: str) -> DataFrame:
    """Descended keys with their folders, as a table whose filter prunes the store's folders at run time."""
    keys.withColumn("folder", folder()).write.mode("overwrite").parquet(path)
    return keys.sparkSession.read.parquet(path).filter("n > 0")


def read_nodes(store: DataFrame, keys: DataFrame, box: Box, classes: tuple[int, ...] = KEPT_CLASSES) -> DataFrame:
    """Points of the nodes in ``keys`` (as of ``keys_written``) that lie in the box and have one of the classes.

    ``store`` is what ``written`` wrote. Keys are joined on depth and folder too, by which its folders are pruned before they are read.
    """
    return store.filter(box.holds() & F.col("cls").isin(*classes)).join(keys.drop("n"), ["depth", "folder", "kx", "ky", "kz"]).drop("folder")
