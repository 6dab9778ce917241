"""A tree of boxes over points in any number of dimensions, grown and searched by rounds of joins.

A crowded box is cut along its widest axis at approximate quantiles, so every round divides the points by up to ``WAYS`` and
a box that cannot be cut holds one place only. Nodes are named by their path: the ancestors of a node are its prefixes. Two
searches go down the tree from the root: all pairs of boxes for a fixed distance, and the boxes within the reach of a leaf.
Bounds come from boxes and only spare work: what is near is always decided on the points themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut_lineage, small_side

WAYS = 8
LEAF = 1_000  # points that one task compares with those of another leaf
ROOT = "r"
SLACK = 1e-12  # bounds give way by this share, so that rounding never loses a pair
VISITS = 20_000  # points that meet one copy of a leaf
BLOCK = 2_000  # boxes that are compared with those of another block in one piece


@dataclass
class Tree:
    """points: pid, w (rows at the point), x (coordinates), leaf and further columns; nodes: node, k, w, lo, hi, leaf."""

    points: DataFrame
    nodes: DataFrame

    def children(self) -> DataFrame:
        """parent, child and the child's box."""
        parent = F.expr("substring(node, 1, length(node) - 1)")
        return self.nodes.where(F.col("node") != ROOT).select(parent.alias("parent"), *[F.col(c).alias(f"child_{c}")
                                                                                      for c in ("node", "leaf", "w", "lo", "hi")])


def box(d: int) -> list[Column]:
    """Aggregates lo and hi: the corners of the smallest box around the points of a group."""
    return [F.array(*[f(F.col("x")[i]) for i in range(d)]).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]


def grow(points: DataFrame, d: int, most: int = LEAF, ways: int = WAYS) -> Tree:
    """The tree of points with pid, w, x (array of ``d`` doubles; no two points equal), at most ``most`` points per leaf."""
    open_points, done, nodes = cut_lineage(points.withColumn("node", F.lit(ROOT))), [], []
    while True:
        boxes = open_points.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), *box(d))
        boxes = cut_lineage(boxes.withColumn("leaf", F.col("k") <= most))
        nodes.append(boxes)
        if boxes.where("not leaf").isEmpty():
            done.append(open_points)
            break
        extent = F.zip_with("hi", "lo", lambda a, b: a - b)
        axis = F.array_position(extent, F.array_max(extent)).cast("int")
        wide = small_side(boxes.where("not leaf").select("node", axis.alias("axis"), F.element_at("hi", axis).alias("top")))
        at = F.element_at("x", F.col("axis"))
        steps = F.percentile_approx(at, [i / ways for i in range(1, ways)], 1_000)
        cuts = open_points.join(wide, "node").groupBy("node", "axis", "top").agg(steps.alias("steps")).select(
            "node", "axis", "top", F.filter(F.array_distinct("steps"), lambda c: c < F.col("top")).alias("cuts"))
        # most values on the highest one: it is cut off by itself
        child = F.when(F.size("cuts") > 0, F.size(F.filter("cuts", lambda c: at > c))).otherwise((at >= F.col("top")).cast("int"))
        moved = open_points.join(small_side(cut_lineage(cuts)), "node", "left").select(
            *points.columns, F.when(F.col("axis").isNull(), F.col("node")).otherwise(F.concat("node", child.cast("string"))).alias("node"),
            F.col("axis").isNotNull().alias("more"))
        moved = cut_lineage(moved)
        done.append(moved.where("not more").drop("more"))
        open_points = moved.where("more").drop("more")
    return Tree(reduce(DataFrame.unionByName, done).withColumnRenamed("node", "leaf"), cut_lineage(reduce(DataFrame.unionByName, nodes)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def nearest_square(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Square of the least distance between two boxes."""
    gap = F.zip_with(F.zip_with(lo_a, hi_b, lambda p, q: p - q), F.zip_with(lo_b, hi_a, lambda p, q: p - q),
                     lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return _sum(F.transform(gap, lambda g: g * g))


def furthest_square(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Square of the largest distance between points of two boxes."""
    far = F.zip_with(F.zip_with(hi_a, lo_b, lambda p, q: p - q), F.zip_with(hi_b, lo_a, lambda p, q: p - q),
                     lambda p, q: F.greatest(p, q))
    return _sum(F.transform(far, lambda g: g * g))


def bounds(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(some, all): whether some and whether all points of two boxes may lie within the radius of each other's; shapes as numpy
    combines them, axes last and added up one by one."""
    near = far = 0.0
    for i in range(lo_a.shape[-1]):
        la, ha, lb, hb = lo_a[..., i], hi_a[..., i], lo_b[..., i], hi_b[..., i]
        near = near + np.maximum(np.maximum(la - hb, lb - ha), 0.0) ** 2
        far = far + np.maximum(ha - lb, hb - la) ** 2
    return near <= radius * radius * (1 + SLACK), far <= radius * radius * (1 - SLACK)


def within(pairs: DataFrame, lo_a: str, hi_a: str, lo_b: str, hi_b: str, radius: float) -> DataFrame:
    """The pairs of boxes that may hold points within the radius, and whether all of both lie within it (``full``)."""
    def judge(batches):
        for pdf in batches:
            if len(pdf):
                some, every = bounds(*(np.stack(pdf[c]) for c in (lo_a, hi_a, lo_b, hi_b)), radius)
                yield pdf.assign(full=every)[some]

    return pairs.mapInPandas(judge, T.StructType([*pairs.schema.fields, T.StructField("full", T.BooleanType())]))


def joined_boxes(asked: DataFrame, there: DataFrame, above: DataFrame, d: int, radius: float, meet, schema: str) -> DataFrame:
    """``meet(asked, there)`` for blocks of boxes that lie within the radius of each other.

    Both frames have leaf, lo, hi and what else they carry; ``above`` has the nodes above every leaf. A block is a node with at
    most ``BLOCK`` boxes below it, so that its boxes are compared in one piece.
    """
    load = asked.select("leaf").unionByName(there.select("leaf")).join(above, "leaf").groupBy("node").agg(F.count(F.lit(1)).alias("boxes"))
    blocks = above.join(load, "node").where((F.col("boxes") <= BLOCK) | (F.col("node") == F.col("leaf"))).groupBy("leaf").agg(
        F.min_by("node", F.length("node")).alias("block"))
    blocks = small_side(cut_lineage(blocks))
    left, right = (cut_lineage(table.join(blocks, "leaf")) for table in (asked, there))
    sides = [t.groupBy("block").agg(F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias(f"{s}_lo"),
                                    F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias(f"{s}_hi"))
             .withColumnRenamed("block", f"{s}_block") for s, t in (("a", left), ("b", right))]
    pairs = within(sides[0].crossJoin(sides[1]), "a_lo", "a_hi", "b_lo", "b_hi", radius).select("a_block", "b_block")
    pairs = small_side(cut_lineage(pairs))
    left = left.join(pairs, F.col("block") == F.col("a_block")).drop("block")
    right = right.join(pairs, F.col("block") == F.col("b_block")).drop("block")
    right = right.toDF(*[f"h_{c}" for c in right.columns])  # both may come from one table

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _empty(schema)
        b = b.rename(columns=lambda c: c.removeprefix("h_"))
        return pd.concat([meet(a.iloc[i:i + 500], b) for i in range(0, len(a), 500)])

    return left.groupBy("a_block", "b_block").cogroup(right.groupBy("h_a_block", "h_b_block")).applyInPandas(compare, schema)


def near(a: pd.DataFrame, b: pd.DataFrame, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` of all boxes of ``a`` with all of ``b``."""
    la, ha, lb, hb = (np.stack(t[c]) for t in (a, b) for c in ("lo", "hi"))
    return bounds(la[:, None], ha[:, None], lb[None], hb[None], radius)


def pairs_within(tree: Tree, radius: float) -> tuple[DataFrame, DataFrame]:
    """(full, open) pairs a <= b of nodes that together hold every pair of points within the radius, each once.

    All points of a full pair are within the radius of each other's, whatever the nodes hold; an open pair is two leaves whose
    points have to be compared. A dense region is a few full pairs of large nodes.
    """
    box, children = tree.nodes.select("node", "leaf", "w", "lo", "hi"), cut_lineage(tree.children())
    sides = [box.select(*[F.col(c).alias(f"{s}_{c}") for c in box.columns]) for s in "ab"]
    start = sides[0].where(F.col("a_node") == ROOT).join(sides[1].where(F.col("b_node") == ROOT), F.col("a_node") == F.col("b_node"))
    now, full, opened = start, [], []
    square = radius * radius
    names = ["a_node", "b_node", "a_w", "b_w"]
    while True:
        boxes = ("a_lo", "a_hi", "b_lo", "b_hi")
        judged = cut_lineage(now.withColumn("full", furthest_square(*boxes) <= square * (1 - SLACK)).where(
            nearest_square(*boxes) <= square * (1 + SLACK)))
        full.append(judged.where("full").select(*names))
        opened.append(judged.where("not full and a_leaf and b_leaf").select(*names))
        rest = judged.where("not full and not (a_leaf and b_leaf)")
        if rest.isEmpty():
            return cut_lineage(reduce(DataFrame.unionByName, full)), cut_lineage(reduce(DataFrame.unionByName, opened))
        same = F.col("a_node") == F.col("b_node")
        sided = rest.withColumn("same", same)
        for s in "ab":
            own = children.select(F.col("parent").alias(f"{s}_node"), *[F.col(f"child_{c}").alias(f"to_{c}") for c in (
                "node", "leaf", "w", "lo", "hi")])
            down = sided.where(f"not {s}_leaf").drop(*[f"{s}_{c}" for c in ("leaf", "w", "lo", "hi")]).join(
                own, f"{s}_node").drop(f"{s}_node").withColumnsRenamed({f"to_{c}": f"{s}_{c}" for c in box.columns})
            sided = sided.where(f"{s}_leaf").unionByName(down)
        now = sided.where("not same or a_node <= b_node").drop("same", "full")


def leaves_in_reach(tree: Tree, reach: DataFrame) -> DataFrame:
    """leaf, other: every other leaf whose box lies within r of the leaf's box, for ``reach`` with leaf and r."""
    children = cut_lineage(tree.children())
    own = tree.nodes.where("leaf").select(F.col("node").alias("leaf"), "lo", "hi")
    now, found = reach.join(own, "leaf").withColumn("at", F.lit(ROOT)), []
    while True:
        met = now.join(children, F.col("at") == F.col("parent")).where(
            nearest_square("lo", "hi", "child_lo", "child_hi") <= F.col("r") * F.col("r") * (1 + SLACK))
        met = cut_lineage(met.select("leaf", "r", "lo", "hi", F.col("child_node").alias("at"), "child_leaf"))
        found.append(met.where("child_leaf and at <> leaf").select("leaf", F.col("at").alias("other")))
        now = met.where("not child_leaf").drop("child_leaf")
        if now.isEmpty():
            return cut_lineage(reduce(DataFrame.unionByName, found))


def ancestors(node: str) -> Column:
    """The node and all nodes above it."""
    return F.expr(f"transform(sequence(1, length({node})), i -> substring({node}, 1, i))")


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all points of two leaves, added up axis by axis."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        total += (x[:, i, None] - y[None, :, i]) ** 2
    return total


KINDS = {"bigint": "int64", "double": "float64", "boolean": "bool"}


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({part.split()[0]: pd.Series(dtype=KINDS.get(part.split()[1], "object")) for part in schema.split(", ")})


def visited(visits: DataFrame, hosts: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(visitors, hosts)`` for the points of ``visits`` and those of the leaf each goes to, some visitors at a time.

    Visits have pid, leaf and x, hosts have leaf and x, both may have more. A leaf asked by very many points is copied, and
    each copy answers a bounded number of them.
    """
    load = small_side(cut_lineage(visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies"))))
    salted = visits.join(load, "leaf").withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("copies")).cast("int")).drop("copies")
    there = hosts.join(load, "leaf").withColumn("salt", F.explode(F.expr("sequence(0, copies - 1)"))).drop("copies")
    there = there.toDF(*[f"h_{c}" for c in there.columns])  # both may come from one table

    def meet(came: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if not len(came) or not len(host):
            return _empty(schema)
        host = host.rename(columns=lambda c: c.removeprefix("h_"))
        return pd.concat([answer(came.iloc[i:i + 500], host) for i in range(0, len(came), 500)])

    group = ["leaf", "salt"]
    return salted.groupBy(*group).cogroup(there.groupBy(*[f"h_{g}" for g in group])).applyInPandas(meet, schema)
