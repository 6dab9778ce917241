"""Density and isolation based anomaly detection and clustering, distributed by space or by tree."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.functions import space
from sightline.functions.counts import row_hash
from sightline.functions.quantiles import exact_quantiles
from sightline.functions.ranks import with_position
from sightline.operators.models import Projection, complete_rows, standard_columns
from sightline.session import cut_lineage, small_side
from sightline.types import num, numeric_names

SEED = 42
SUBSAMPLE = 256
GRID_LIMIT = 3  # dimensions up to which DBSCAN cuts space into cells; beyond, a point has too many cells around it and lies in a tree of boxes
GRID_AXES = 3  # axes by which cells are looked up; distances always use all of them


# ---------------------------------------------------------------- isolation forest

def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _grow(x: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree as rows (node, feature, cut, left, right, expected depth)."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, depth + _path_length(len(rows))])
        if parent >= 0:
            nodes[parent][3 + side] = me
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (None, None)
        if depth >= limit or len(rows) <= 1 or not (high > low).any():
            continue
        feature = int(rng.choice(np.flatnonzero(high > low)))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes = part[:, feature] < cut
        nodes[me][1:3] = [feature, cut]
        stack += [(rows[goes], depth + 1, me, 0), (rows[~goes], depth + 1, me, 1)]
    return [tuple(n) for n in nodes]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers spread over their whole range, each in a way of its own (an invertible mix of shifts and products)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """The ``step``-th number in (0, 1) of each key's own series."""
    with np.errstate(over="ignore"):
        state = keys + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mixed(state) >> np.uint64(11)).astype("float64") + 0.5) * 2.0 ** -53


def _drawn(keys: np.ndarray, copies: np.ndarray, first: np.ndarray, trees: int, rate: float) -> list[tuple]:
    """(key, tree, draw) of the copies that enter a tree, each copy with probability ``rate`` in every tree.

    The places tree by tree and copy by copy are passed in jumps of geometric length, so the work is that of the draws made;
    ``first`` decides the first jump. ``draw`` orders the rows of a tree at random.
    """
    out, per_log = [], 1.0 / math.log1p(-rate) if rate < 1.0 else 0.0
    open_rows = np.arange(len(keys))
    place, u, step = np.zeros(len(keys)), first, 0
    while len(open_rows):
        place = place + np.floor(np.log(u) * per_log)
        inside = place < trees * copies[open_rows]
        open_rows, place = open_rows[inside], place[inside]
        draws = _uniform(keys[open_rows], 2 * step + 1)
        out += list(zip(keys[open_rows].view("int64").tolist(), (place // copies[open_rows]).astype("int64").tolist(), draws.tolist()))
        place, u, step = place + 1, _uniform(keys[open_rows], 2 * step + 2), step + 1
    return out


def _subsamples(rows: DataFrame, names: list[str], n: int, size: int, trees: int, seed: int) -> DataFrame:
    """tree, draw, x: a little more than ``size`` random rows for every tree, decided by hashes of whole rows only.

    Whatever the partitioning, the same rows are drawn. Copies of a row are counted (eight bytes a row are shuffled) and drawn
    one by one, so a row that fills a third of the table fills a third of every sample. The draws are bounded by trees and
    sample size; the values of the rows drawn come from a second scan.
    """
    rate = min(1.0, (size + 6 * math.sqrt(size)) / n)
    hashed = rows.withColumn("_h", row_hash(rows))
    counted = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("copies"))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_h"), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    # the first jump stays inside trees * copies places for the rows that are drawn at all
    reach = F.lit(trees).cast("double") * F.col("copies") * F.lit(math.log1p(-rate) if rate < 1.0 else 0.0)
    candidates = counted.withColumn("_u", unit).filter((F.lit(rate) >= 1.0) | (F.ln("_u") > reach))

    def draw(batches):
        for pdf in batches:
            made = _drawn(pdf["_h"].to_numpy().view("uint64") ^ np.uint64(seed), pdf["copies"].to_numpy(),
                          pdf["_u"].to_numpy(), trees, rate)
            keys = np.array([m[0] for m in made], dtype="int64").view("uint64") ^ np.uint64(seed)
            yield pd.DataFrame({"_h": keys.view("int64"), "tree": np.array([m[1] for m in made], dtype="int64"),
                                "draw": np.array([m[2] for m in made], dtype="float64")})

    drawn = cut_lineage(candidates.mapInPandas(draw, "_h bigint, tree bigint, draw double"))
    # rows of one hash are equal but for collisions, of which the least counts
    values = hashed.join(F.broadcast(drawn.select("_h").distinct()), "_h").groupBy("_h").agg(
        F.min(F.array(*[num(c) for c in names])).alias("x"))
    return drawn.join(values, "_h").select("tree", "draw", "x")


def isolation_forest(df: DataFrame, names: list[str] | None = None, trees: int = 100, contamination: float = 0.05,
                     seed: int = SEED) -> DataFrame:
    """Rows with an anomaly score in (0, 1) and a label: -1 for the most isolated share, else 1.

    Every tree is grown in its own task from the rows with the smallest draws, a bounded subsample that depends on the rows'
    content and the seed alone; the forest (at most ``trees * (2 * 256 - 1)`` nodes) is small enough to ship with the scoring
    function. The same table gets the same scores however it is partitioned.
    """
    names = names or numeric_names(df)
    rows = complete_rows(df, names)
    n = rows.count()
    if n == 0:
        return rows.withColumns({"score": F.lit(None).cast("double"), "label": F.lit(None).cast("int")})
    size = min(SUBSAMPLE, n)
    picked = _subsamples(rows, names, n, size, trees, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(x=pdf["x"].map(tuple)).sort_values(["draw", "x"]).head(size)
        tree = int(pdf["tree"].iloc[0])
        made = _grow(np.stack(pdf["x"].to_numpy()), seed * 1000 + tree)
        return pd.DataFrame([(tree, *m) for m in made],
                            columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    nodes = picked.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()  # bounded by trees and subsample
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    forest = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(),
               g["depth"].to_numpy()) for g in forest]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = max(_path_length(size), 1e-12)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        total = np.zeros(len(x))
        everyone = np.arange(len(x))
        for feature, cut, left, right, depth in shared.value:
            at = np.zeros(len(x), dtype="int64")
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[everyone, np.where(inner, f, 0)] < cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(shared.value) / norm))

    scored = rows.withColumn("score", score(*[num(c) for c in names]))
    limit = exact_quantiles(scored.select("score"), ["score"], (1.0 - contamination,))["score"][0]
    return scored.withColumn("label", F.when(F.col("score") > limit, -1).otherwise(1))


def anomaly_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- shared: standardised points and grid cells

def _points(df: DataFrame, names: list[str], scale: bool, components: int | None) -> tuple[DataFrame, list[Column]]:
    """Complete rows and their coordinates: all columns, standardised if asked, or that many principal components."""
    rows = complete_rows(df, names)
    if components is not None and components < len(names):
        return rows, Projection.fit(df, names, components).columns()
    return rows, standard_columns(rows, names) if scale else [num(c) for c in names]


def _distinct_points(rows: DataFrame, coords: list[Column]) -> tuple[DataFrame, list[str]]:
    """Distinct coordinates with their number of rows: copies of a point are counted, never compared."""
    axes = [f"x{i}" for i in range(len(coords))]
    located = rows.select(*[c.alias(a) for c, a in zip(coords, axes)])
    return located.groupBy(*axes).agg(F.count(F.lit(1)).alias("w")), axes


def _cell(axes: list[str], side: float, prefix: str = "c") -> list[Column]:
    return [F.floor(F.col(a) / F.lit(side)).cast("bigint").alias(f"{prefix}{i}") for i, a in enumerate(axes)]


def _square(axes: list[str], left: str, right: str) -> str:
    return " + ".join(f"({left}{a} - {right}{a}) * ({left}{a} - {right}{a})" for a in axes)


# ---------------------------------------------------------------- DBSCAN

def _lookup(d: int) -> tuple[list[Column], list[tuple[int, ...]]]:
    """How cells of side eps / sqrt(d) are looked up: grid columns from the cell's, and the grid offsets that can hold a
    point within eps.

    Up to three axes the cells are the grid. Beyond, the number of cells around one explodes, so cells are gathered in
    blocks wider than eps along the first three axes and looked up in the 27 blocks around.
    """
    if d <= GRID_AXES:
        reach = math.ceil(math.sqrt(d))
        return [F.col(f"c{i}") for i in range(d)], [o for o in product(range(-reach, reach + 1), repeat=d)
                                                    if sum(max(0, abs(k) - 1) ** 2 for k in o) <= d]
    width = math.floor(math.sqrt(d)) + 1
    return ([F.floor(F.col(f"c{i}") / F.lit(width)).cast("bigint") for i in range(GRID_AXES)],
            list(product((-1, 0, 1), repeat=GRID_AXES)))


def dbscan(df: DataFrame, names: list[str] | None = None, eps: float = 0.5, min_samples: int = 5,
           scale: bool = True, components: int | None = None, with_core: bool = False) -> DataFrame:
    """Rows with their cluster number (from 0) or -1 for noise; exact on all columns, however many.

    ``with_core`` adds whether a row has ``min_samples`` rows around it. With ``components`` the principal components are clustered instead, which is another result. Up to ``GRID_LIMIT``
    dimensions space is cut into cells whose diagonal is eps, so all points of a cell are neighbours: a cell with
    ``min_samples`` rows is core without comparing points. Only points of thin cells are compared with the cells around them,
    and two dense cells are linked by refining boxes around their nearest points, so no step compares all pairs of a crowded
    region. Clusters are the connected components of core cells. In more dimensions a tree of boxes takes the place of the
    cells (``_tree_clusters``).
    """
    names = names or numeric_names(df)
    rows, coords = _points(df, names, scale, components)
    points, axes = _distinct_points(rows, coords)
    if len(axes) > GRID_LIMIT:
        found = _tree_clusters(points, axes, eps, min_samples)
        return _numbered(rows, coords, axes, found, with_core)
    d = len(axes)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    cells = [f"c{i}" for i in range(d)]
    grid, offsets = _lookup(d)
    g = len(grid)
    points = points.select("*", *_cell(axes, side))
    points = cut_lineage(points.select("*", *[x.alias(f"g{i}") for i, x in enumerate(grid)]))
    sizes = points.groupBy(*cells).agg(F.sum("w").alias("cell_rows"))
    dense = sizes.filter(F.col("cell_rows") >= min_samples).select(*cells)
    thin = points.join(dense, cells, "left_anti")  # fewer than min_samples rows per cell
    near = F.array(*[F.struct(*[F.lit(k).cast("bigint").alias(f"o{i}") for i, k in enumerate(o)]) for o in offsets])
    places = [f"g{i}" for i in range(g)]

    def around(table: DataFrame, keep: list[str]) -> DataFrame:
        """One row per point and grid place around it (columns n0, n1, ...)."""
        spread = table.select(*keep, F.inline(near), *places)
        return spread.select(*keep, *[(F.col(f"g{i}") + F.col(f"o{i}")).alias(f"n{i}") for i in range(g)])

    query = around(thin.select(*[F.col(a).alias(f"q{a}") for a in axes], *places), [f"q{a}" for a in axes])
    on = [F.col(f"n{i}") == F.col(f"g{i}") for i in range(g)]
    within = F.expr(f"{_square(axes, 'q', '')} <= {eps * eps!r}D")
    keys = [f"q{a}" for a in axes]
    counted = query.join(points, on).filter(within).groupBy(*keys).agg(F.sum("w").alias("seen"))
    thin_core = counted.filter(F.col("seen") >= min_samples).select(*[F.col(f"q{a}").alias(a) for a in axes])
    thin_core = thin.join(thin_core, axes, "left_semi")
    core = cut_lineage(points.join(dense, cells, "left_semi").unionByName(thin_core))  # core points with their cell

    links = _cell_links(core, dense, cells, axes, eps, near)
    labels = _components(core.select(*cells).distinct(), links, cells)
    numbered = cut_lineage(core.join(labels, cells).select(*axes, *places, "root"))

    # border points: the smallest cluster with a core point within eps
    border = around(thin.join(thin_core.select(*axes), axes, "left_anti").select(
        *[F.col(a).alias(f"q{a}") for a in axes], *places), keys)
    claimed = (border.join(numbered, on).filter(within).groupBy(*keys).agg(F.min("root").alias("root"))
               .select(*[F.col(f"q{a}").alias(a) for a in axes], "root"))
    core_places = numbered.select(*axes, "root", F.lit(True).alias("core"))
    known = core_places.unionByName(claimed.withColumn("core", F.lit(False)))
    return _numbered(rows, coords, axes, known, with_core)


def _numbered(rows: DataFrame, coords: list[Column], axes: list[str], known: DataFrame, with_core: bool) -> DataFrame:
    """The rows with a number for each root that ``known`` gives a place (axes, root, core), -1 where it gives none."""
    known = known if with_core else known.drop("core")
    order = with_position(known.select("root").distinct(), [], ["root"], "cluster").select(
        "root", (F.col("cluster") - 1).cast("bigint").alias("cluster"))
    found = known.join(order, "root").drop("root")
    located = rows.select("*", *[c.alias(a) for c, a in zip(coords, axes)])
    placed = located.join(found, axes, "left").drop(*axes).na.fill(-1, ["cluster"])
    return placed.withColumn("core", F.coalesce("core", F.lit(False))) if with_core else placed


def _touching(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(point, smallest point reached) over the links between two sets of points, without those that reach none smaller."""
    a, b = left.copy(), right.copy()
    some_a, some_b = near.any(axis=1), near.any(axis=0)
    todo_a, todo_b = some_a.copy(), some_b.copy()
    while todo_a.any():  # one connected part after the other; every row and column is looked at once
        new = np.zeros(len(a), dtype=bool)
        new[todo_a.argmax()] = True
        part_a, part_b = new.copy(), np.zeros(len(b), dtype=bool)
        while new.any():
            todo_a &= ~new
            met = near[new].any(axis=0) & todo_b
            todo_b &= ~met
            new = near[:, met].any(axis=1) & todo_a
            part_a, part_b = part_a | new, part_b | met
        a[part_a] = b[part_b] = min(left[part_a].min(), right[part_b].min())
    return [(int(p), int(q)) for p, q in (*zip(left[some_a], a[some_a]), *zip(right[some_b], b[some_b])) if p != q]


def _tree_clusters(points: DataFrame, axes: list[str], eps: float, min_samples: int, leaf: int = space.LEAF) -> DataFrame:
    """axes, root, core: the cluster of every place that has one, from a tree of boxes.

    Points of a leaf are compared with each other first, which settles dense regions: only points with too few rows in their
    own leaf ask the leaves around, and only core points whose parts are not yet known to hang together are compared across
    leaves. A place is core, linked or on a border by its own distances in the end.
    """
    square, d = eps * eps, len(axes)
    located = points.select(F.monotonically_increasing_id().alias("pid"), "w", F.array(*axes).alias("x"))
    tree = space.grow(located, d, leaf)
    above = cut_lineage(tree.nodes.where("leaf").select(F.col("node").alias("leaf"), F.explode(space.ancestors("node")).alias("node")))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"])
        return pdf.assign(seen=(space.squares(x, x) <= square) @ pdf["w"].to_numpy())

    counted = cut_lineage(tree.points.groupBy("leaf").applyInPandas(
        inside, "pid bigint, w bigint, x array<double>, leaf string, seen bigint").withColumn("core", F.col("seen") >= min_samples))
    loose = counted.where("not core")
    boxes = cut_lineage(tree.nodes.where("leaf").select(F.col("node").alias("leaf"), "lo", "hi", "w"))

    def reached_by(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        some, every = space.near(asked, there, eps)
        some &= asked["leaf"].to_numpy()[:, None] != there["leaf"].to_numpy()[None]
        every &= some
        sure = every @ there["w"].to_numpy()
        i, j = np.nonzero(some & (sure < min_samples)[:, None])  # where whole boxes suffice, no others are asked
        enough = np.flatnonzero(sure >= min_samples)
        return pd.DataFrame({"leaf": asked["leaf"].to_numpy()[np.r_[i, enough]],
                             "other": np.r_[there["leaf"].to_numpy()[j], np.full(len(enough), None, dtype="object")],
                             "sure": np.r_[np.where(every[i, j], there["w"].to_numpy()[j], 0), sure[enough]], "full": np.r_[every[i, j], enough >= 0]})

    reached = cut_lineage(space.joined_boxes(loose.groupBy("leaf").agg(*space.box(d)), boxes, above, d, eps, reached_by,
                                             "leaf string, other string, sure bigint, full boolean"))
    sure = small_side(cut_lineage(reached.groupBy("leaf").agg(F.sum("sure").alias("sure"))))
    loose = loose.join(sure, "leaf", "left").select(
        "pid", "x", "leaf", (F.col("seen") + F.coalesce("sure", F.lit(0))).alias("seen"))
    opened = reached.where("not full").select("leaf", "other")
    there = boxes.select(F.col("leaf").alias("other"), "lo", "hi", F.col("w").alias("there"))
    touched = loose.where(F.col("seen") < min_samples).join(opened, "leaf").join(small_side(there), "other")
    touched = cut_lineage(space.within(touched, "x", "x", "lo", "hi", eps).select(
        "pid", "x", F.col("other").alias("leaf"), "there", F.col("full").alias("whole")))
    loose = cut_lineage(loose.join(touched.where("whole").groupBy("pid").agg(F.sum("there").alias("sure")), "pid", "left").select(
        "pid", (F.col("seen") + F.coalesce("sure", F.lit(0))).alias("seen")))
    visits = touched.where("not whole").join(loose.where(F.col("seen") < min_samples), "pid").select("pid", "x", "leaf")

    def seen(came: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        near = space.squares(np.stack(came["x"]), np.stack(host["x"])) <= square
        return pd.DataFrame({"pid": came["pid"], "more": near @ host["w"].to_numpy()})

    found = space.visited(visits, tree.points, seen, "pid bigint, more bigint").groupBy("pid").agg(F.sum("more").alias("more"))
    late = cut_lineage(loose.join(found, "pid", "left").where(F.col("seen") + F.coalesce("more", F.lit(0)) >= min_samples).select(
        "pid", F.lit(True).alias("late")))
    counted = counted.join(late, "pid", "left").select("pid", "w", "x", "leaf", (F.col("core") | F.coalesce("late", F.lit(False))).alias("core"))
    counted = cut_lineage(counted)

    core, labels = _core_labels(counted.where("core").drop("core"), above, d, eps, leaf)
    rooted = cut_lineage(core.join(small_side(labels), "part").select("pid", "x", "leaf", "root"))

    def claimed(came: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(host["root"].to_numpy())
        near = (space.squares(np.stack(came["x"]), np.stack(host["x"])) <= square)[:, order]
        hit = near.any(axis=1)
        return pd.DataFrame({"pid": came["pid"].to_numpy()[hit], "root": host["root"].to_numpy()[order][near.argmax(axis=1)[hit]]})

    thin = counted.where("not core").select("pid", "x", "leaf")
    reached = reached.where("other is not null").select("leaf", "other").unionByName(
        thin.select("leaf").distinct().select("leaf", F.col("leaf").alias("other")))
    there = small_side(cut_lineage(rooted.groupBy("leaf").agg(*space.box(d)).withColumnRenamed("leaf", "other")))
    visits = cut_lineage(space.within(thin.join(reached, "leaf").join(there, "other"), "x", "x", "lo", "hi", eps).select(
        "pid", "x", F.col("other").alias("leaf")))
    border = space.visited(visits, rooted, claimed, "pid bigint, root string").groupBy("pid").agg(F.min("root").alias("root"))
    border = border.join(thin, "pid")
    known = rooted.select("x", "root", F.lit(True).alias("core")).unionByName(
        border.select("x", "root", F.lit(False).alias("core")))
    return known.select(*[F.col("x")[i].alias(a) for i, a in enumerate(axes)], "root", "core")


PICKED = 16  # core points that stand for a part of a leaf when parts are first put together


def _core_labels(core: DataFrame, above: DataFrame, d: int, eps: float, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(core with its part, part and root): the parts of leaves that hang together within eps, from core points pid, w, x, leaf.

    Parts are put together by some points of each, looked at in leaves that are cut elsewhere, and by boxes no wider than eps.
    Two boxes under one root need no look after that. What is left is compared in whole, the nearest boxes of two roots first.
    """
    square = eps * eps

    def parts_of(pdf: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
        """The smallest of ``ids`` that hangs together with each point."""
        x = np.stack(pdf["x"])
        least = dict(_touching(space.squares(x, x) <= square, ids, ids))
        return np.array([least.get(i, i) for i in ids.tolist()], dtype=np.int64)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        pdf = pdf.assign(part=parts_of(pdf, pdf["pid"].to_numpy(np.int64)))
        place, size = pdf.groupby("part").cumcount(), pdf.groupby("part")["pid"].transform("size")
        return pdf.assign(picked=(place * PICKED // size) > ((place - 1) * PICKED // size))

    core = cut_lineage(core.groupBy("leaf").applyInPandas(
        cut, "pid bigint, w bigint, x array<double>, leaf string, part bigint, picked boolean"))
    parts = cut_lineage(core.groupBy("leaf", "part").agg(F.count(F.lit(1)).alias("k"), *space.box(d)))

    # points that stand for their parts, in leaves cut at other places
    other = space.grow(core.where("picked").select("pid", "w", "x", "part"), d, leaf, ways=5)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(a0=pdf["part"], b0=parts_of(pdf, pdf["pid"].to_numpy(np.int64)))
        part = dict(zip(pdf["pid"], pdf["part"]))
        return pd.DataFrame({"a0": pdf["a0"], "b0": pdf["b0"].map(part)}).drop_duplicates()

    picked = other.points.groupBy("leaf").applyInPandas(met, "a0 bigint, b0 bigint")

    narrow = parts.join(small_side(above), "leaf").groupBy("node").agg(
        F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"),
        F.min("part").alias("lead"))
    narrow = space.within(narrow, "lo", "hi", "lo", "hi", eps).where("full").select("node", "lead")
    boxed = parts.join(small_side(above), "leaf").join(narrow, "node").select(F.col("part").alias("a0"), F.col("lead").alias("b0"))
    labels = _components(parts.select("part"), cut_lineage(picked.unionByName(boxed).where("a0 <> b0").distinct()), ["part"])

    def linked(came: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        near = space.squares(np.stack(came["x"]), np.stack(host["x"])) <= square
        a, b = came["root"].to_numpy(), host["root"].to_numpy()
        found = [(r, s) for r in pd.unique(a) for s in pd.unique(b[near[a == r].any(axis=0)]) if r != s]
        return pd.DataFrame(found, columns=["a0", "b0"], dtype="object")

    def pairs_of(first: bool):
        def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            """Parts of the smaller of two clusters (in places) with those of the larger; the nearest one of a cluster if ``first``."""
            some, every = space.near(asked, there, eps)
            (a, p), (b, q) = [(t["root"].to_numpy(), t["all"].to_numpy()) for t in (asked, there)]
            some &= (p[:, None] < q[None]) | ((p[:, None] == q[None]) & (a[:, None] < b[None]))
            i, j = np.nonzero(some)
            middle = [(np.stack(t["lo"]) / 2 + np.stack(t["hi"]) / 2) for t in (asked, there)]
            found = pd.DataFrame({"part": asked["part"].to_numpy()[i], "root": a[i], "to": there["leaf"].to_numpy()[j], "host": b[j],
                                  "lo": there["lo"].to_numpy()[j], "hi": there["hi"].to_numpy()[j], "full": every[i, j],
                                  "far": ((middle[0][i] - middle[1][j]) ** 2).sum(axis=1)})
            return found.sort_values(["far", "to"]).drop_duplicates(["part", "host"]) if first else found

        return meet

    schema = "part bigint, root string, to string, host string, lo array<double>, hi array<double>, full boolean, far double"
    for first in (True, False):
        now = cut_lineage(parts.join(small_side(labels), "part"))
        sized = cut_lineage(now.join(now.groupBy("root").agg(F.sum("k").alias("all")), "root").select("leaf", "part", "root", "all", "lo", "hi"))
        pairs = cut_lineage(space.joined_boxes(sized, sized, above, d, eps, pairs_of(first), schema))
        if pairs.isEmpty():
            break
        if first:
            pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("part", "host").orderBy("far", "to"))).where("place = 1")
        open_pairs = pairs.where("not full").select("part", "root", F.col("to").alias("leaf"), "lo", "hi")
        visits = space.within(core.select("pid", "x", "part").join(open_pairs, "part"), "x", "x", "lo", "hi", eps).select(
            "pid", "x", "root", "leaf").dropDuplicates(["pid", "leaf"])
        hosts = core.select("x", "leaf", "part").join(small_side(labels), "part").select("x", "leaf", "root")
        edges = space.visited(cut_lineage(visits), hosts, linked, "a0 string, b0 string").unionByName(
            pairs.where("full").select(F.col("root").alias("a0"), F.col("host").alias("b0")))
        edges = cut_lineage(edges.distinct())
        if edges.isEmpty():
            continue
        joined = _components(now.select(F.col("root").alias("old")).distinct(), edges, ["old"])
        labels = cut_lineage(labels.join(joined.select(F.col("old").alias("root"), F.col("root").alias("new")), "root").select(
            "part", F.col("new").alias("root")))
    return core, labels


def _cell_links(core: DataFrame, dense: DataFrame, cells: list[str], axes: list[str], eps: float, near) -> DataFrame:
    """Pairs of different core cells that hold core points within eps of each other.

    Boxes of points are compared instead of points: boxes further apart than eps cannot link, boxes whose
    furthest corners are within eps do.  What stays open is halved along every axis, until boxes are points.
    """
    d = len(axes)
    left, right = [f"a{i}" for i in range(d)], [f"b{i}" for i in range(d)]
    extent = [f(a).alias(f"{k}{a}") for a in axes for k, f in (("lo", F.min), ("hi", F.max))]
    side = eps / math.sqrt(d) * (1 - 1e-12)
    places = [c for c in core.columns if c[0] == "g"]
    members = core.select(*cells, *places).distinct()
    spread = members.select(*[F.col(c).alias(f"a{i}") for i, c in enumerate(cells)], F.inline(near), *places)
    spread = spread.select(*left, *[(F.col(p) + F.col(f"o{i}")).alias(f"n{i}") for i, p in enumerate(places)])
    others = members.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(cells)], *places)
    apart = sum(F.pow(F.greatest(F.abs(F.col(a) - F.col(b)) - 1, F.lit(0)), 2) for a, b in zip(left, right))
    open_pairs = (spread.join(others, [F.col(f"n{i}") == F.col(p) for i, p in enumerate(places)])
                  .filter((F.struct(*left) < F.struct(*right)) & (apart <= d)).select(*left, *right))
    gap = " + ".join(f"pow(greatest(0D, r.lo{a} - l.hi{a}, l.lo{a} - r.hi{a}), 2D)" for a in axes)
    far = " + ".join(f"pow(greatest(r.hi{a} - l.lo{a}, l.hi{a} - r.lo{a}), 2D)" for a in axes)
    linked = None
    boxes_of_pairs = None  # (pair, sub-cell of left, sub-cell of right) still open
    for level in range(0, 60):
        grid = side / (2 ** level)
        subs = [F.floor((F.col(a) - F.col(c) * F.lit(side)) / F.lit(grid)).cast("bigint").alias(f"s{i}")
                for i, (a, c) in enumerate(zip(axes, cells))]
        s_names = [f"s{i}" for i in range(d)]
        if level:  # only cells that are still in question
            busy = boxes_of_pairs.select(*[F.col(f"a{i}").alias(c) for i, c in enumerate(cells)]).unionByName(
                boxes_of_pairs.select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(cells)])).distinct()
            core = core.join(busy, cells, "left_semi")
        boxes = core.select(*axes, *cells, *subs).groupBy(*cells, *s_names).agg(*extent)
        if level == 0:
            pairs_now = open_pairs
            l_keys = [F.col(f"p.a{i}") == F.col(f"l.c{i}") for i in range(d)]
            r_keys = [F.col(f"p.b{i}") == F.col(f"r.c{i}") for i in range(d)]
        else:
            pairs_now = boxes_of_pairs
            l_keys = [F.col(f"p.a{i}") == F.col(f"l.c{i}") for i in range(d)] + [
                F.col(f"p.ls{i}") == F.floor(F.col(f"l.s{i}") / 2) for i in range(d)]
            r_keys = [F.col(f"p.b{i}") == F.col(f"r.c{i}") for i in range(d)] + [
                F.col(f"p.rs{i}") == F.floor(F.col(f"r.s{i}") / 2) for i in range(d)]
        met = pairs_now.alias("p").join(boxes.alias("l"), l_keys).join(boxes.alias("r"), r_keys)
        judged = met.select(*[F.col(f"p.{c}") for c in left + right],
                            *[F.col(f"l.s{i}").alias(f"ls{i}") for i in range(d)],
                            *[F.col(f"r.s{i}").alias(f"rs{i}") for i in range(d)],
                            F.expr(f"({far}) <= {eps * eps!r}D").alias("links"),
                            F.expr(f"({gap}) <= {eps * eps!r}D").alias("may")).filter("may")
        judged = cut_lineage(judged)
        sure = judged.filter("links").select(*left, *right).distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        rest = cut_lineage(judged.filter(~F.col("links")).join(sure, left + right, "left_anti").drop("links", "may"))
        boxes_of_pairs = rest
        if rest.isEmpty():
            return linked
    raise RuntimeError("core cells are still undecided at the finest boxes: coordinates differ by less than a double shows")


def _components(nodes: DataFrame, links: DataFrame, cells: list[str]) -> DataFrame:
    """Smallest cell id of every connected component, by hooking to smaller neighbours and pointer jumping."""
    d = len(cells)
    def key(cols):
        return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])

    edges = links.select(key([f"a{i}" for i in range(d)]).alias("u"), key([f"b{i}" for i in range(d)]).alias("v"))
    edges = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = cut_lineage(nodes.select(*cells, key(cells).alias("id")).withColumn("root", F.col("id")))
    while True:
        view = roots.select("id", "root")
        # the smallest root seen over the edges of any member, per current root (partial minima before the shuffle)
        ends = edges.join(view.withColumnRenamed("id", "v").withColumnRenamed("root", "rv"), "v").join(
            view.withColumnRenamed("id", "u").withColumnRenamed("root", "ru"), "u").filter("rv < ru")
        hook = ends.groupBy("ru").agg(F.min("rv").alias("to"))
        if hook.isEmpty():
            return roots.select(*cells, "root")
        hook = cut_lineage(hook)
        while True:  # follow the hooks to their end; each step halves the chains
            step = hook.alias("h").join(hook.alias("g"), F.col("h.to") == F.col("g.ru"), "left").select(
                F.col("h.ru"), F.coalesce("g.to", "h.to").alias("to"), F.col("g.to").isNotNull().alias("moved"))
            step = cut_lineage(step)
            hook = step.select("ru", "to")
            if step.filter("moved").isEmpty():
                break
        roots = cut_lineage(roots.join(hook, roots["root"] == hook["ru"], "left").select(
            *cells, "id", F.coalesce("to", "root").alias("root")))


def cluster_counts(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- local outlier factor

LEAF = space.LEAF  # points that one task compares with each other
QUERY_CHUNK = 20_000  # foreign queries that meet one copy of a leaf
CANDIDATES = "array<struct<dist: double, other: bigint, w: bigint>>"


def _nearest(q: np.ndarray, q_id: np.ndarray, need: np.ndarray, reach: np.ndarray, p: np.ndarray, p_id: np.ndarray,
             p_w: np.ndarray) -> list[list[tuple]]:
    """Per query the nearest other points within its reach until their rows add up to what it needs."""
    order = np.argsort(p_id)
    p, p_id, p_w = p[order], p_id[order], p_w[order]
    out = []
    for start in range(0, len(q), 500):
        part = slice(start, start + 500)
        dist = np.sqrt(space.squares(q[part], p))
        dist[(p_id[None, :] == q_id[part, None]) | (dist > reach[part, None])] = np.inf
        most = min(int(max(need[part].max(), 1)), len(p))
        last = np.partition(dist, most - 1, axis=1)[:, most - 1]  # only what is as near as that is put in order
        for i, row in enumerate(dist):
            near, have = [], 0
            close = np.flatnonzero(np.isfinite(row) & (row <= last[i]))
            close = close[np.argsort(row[close], kind="stable")]
            for d, j, w in zip(row[close].tolist(), p_id[close].tolist(), p_w[close].tolist()):
                if have >= need[start + i]:
                    break
                near.append((d, j, w))
                have += w
            out.append(near)
    return out


def nearest_neighbours(points: DataFrame, axes: list[str], k: int, total: int, leaf: int = space.LEAF) -> DataFrame:
    """``pid, w, need, other, dist, used``: for every distinct point the other points that hold its k nearest rows.

    ``points`` has pid, the axes and w (rows at the point); copies of the point itself come first at distance zero. Space is
    cut into boxes of bounded size; a leaf answers its own points, and asks only those other leaves that the ball around a
    point touches. The result is exact in any number of dimensions.
    """
    need = F.greatest(F.lit(k) - (F.col("w") - 1), F.lit(0)).cast("bigint")
    located = cut_lineage(points.select("pid", "w", F.array(*axes).alias("x"), need.alias("need")))
    tree = space.grow(located, len(axes), leaf)
    placed = tree.points
    schema = "pid bigint, near " + CANDIDATES

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, want = np.stack(pdf["x"]), pdf["pid"].to_numpy(), pdf["need"].to_numpy()
        near = _nearest(x, ids, want, np.full(len(x), np.inf), x, ids, pdf["w"].to_numpy())
        return pd.DataFrame({"pid": ids, "near": near})

    own = cut_lineage(placed.groupBy("leaf").applyInPandas(inside, schema))
    # a leaf with too few rows: the smallest box around it that holds more than k rows bounds the distance to the k-th
    boxes = tree.nodes.select("node", "w", F.sqrt(space.furthest_square("lo", "hi", "lo", "hi")).alias("across"))
    bounds = tree.nodes.where("leaf").select(F.col("node").alias("leaf"), F.explode(space.ancestors("node")).alias("node")).join(
        boxes, "node").where((F.col("w") > k) | (F.col("node") == space.ROOT)).groupBy("leaf").agg(
        F.max_by("across", F.length("node")).alias("bound"))
    have = F.aggregate("near", F.lit(0).cast("bigint"), lambda a, s: a + s["w"])
    asked = placed.filter("need > 0").join(own, "pid").join(bounds, "leaf").withColumn("r", F.when(
        have >= F.col("need"), F.least(F.element_at("near", -1)["dist"], F.col("bound"))).otherwise(F.col("bound"))).drop(
        "near", "bound")
    asked = cut_lineage(asked)
    met = space.leaves_in_reach(tree, asked.groupBy("leaf").agg(F.max("r").alias("r")))
    there = tree.nodes.select(F.col("node").alias("other"), "lo", "hi")
    touched = asked.join(met, "leaf").join(there, "other").where(
        space.nearest_square("x", "x", "lo", "hi") <= F.col("r") * F.col("r") * (1 + 2 * space.SLACK))
    visits = cut_lineage(touched.select("pid", "x", "need", "r", F.col("other").alias("leaf")))
    # a leaf asked by very many points is copied, each copy answers a bounded chunk
    load = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("copies"))
    salted = visits.join(load, "leaf").withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("copies")).cast("int"))
    hosts = placed.join(load, "leaf").withColumn("salt", F.explode(F.expr("sequence(0, copies - 1)")))
    hosts = hosts.select(*[F.col(c).alias(f"h_{c}") for c in ("leaf", "salt", "pid", "w", "x")])

    def abroad(queries: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(host):
            return pd.DataFrame({"pid": pd.Series(dtype="int64"), "near": pd.Series(dtype="object")})
        near = _nearest(np.stack(queries["x"]), queries["pid"].to_numpy(), queries["need"].to_numpy(),
                        queries["r"].to_numpy() * (1 + 1e-12), np.stack(host["h_x"]), host["h_pid"].to_numpy(),
                        host["h_w"].to_numpy())
        return pd.DataFrame({"pid": queries["pid"].to_numpy(), "near": near})

    group = ["leaf", "salt"]
    foreign = salted.groupBy(*group).cogroup(hosts.groupBy(*[f"h_{g}" for g in group])).applyInPandas(abroad, schema)
    found = own.unionByName(foreign).select("pid", F.explode("near").alias("n")).select(
        "pid", F.col("n.other").alias("other"), F.col("n.dist").alias("dist"), F.col("n.w").alias("ow"))
    before = Window.partitionBy("pid").orderBy("dist", "other").rowsBetween(Window.unboundedPreceding, -1)
    taken = found.withColumn("_b", F.coalesce(F.sum("ow").over(before), F.lit(0)))  # at most k per leaf visited
    used = taken.join(placed.select("pid", "w", "need"), "pid").filter("_b < need").select(
        "pid", "w", "need", "other", "dist", F.least(F.col("ow"), F.col("need") - F.col("_b")).alias("used"))
    return cut_lineage(used)


def local_outlier_factor(df: DataFrame, names: list[str] | None = None, k: int = 20,
                         contamination: float | None = None, scale: bool = True,
                         components: int | None = None) -> DataFrame:
    """Rows with their local outlier factor and a label: -1 above 1.5, or for the most outlying share.

    Exact on all columns, however many; with ``components`` on that many principal components instead.
    """
    names = names or numeric_names(df)
    rows, coords = _points(df, names, scale, components)
    points, axes = _distinct_points(rows, coords)
    points = cut_lineage(points.withColumn("pid", F.monotonically_increasing_id()))
    total = points.agg(F.sum("w")).first()[0] or 0
    k = min(k, total - 1)
    if k < 1:
        return rows.withColumns({"factor": F.lit(1.0), "label": F.lit(1)})
    near = nearest_neighbours(points, axes, k, total, LEAF)
    copies = F.least(F.col("w") - 1, F.lit(k))
    base = points.select("pid", "w", copies.alias("twins")).join(
        near.groupBy("pid").agg(F.max("dist").alias("kdist")), "pid", "left").na.fill(0.0, ["kdist"])
    base = cut_lineage(base)
    reach = near.join(base.select(F.col("pid").alias("other"), F.col("kdist").alias("okdist")), "other").groupBy("pid").agg(
        F.sum(F.col("used") * F.greatest("okdist", "dist")).alias("reach"))
    mean = (F.coalesce("reach", F.lit(0.0)) + F.col("twins") * F.col("kdist")) / k
    density = cut_lineage(base.join(reach, "pid", "left").select("pid", "twins", (1.0 / (mean + 1e-10)).alias("lrd")))
    around = near.join(density.select(F.col("pid").alias("other"), F.col("lrd").alias("olrd")), "other").groupBy("pid").agg(
        F.sum(F.col("used") * F.col("olrd")).alias("around"))
    factor = (F.coalesce("around", F.lit(0.0)) + F.col("twins") * F.col("lrd")) / k / F.col("lrd")
    by_point = density.join(around, "pid", "left").select("pid", factor.alias("factor")).join(
        points.select("pid", *axes), "pid").drop("pid")
    scored = rows.select("*", *[c.alias(a) for c, a in zip(coords, axes)]).join(by_point, axes).drop(*axes)
    limit = 1.5
    if contamination is not None:
        scored = cut_lineage(scored)
        limit = exact_quantiles(scored, ["factor"], (1.0 - contamination,))["factor"][0]
    return scored.withColumn("label", F.when(F.col("factor") > limit, -1).otherwise(1))
