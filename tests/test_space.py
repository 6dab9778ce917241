"""Neighbour searches in many dimensions against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import space
from sightline.operators import anomaly
from sightline.session import cut_lineage
from tests.test_limits import brute_dbscan


def table(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    return names, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))


def crowd(rng, dims, extreme=True):
    """Three dense groups, thin ones, copies of rows, a line of equal coordinates and one extreme value."""
    groups = [rng.normal(m, 0.2, (70, dims)) for m in (0, 3, 6)] + [rng.uniform(-2, 8, (50, dims))]
    line = np.zeros((30, dims))
    line[:, 0] = np.arange(30) * 0.5 + 20
    x = np.concatenate([*groups, line, groups[0][:15], groups[0][:15]])
    if extreme:
        x = np.concatenate([x, np.full((1, dims), 1e12)])
    return x


def same_clusters(found, x, eps, least):
    core, label, near = brute_dbscan(x, eps, least)
    assert ((found < 0) == ~(near[:, core].any(1))).all()
    pairs = {(a, b) for a, b in zip(label[core], found[core])}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for i in np.flatnonzero(~core & (found >= 0)):  # a border point has a core neighbour in its cluster
        assert found[i] in set(found[near[i] & core])


@pytest.mark.parametrize("dims,eps", [(2, 0.6), (12, 1.4)])
def test_tree_dbscan_equals_all_pairs(spark, dims, eps):
    x = crowd(np.random.default_rng(dims), dims)
    names, df = table(spark, x)
    points = df.groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
    known = anomaly._tree_clusters(points, names, eps, 6, leaf=12)
    got = {r["id"]: r["root"] for r in df.join(known, names, "left").collect()}
    assert len(got) == len(x)
    numbers = {root: n for n, root in enumerate(sorted({v for v in got.values() if v is not None}))}
    same_clusters(np.array([numbers.get(got[i], -1) for i in range(len(x))]), x, eps, 6)


def test_dbscan_of_twelve_columns(spark):
    x = crowd(np.random.default_rng(3), 12)
    names, df = table(spark, x)
    got = {r["id"]: r["cluster"] for r in anomaly.dbscan(df, names, eps=1.2, min_samples=5, scale=False).collect()}
    same_clusters(np.array([got[i] for i in range(len(x))]), x, 1.2, 5)


@pytest.mark.parametrize("dims,leaf", [(12, 25), (1, 8)])
def test_nearest_neighbours_equal_all_pairs(spark, dims, leaf):
    rng = np.random.default_rng(dims)
    x = np.unique(crowd(rng, dims), axis=0)
    w = rng.integers(1, 4, len(x))
    names, df = table(spark, x)
    weights = spark.createDataFrame([(i, int(n)) for i, n in enumerate(w)], "id int, w bigint")
    points = df.join(weights, "id").withColumn("pid", F.col("id").cast("bigint"))
    k = 12
    got = {}
    for r in anomaly.nearest_neighbours(points, names, k, int(w.sum()), leaf).collect():
        got.setdefault(r["pid"], []).append((round(r["dist"], 9), r["used"]))
    d = np.sqrt(space.squares(x, x))
    for i in range(len(x)):
        need, want = k - (w[i] - 1), []
        for j in [j for j in np.argsort(d[i], kind="stable") if j != i]:
            if need > 0:
                want += [round(d[i, j], 9)] * int(min(need, w[j]))
                need -= w[j]
        assert sorted(v for v, used in got[i] for _ in range(used)) == pytest.approx(want, rel=1e-9)


def test_lof_of_twelve_columns(spark):
    x = np.concatenate([np.random.default_rng(4).normal(size=(150, 12)), np.full((1, 12), 9.0)])
    names, df = table(spark, x)
    got = {r["id"]: r["factor"] for r in anomaly.local_outlier_factor(df, names, 10, scale=False).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    kdist = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kdist[near]).mean(1) + 1e-10)
    assert np.allclose([got[i] for i in range(151)], lrd[near].mean(1) / lrd)


def test_leaves_are_bounded_whatever_the_values(spark):
    rows = [(i, 1, [0.0 if i % 9 else float(i), 2.0 ** (i % 300), float(i) if i % 2 else 5.0]) for i in range(3000)]
    points = spark.createDataFrame(rows, "pid bigint, w bigint, x array<double>")
    tree = space.grow(points, 3, most=40)
    sizes = [r["count"] for r in tree.points.groupBy("leaf").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 3000
    assert tree.nodes.where("leaf").count() == len(sizes)


def test_dense_region_is_few_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.01, (2000, 10)), rng.normal(5, 1, (100, 10))])
    points = spark.createDataFrame([(i, 1, list(map(float, r))) for i, r in enumerate(x)], "pid bigint, w bigint, x array<double>")
    full, opened = space.pairs_within(space.grow(points, 10, most=50), 1.0)
    assert full.count() + opened.where("a_node <> b_node").count() < 400


def test_five_columns_are_clustered_by_the_tree(spark, monkeypatch):
    rows = [(i, *map(float, r)) for i, r in enumerate(np.random.default_rng(5).normal(size=(120, 5)))]
    df, names, used, tree = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double"), list("abcde"), [], anomaly._tree_clusters
    monkeypatch.setattr(anomaly, "_tree_clusters", lambda *x: used.append(len(x[1])) or tree(*x))
    found = anomaly.dbscan(df, names, eps=1.0, min_samples=4, scale=False, with_core=True).collect()
    x = np.array([r[1:] for r in sorted(rows)])
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.0
    core = near.sum(axis=1) >= 4
    assert used == [5] and [r["core"] for r in sorted(found, key=lambda r: r["i"])] == core.tolist()
    assert [r["cluster"] >= 0 for r in sorted(found, key=lambda r: r["i"])] == (near & core).any(axis=1).tolist()


def test_links_between_leaves_by_parts():
    near = np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]], dtype=bool)
    got = anomaly._touching(near, np.array([9, 3, 5, 1]), np.array([4, 8, 2, 7]))
    assert sorted(got) == [(4, 3), (7, 5), (8, 3), (9, 3)]


def test_equally_near_points_come_by_id():
    p = np.array([[0.0], [1.0], [1.0], [1.0], [2.0]])
    ids = np.array([5, 9, 3, 7, 1])
    got = anomaly._nearest(p[:1], ids[:1], np.array([2]), np.array([np.inf]), p, ids, np.ones(5, int))
    assert got == [[(1.0, 3, 1), (1.0, 7, 1)]]


def test_size_guesses_do_not_grow_over_rounds(spark):
    df = cut_lineage(spark.range(4).select("id", F.col("id").alias("to")))
    for _ in range(4):
        df = cut_lineage(df.alias("a").join(df.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"))
    assert sorted((r["id"], r["to"]) for r in df.collect()) == [(i, i) for i in range(4)]
    df = cut_lineage(spark.createDataFrame([(i, i) for i in range(4)], "id long, to long"))
    for _ in range(4):
        df = cut_lineage(df.join(df.toDF("to", "far"), "to").select("id", F.col("far").alias("to")))
    assert df._jdf.queryExecution().logical().stats().sizeInBytes() < 1 << 63 and df.count() == 4


@pytest.mark.parametrize("least", [1, 4])
def test_tree_dbscan_of_many_clusters(spark, least):
    x = np.random.default_rng(least).uniform(0, 10, (300, 3))
    names, df = table(spark, x)
    points = df.groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
    got = {r["id"]: r["root"] for r in df.join(anomaly._tree_clusters(points, names, 1.1, least, leaf=10), names, "left").collect()}
    numbers = {root: n for n, root in enumerate(sorted({v for v in got.values() if v is not None}))}
    assert len(numbers) > 3
    same_clusters(np.array([numbers.get(got[i], -1) for i in range(len(x))]), x, 1.1, least)


def test_crowded_leaves_are_not_compared_with_each_other(spark, monkeypatch):
    x = np.random.default_rng(6).uniform(0, 1, (2500, 4))
    names, df = table(spark, x)
    visits, visited = [], space.visited
    monkeypatch.setattr(space, "visited", lambda v, *rest: visits.append(v.count()) or visited(v, *rest))
    known = anomaly._tree_clusters(df.groupBy(*names).agg(F.count(F.lit(1)).alias("w")), names, 0.5, 5, leaf=100)
    assert known.where("core").count() == 2500 and known.select("root").distinct().count() == 1
    assert sum(visits) < 2500  # all pairs of leaves lie within eps, most points need no other leaf
