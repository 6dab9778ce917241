"""Near-duplicate vectors against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import embeddings
from sightline.llm.embeddings import near_duplicates

SCHEMA = "vec_id bigint, embedding array<double>"


def expected(rows, threshold=0.9):
    """id -> (links, component) by all pairs; rows that cannot link stand alone."""
    unit = []
    for _, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=float)
        fit = x is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if fit else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for dim in {len(u) for u in unit if u is not None}:
        own = [i for i, u in enumerate(unit) if u is not None and len(u) == dim]
        x = np.stack([unit[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            p, q = find(own[a]), find(own[b])
            root[max(p, q)] = min(p, q)
    groups = {}
    for i, (vec_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(vec_id)
    least = {k: min((v for v in g if v is not None), default=None) for k, g in groups.items()}
    return sorted(((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows))), key=repr)


def got(df, **options):
    return sorted(((r.id, r.links, r.component, r.kept) for r in near_duplicates(df, **options).collect()), key=repr)


def planted(seed, singles, dim, cosines, group):
    """Random vectors, pairs at given cosines, and a dense group of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((singles, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = list(x * rng.uniform(0.01, 50, (singles, 1)))
    for i, c in enumerate(cosines):
        w = rng.standard_normal(dim)
        w -= (w @ x[i]) * x[i]
        out.append((c * x[i] + np.sqrt(1 - c * c) * w / np.linalg.norm(w)) * 3.0)
    out += list(x[-1] + 0.01 * rng.standard_normal((group, dim)))
    ids = rng.permutation(len(out)).tolist()
    return [(i, v.tolist()) for i, v in zip(ids, out)]


@pytest.mark.parametrize("dim,options", [(64, {"cell": 64, "hosts": 50, "visitors": 90}), (100, {})])
def test_equals_all_pairs(spark, dim, options):
    rows = planted(dim, 1500, dim, np.linspace(0.9005, 0.999, 600), 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = expected(rows)
    assert sum(w[1] for w in want) > 200 * 199 and got(df, **options) == want


def test_just_below_the_threshold_is_no_link(spark):
    rows = planted(3, 100, 64, [0.8999, 0.899, 0.9001, 0.95] * 20, 0)
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_few_dimensions_and_chains(spark):
    turn = [(i, [float(np.cos(i / 8)), float(np.sin(i / 8))]) for i in range(60)]
    rows = turn + [(100 + i, [1.0 if i % 2 else -1.0]) for i in range(7)] + [(200, [0.0, 0.0, 1.0]), (201, [0.0, 1e-3, 1.0])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0] * 20, [0.0] * 10 + [2.0] * 10
    rows = [(1, None), (2, []), (3, [0.0] * 20), (4, [nan] + a[1:]), (5, [inf] + a[1:]), (6, [None] + a[1:]), (7, a), (8, a),
            (8, b), (None, a), (None, b), (9, [1e200 * x for x in a]), (10, [1e-200 * x for x in a]), (None, [0.0] * 20),
            (None, [-1.0] * 20), (11, [-0.0] * 9 + [0.0] + [2.0] * 10), (12, a), (12, a), (13, [-1.0, 1.0] * 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("id", "vec", "node", "w", "links", "kept")})
    want = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in expected(rows)]
    assert got(df) == sorted(want, key=repr)


def test_empty_table_and_floats(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    floats = spark.createDataFrame([(1, [0.5] * 16), (2, [0.25] * 16)], "vec_id int, embedding array<float>")
    assert got(floats) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    dim, n = 64, 3000
    rotation = embeddings._rotation(dim)
    assert np.allclose(rotation @ rotation.T, np.eye(dim))
    q, w = rng.standard_normal((2, n, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    w -= (w * q).sum(axis=1, keepdims=True) * q
    o = 0.9 * q + np.sqrt(0.19) * w / np.linalg.norm(w, axis=1, keepdims=True)
    turned, factor = o @ rotation, np.abs(o @ rotation).sum(axis=1) / 8
    signs = embeddings._signs(embeddings._packed(turned > 0), dim)
    assert ((signs > 0) == (turned > 0)).all()
    error = (signs * (q @ rotation)).sum(axis=1) / 8 / factor - 0.9
    sigma = np.sqrt(0.19 * (1 - factor ** 2) / 63) / factor
    assert abs(error.mean()) < 0.02 and (np.abs(error) < embeddings.SIGMAS * sigma).all()
    assert 0.7 < error.std() / sigma.mean() < 1.2


def test_a_partner_lies_in_a_visited_cell():
    rng = np.random.default_rng(6)
    dim, bits, found, visited = 64, 8, 0, 0
    for _ in range(2000):
        x, w = rng.standard_normal((2, dim))
        x /= np.linalg.norm(x)
        w -= (w @ x) * x
        y = 0.9 * x + np.sqrt(0.19) * w / np.linalg.norm(w)
        (home_x, later_x), (home_y, later_y) = (embeddings._cells(v, bits, 0.9, 1e-3) for v in (x, y))
        assert len(set(later_x)) == len(later_x) and all(home_x < c < 1 << bits for c in later_x)
        found += home_x == home_y or home_y in later_x or home_x in later_y
        visited += len(later_x)
    assert found >= 1990 and visited < 2000 * 100
