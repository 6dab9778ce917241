"""Nothing is dropped and no answer changes with size: many columns, many rows, rare classes, odd texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import correlate
from sightline.functions.quantiles import exact_quantiles
from sightline.operators import anomaly, cleaning, distribution, models, transforms
from sightline.sources import export, load


def jobs_of(spark, action):
    spark.sparkContext.setJobGroup("counted", "counted")
    action()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("other", "other")
    return found


def test_quantile_brackets_narrow_together(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(30_000, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double").cache()
    df.count()
    got = {}
    many = jobs_of(spark, lambda: got.update(exact_quantiles(df, list("abcd"), (0.25, 0.5, 0.75), keep=60)))
    for i, c in enumerate("abcd"):
        assert got[c] == pytest.approx(np.quantile(data[:, i], (0.25, 0.5, 0.75)))
    assert many <= 24  # a few jobs a round for all brackets; one bracket after the other would take twice that and more


def test_wide_correlation_has_the_constant_check(spark):
    rng = np.random.default_rng(2)
    rows = [tuple([1.1 if i < 50 else None, float(i) if i < 60 else float(i % 7)] + list(map(float, rng.normal(size=9)))) for i in range(100)]
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    full = {n: 100 for n in names} | {"c0": 50}
    wide = correlate.pair_correlations(df, names, full, 100)
    narrow = correlate.pair_correlations(df.select("c0", "c1", "c2"), names[:3], full, 100)
    assert wide[("c0", "c1")] is None and narrow[("c0", "c1")] is None
    assert wide[("c1", "c2")] == pytest.approx(narrow[("c1", "c2")])


def test_boxcox_exponent_is_not_limited(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(50, 4, 4000)
    df = spark.createDataFrame([(float(v ** (1 / 12)),) for v in z], "x double")
    assert transforms.boxcox_lambda(df, "x") == pytest.approx(12, abs=4)
    assert transforms.boxcox_lambda(df.select((1 / F.col("x")).alias("x")), "x") == pytest.approx(-12, abs=4)


def test_skew_transforms_skip_what_values_do_not_allow(frame):
    assert list(transforms.skew_transforms(frame([(1.0,), (2.0,), (9.0,)], "x double"), "x")) == ["original", "log", "sqrt", "boxcox"]
    assert list(transforms.skew_transforms(frame([(0.0,), (2.0,)], "x double"), "x")) == ["original", "sqrt"]
    assert list(transforms.skew_transforms(frame([(-1.0,), (2.0,)], "x double"), "x")) == ["original"]


def test_isolation_forest_draws_at_any_row_count(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    assert int(min(1.0, (256 + 6 * 16) / 1e12) * (1 << 62)) > 1e9  # the threshold at 1e12 rows
    got = anomaly.isolation_forest(df, trees=10)
    assert got.filter("score is null").count() == 0 and got.filter("label = -1").count() > 0


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = k
                    stack.append(j)
            k += 1
    return core, label, near


@pytest.mark.parametrize("dims", [2, 4, 6])
def test_dbscan_uses_all_columns(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(m, 0.35, (60, dims)) for m in (0, 2.2, 5)] + [rng.uniform(-2, 7, (40, dims))])
    names = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["cluster"] for r in anomaly.dbscan(df, names, eps=0.9, min_samples=5, scale=False).collect()}
    core, label, near = brute_dbscan(x, 0.9, 5)
    found = np.array([got[i] for i in range(len(x))])
    assert ((found < 0) == ~(near[:, core].any(1))).all()
    pairs = {(a, b) for a, b in zip(label[core], found[core])}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_are_another_space(spark):
    df = spark.createDataFrame([tuple(float(i * j % 7) for j in range(12)) for i in range(30)], ", ".join(f"c{i} double" for i in range(12)))
    assert anomaly.dbscan(df, components=2).count() == 30
    assert anomaly.local_outlier_factor(df, components=2, k=3).count() == 30


def test_local_outlier_factor_in_five_dimensions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"x{i} double" for i in range(5)))
    got = {r["id"]: r["factor"] for r in anomaly.local_outlier_factor(df, [f"x{i}" for i in range(5)], 10, scale=False).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    kdist = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kdist[near]).mean(1) + 1e-10)
    assert np.allclose([got[i] for i in range(150)], lrd[near].mean(1) / lrd)


def test_csv_keeps_newlines_blanks_and_quotes(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"'), (2, " blanks "), (3, "plain"), (4, "a\r\nb")]
    df = spark.createDataFrame(rows, "id long, t string")
    export.write_csv(df, str(tmp_path / "out"))
    assert sorted((r.id, r.t) for r in load.load_csv(spark, str(tmp_path / "out")).collect())[:3] == rows[:3]


def test_classifier_survives_rare_classes_and_many_texts(spark):
    rows = [("a" if i % 2 else "b", float(i % 2) + (i % 5) * 0.1, f"text {i}") for i in range(120)] + [("rare", 3.0, "text x")]
    df = spark.createDataFrame(rows, "y string, x double, t string")
    train, test = models.stratified_split(df, "y")
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {"a": 12, "b": 12}
    assert train.count() + test.count() == 121
    _, used, work = models.feature_stages(df, "y", None)
    assert used == ["x", "t"] and work.select("t_0").distinct().count() <= models.MAX_CATEGORIES
    got = {r["metric"]: r["value"] for r in models.baseline_classifier(df, "y", "logistic", folds=0).collect()}
    assert got["accuracy"] > 0.9


def test_density_in_one_scan(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("a"), F.sqrt("id").alias("b"),
                                 (F.col("id") % 3).alias("g")).cache()
    df.count()
    got = distribution.kde(df, ["a", "b"], points=40, bandwidth=2.0).collect()
    x = np.arange(500) % 50.0
    for r in got:
        if r["column"] == "a":
            assert r["density"] == pytest.approx(np.exp(-0.5 * ((x - r["x"]) / 2) ** 2).sum() / (500 * 2 * np.sqrt(2 * np.pi)))
    assert len(got) == 80
    by = distribution.kde_by_group(df, "a", "g", points=10).collect()
    assert len(by) == 30 and all(r["density"] > 0 for r in by)


def test_duplicates_are_searched_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "a")], "i int, t string")
    out, log = cleaning.drop_duplicates(df)
    assert out.count() == 2 and log == ["Removed 2 duplicate rows"]
    assert cleaning.drop_duplicates(df.distinct())[1] == ["Removed 0 duplicate rows"]
