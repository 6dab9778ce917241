"""Threshold edges, cleaning, sinks, tests of normality, anomaly detection against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions.tablestats import TableStats
from sightline.operators import (advice, anomaly, charts, cleaning, distribution, filters, groups, hypothesis, models,
                                 overview, quality, transforms, typing)
from sightline.plans import cleaning_plan
from sightline.sources import export, load


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_conversion_share_must_exceed_80_percent(frame):
    at = frame([("1",)] * 8 + [("x",)] * 2, "t string")
    above = frame([("1",)] * 9 + [("x",)], "t string")
    assert rows_of(quality.detect_type_mismatches(at)) == []
    assert rows_of(quality.detect_type_mismatches(above))[0][:3] == ("t", "string", "numeric")
    assert [r[0] for r in rows_of(typing.numeric_columns(at))] == ["t"]  # the looser rule includes 80 %


def test_imbalance_ratio_must_exceed_three(frame):
    assert rows_of(quality.detect_class_imbalance(frame([("a",)] * 3 + [("b",)], "t string"))) == []
    assert rows_of(quality.detect_class_imbalance(frame([("a",)] * 4 + [("b",)], "t string")))[0][1] == 4.0


def test_missing_severity(frame):
    def severity(nulls, n):
        df = frame([(None if i < nulls else 1.0, 1) for i in range(n)], "a double, b int")
        return quality.issue_summary(df).filter("issue = 'missing_data'").first()["severity"]
    assert [severity(1, 10), severity(2, 10), severity(6, 10)] == ["Low", "Medium", "High"]


def test_empty_and_constant_tables(frame):
    empty = frame([], "a double, t string")
    assert overview.overview(empty).first()["missing_pct"] is None
    assert len(rows_of(quality.issue_summary(empty))) == 10
    assert rows_of(overview.describe_numeric(empty))[0][1:] == (0,) + (None,) * 7
    constant = frame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    assert rows_of(quality.detect_multicollinearity(constant)) == []
    assert rows_of(quality.detect_skewed(constant)) == []


def test_invalid_values_by_name(frame):
    df = frame([(-5, 120.0, -1.0, "x"), (200, 50.0, 3.0, "y"), (-5, 50.0, 3.0, "y")],
               "age int, tax_rate double, price double, language string")
    got = {r["column"]: (r["invalid_count"], r["examples"]) for r in quality.detect_invalid_values(df).collect()}
    assert got == {"age": (3, [-5.0, -5.0, 200.0]), "tax_rate": (1, [120.0]), "price": (1, [-1.0])}


def test_clean_pipeline(frame):
    rows = [(1.0, "a", "1"), (None, " A", "2"), (3.0, None, "3"), (1.0, "a", "1"), (100.0, "b", "4")]
    df = frame(rows, "x double, t string, n string")
    out, log = cleaning.clean(df, {"types": True, "outliers": True, "categories": True, "low_variance": True})
    assert TableStats(out).missing_cells == 0 and out.count() == 4
    assert dict(out.dtypes)["n"] == "double" and out.agg(F.max("x")).first()[0] < 100
    assert any("Removed 1 duplicate rows" in line for line in log) and any("2 → 1" in line or "→" in line for line in log)
    with pytest.raises(ValueError):
        cleaning.clean(df, {"polish": True})


def test_all_null_text_is_filled_with_unknown(frame):
    out, _ = cleaning.impute(frame([(None, 1), (None, 2)], "t string, i int"))
    assert {r["t"] for r in out.collect()} == {"Unknown"}


def test_plan_needs_a_strategy_word_for_numbers(frame):
    df = frame([(None, "a"), (1.0, None), (3.0, "a")], "x double, t string")
    plan = lambda s: {"priority_issues": [{"issue": "Missing", "strategy": s}]}
    assert TableStats(cleaning_plan.apply_cleaning_plan(df, plan("drop"))[0]).missing_cells == 1
    assert TableStats(cleaning_plan.apply_cleaning_plan(df, plan("use mean or median"))[0]).missing_cells == 0


def test_filters(frame):
    df = frame([(1, "a"), (2, None), (3, "b")], "i int, t string")
    assert filters.filter_isin(df, "t", ["a"]).count() == 1
    assert filters.filter_isin(df, "t", ["a", None]).count() == 2
    assert filters.apply_filters(df, {"i": (2, 3), "t": ["b"]}).count() == 1
    assert filters.sample_rows(df, 2).count() == 2
    with pytest.raises(ValueError):
        filters.drop_columns(df, ["zzz"])


def test_kpi_text_rounds_like_the_exact_value(frame):
    values = [0.25, 0.75, 0.35, 436.45, 999.96, -1.25, 1234.0, 2500000.0, 436450.0]
    got = [r[0] for r in frame([(v,) for v in values], "v double").select(groups.format_kpi(F.col("v"))).collect()]
    want = [f"{v / 1e6:.1f}M" if v >= 1e6 else f"{v / 1e3:.1f}K" if v >= 1e3 else f"{v:.1f}" for v in values]
    assert got == want


def test_histogram_counts_all_rows(frame):
    df = frame([(float(i % 17),) for i in range(200)] + [(None,)], "x double")
    got = distribution.histogram(df, "x", 10).toPandas()
    assert len(got) == 10 and got["row_count"].sum() == 200
    flat = distribution.histogram(frame([(2.0,)] * 4, "x double"), "x", 5).toPandas()
    assert flat["row_count"].sum() == 4


def test_boxcox_beats_other_exponents(spark):
    x = np.exp(np.random.default_rng(0).normal(2, 0.5, 2000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert abs(transforms.boxcox_lambda(df, "x")) < 0.1
    with pytest.raises(ValueError):
        transforms.log_transform(df.withColumn("x", F.col("x") - 1e6), "x")


def test_csv_round_trip(spark, tmp_path, frame):
    df = frame([(1, 1.5, "a,b", True), (2, None, 'q"q', False), (3, 2.5, None, True)],
               "i long, d double, t string, b boolean")
    export.write_csv(df, str(tmp_path / "out"))
    back = load.load_csv(spark, str(tmp_path / "out"))
    assert dict(back.dtypes) == {"i": "bigint", "d": "double", "t": "string", "b": "boolean"}
    assert sorted(rows_of(back)) == sorted(rows_of(df))
    report = export.cleaning_report(df, df, ["nothing"])
    export.write_report_json(report, str(tmp_path / "report"))
    assert '"operations"' in spark.read.text(str(tmp_path / "report")).first()[0]


def test_generated_sample(spark):
    df = load.generate_sample_dataset(spark, 1000)
    s = TableStats(df)
    assert s.rows == 1010 and s.duplicates == 10 and s.nulls["mostly_null"] >= 950
    assert s.values["department"].unique == 6 and s.mixed_case == ["department"]
    found = {r["issue"] for r in quality.issue_summary(s, only_found=True).collect()}
    assert {"missing_data", "outliers", "duplicate_rows", "inconsistent_categories", "invalid_values"} <= found


def test_shapiro_wilk_textbook_sample(frame):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = hypothesis.shapiro_wilk(np.array(weights))
    assert abs(w - 0.7888) < 5e-4 and abs(p - 0.0067) < 3e-4
    got = hypothesis.shapiro_test(frame([(float(x),) for x in weights] , "x double"), "x").first()
    assert got["status"] == "tested" and got["normal"] is False


def test_row_local_operators_on_a_stream(spark, tmp_path, frame):
    frame([(float(i), f" Ab{i} ") for i in range(10)], "x double, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, t string").parquet(str(tmp_path / "in"))
    out = transforms.strip_text(transforms.square_transform(filters.filter_range(stream, "x", 2, 4), "x"), "t")
    q = out.writeStream.format("memory").queryName("local_ops").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows_of(spark.table("local_ops"))) == [(4.0, "Ab2"), (9.0, "Ab3"), (16.0, "Ab4")]


def test_pca_matches_eigenvalues(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    ratios = [r["ratio"] for r in models.pca_variance(df, list("abcd")).collect()]
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1][:3] / 4
    assert np.allclose(ratios, want, atol=1e-9)


def test_kmeans_and_summary(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (100, 3)), rng.normal(5, 0.1, (100, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    assert sorted(r["row_count"] for r in models.cluster_sizes(df, list("abc"), 2).collect()) == [100, 100]
    assert models.cluster_summary(df, list("abc"), 2).first()["silhouette"] > 0.9


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (495, 2)), np.full((5, 2), 12.0) + rng.normal(0, 2, (5, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1]}))
    got = anomaly.isolation_forest(df, ["a", "b"], trees=50, contamination=0.01).filter("label = -1").toPandas()
    assert set(got["id"]) == {495, 496, 497, 498, 499}


def brute_dbscan(p, eps, m):
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= eps * eps
    core, label, c = near.sum(1) >= m, -np.ones(len(p), int), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core):
                    if label[k] < 0:
                        label[k] = c
                        stack.append(k)
            c += 1
    return near, core, label


@pytest.mark.parametrize("eps,m", [(0.3, 5), (0.15, 3)])
def test_dbscan_equals_brute_force(spark, eps, m):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, .3, (150, 2)), rng.normal(3, .4, (120, 2)), rng.uniform(-2, 5, (60, 2)),
                        np.repeat([[1.5, 1.5]], 110, 0)])  # a quarter of all rows are copies of one point
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "a": p[:, 0], "b": p[:, 1]}))
    got = anomaly.dbscan(df, ["a", "b"], eps, m, scale=False).toPandas().sort_values("id")["cluster"].to_numpy()
    near, core, label = brute_dbscan(p, eps, m)
    pairs = dict(zip(label[core], got[core]))
    assert len(set(zip(label[core], got[core]))) == len(set(label[core])) == len(set(got[core]))
    for i in np.flatnonzero(~core):
        allowed = {pairs[label[k]] for k in np.flatnonzero(near[i] & core)} or {-1}
        assert got[i] in allowed


def test_readiness_is_bounded(frame):
    df = frame([(None, "a")] * 9 + [(1.0, "b")], "x double, t string")
    assert all(0 <= v <= 10 for v in advice.readiness_scores(df, "t").values())
    assert advice.target_task(df, "t") == "Binary Classification"


def test_chart_dispatch(frame):
    df = frame([("a", 1.0), ("b", 2.0)], "t string, x double")
    assert charts.chart_data(df, {"type": "radar", "x_column": "t"}) is None
    assert charts.chart_data(df, {"type": "pie", "x_column": "t"}).count() == 2
    assert charts.chart_data(df, {"type": "bar", "x_column": "x"}).count() == 30


def brute_lof(p, k):
    """Factors of all rows, copies are neighbours of each other."""
    dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(dist, near, 1)
    reach = np.maximum(d[:, -1][near], d)
    lrd = 1.0 / (reach.mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("leaf", [40, 2000])
def test_lof_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(anomaly, "LEAF", leaf)
    monkeypatch.setattr(anomaly, "QUERY_CHUNK", 25)
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(0, .1, (200, 2)), rng.normal(4, 1, (100, 2)), rng.uniform(-20, 20, (20, 2)),
                        np.repeat([[1.0, 1.0]], 100, 0)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "a": p[:, 0], "b": p[:, 1]}))
    got = anomaly.local_outlier_factor(df, ["a", "b"], 10, scale=False).toPandas().sort_values("id")
    assert np.allclose(got["factor"], brute_lof(p, 10), rtol=1e-9)
