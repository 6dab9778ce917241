"""Quantiles, positions, duplicates, parsing and correlation against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions import correlate, counts, parsing, quantiles, ranks

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def skewed(n=4000, seed=3):
    """A third of all rows hold one value, the rest has a heavy tail."""
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 3, n))
    x[: n // 3] = 1.0
    return rng.permutation(x)


@pytest.mark.parametrize("keep", [20, 20_000])
def test_exact_quantiles(spark, keep):
    x = skewed()
    pdf = pd.DataFrame({"x": x, "k": np.round(x)})
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["x", "k"], PROBS, keep=keep)
    for c in ("x", "k"):
        assert np.allclose(got[c], pdf[c].quantile(list(PROBS)), rtol=1e-12)


def test_exact_quantiles_of_nothing(frame):
    got = quantiles.exact_quantiles(frame([(None, 1.0)], "a double, b double"), ["a", "b"], (0.5,))
    assert got == {"a": [None], "b": [1.0]}


def test_missed_bracket_is_widened(spark):
    x = np.arange(1000.0)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    wrong = quantiles.Bracket("x", 0.5, 1000, 900.0, 910.0, 10.0)
    got = quantiles._solve(df, [wrong], {"x": "cast(`x` as double)"}, {"x": (0.0, 999.0)}, 50)
    assert got[("x", 0.5)] == 499.5


@pytest.mark.parametrize("keep", [30, 20_000])
def test_grouped_quantiles(spark, keep):
    x = skewed()
    g = np.where(np.arange(len(x)) % 3 == 0, "hot", np.where(np.arange(len(x)) % 100 == 1, "rare", "other"))
    pdf = pd.DataFrame({"g": g, "x": x})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    got = {r["g"]: r["quantiles"] for r in quantiles.grouped_quantiles(df, ["g"], F.col("x"), PROBS, keep).collect()}
    for name, part in pdf.groupby("g"):
        assert np.allclose(got[name], part["x"].quantile(list(PROBS)), rtol=1e-12)


def test_positions_and_lags_over_blocks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 5, 3000).astype(str)),
                        "t": rng.integers(0, 400, 3000), "v": rng.random(3000)})
    placed = ranks.with_position(spark.createDataFrame(pdf), ["s"], ["t", "v"])
    got = ranks.lags(placed, ["s"], "position", F.col("v"), 3, block=50).toPandas()
    want = pdf.sort_values(["s", "t", "v"]).reset_index(drop=True)
    want["position"] = want.groupby("s").cumcount() + 1
    for i in (1, 2, 3):
        want[f"lag_{i}"] = want.groupby("s")["v"].shift(i)
    got = got.sort_values(["s", "position"]).reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_duplicates(frame):
    rows = [(1, None, "a")] * 3 + [(2, 0.0, "b"), (2, -0.0, "b")] + [(i, float(i), "c") for i in range(5, 50)]
    df = frame(rows, "a int, b double, c string")
    assert counts.duplicate_count(df).first()[0] == 3
    assert counts.drop_duplicate_rows(df).count() == len(rows) - 3
    assert counts.drop_duplicate_rows(counts.drop_duplicate_rows(df)).count() == len(rows) - 3


def test_duplicates_beyond_the_broadcast_limit(frame, monkeypatch):
    monkeypatch.setattr(counts, "MAX_WORDS", 0)
    df = frame([(i % 7,) for i in range(50)], "a int")
    assert counts.drop_duplicate_rows(df).count() == 7


def test_numbers_and_dates_in_text(frame):
    texts = ["7", " 7.5 ", "1e3", "1d", "0x1f", "nan", "-inf", "", "x", None, ".5", "5."]
    df = frame([(t,) for t in texts], "t string").select(parsing.to_number(F.col("t")).alias("v"))
    assert [r["v"] for r in df.collect()] == [7.0, 7.5, 1000.0, None, None, None, float("-inf"), None, None, None, 0.5, 5.0]
    dates = ["2024-01-05", "2024/01/05", "1/5/2024", "2024-01-05 10:20:30", "2024-13-05", "5", "text", None, "20240105"]
    df = frame([(t,) for t in dates], "t string").select(parsing.to_moment(F.col("t")).alias("v"))
    got = [None if r["v"] is None else r["v"].strftime("%Y-%m-%d %H") for r in df.collect()]
    day = "2024-01-05 00"
    assert got == [day, day, day, "2024-01-05 10", None, None, None, None, day]


def test_text_helpers(frame):
    df = frame([("O'Neil-x ab1c", "lat 5.5 N, -7 E")], "a string, b string").select(
        parsing.title_case(F.col("a")).alias("t"), parsing.embedded_number(F.col("b")).alias("f"),
        parsing.embedded_number(F.col("b"), "last").alias("l"))
    assert tuple(df.first()) == ("O'Neil-X Ab1C", 5.5, -7.0)


def test_json_repair(frame):
    rows = [('{"a": 1}',), ('Sure: {"a": 2} done',), ("none",), ("{broken}",), (None,)]
    got = [r["j"] for r in frame(rows, "t string").select(parsing.json_or_error(F.col("t")).alias("j")).collect()]
    assert got[0] == '{"a": 1}' and got[1] == '{"a": 2}' and got[4] is None
    assert "Invalid JSON" in got[2] and "{broken}" in got[3]


@pytest.mark.parametrize("fused", [16, 2])
def test_correlation_with_missing_values(spark, monkeypatch, fused):
    monkeypatch.setattr(correlate, "FUSED_COLUMNS", fused)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (500, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    pdf["k"] = 3.3
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])
    found = correlate.pair_correlations(df, list(pdf.columns), {c: int(pdf[c].count()) for c in pdf}, 500)
    want = pdf.corr()
    for (a, b), r in found.items():
        assert (r is None and np.isnan(want.loc[a, b])) or abs(r - want.loc[a, b]) < 1e-6, (a, b)
