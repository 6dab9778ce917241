"""Reworked operators: the same answers however rows are dealt out, and plans that do not move whole rows."""

import math
import os
import random
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import session
from sightline.functions import correlate, counts, quantiles, ranks
from sightline.functions.normal import normal_quantile
from sightline.operators import anomaly, correlation, distribution, hypothesis, models, quality
from sightline.sources import load


# CSV

CELLS = ["a", "1", "2.5", "", '""', '"x"', '"two\nlines"', '"q""q"', '"a,b"', '"\r\nmid\n\n"', '"  "', " sp ", '"""start"',
         '"end"""', "é", '"\n"', '"x\n""y"",z"']


def write_csv(path, rows, kind):
    rng = random.Random(rows)
    with open(path, "w", newline="\r\n" if kind == "crlf" else "") as f:
        f.write('id,"co l",c,d\n')
        for i in range(rows):
            cells = [str(i)] + [rng.choice(CELLS) for _ in range(3)]
            if kind == "plain":
                cells = [c.replace("\r", " ").replace("\n", " ") for c in cells]
            if kind == "crlf":
                cells = [c.replace("\r", "") for c in cells]
            if kind == "stray" and i == rows // 2:
                cells[1] = '5" pipe'
            f.write(",".join(cells) + "\n" + "\n" * (i % 10 == 0))


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("kinds", [["crlf"], ["spanning", "plain", "stray", "crlf"]])
def test_split_csv_equals_the_reader_of_whole_files(spark, tmp_path, small_splits, kinds):
    folder = tmp_path / "with blank"
    os.makedirs(folder)
    for kind in kinds:
        write_csv(folder / f"{kind} 1.csv", 300, kind)
    want = Counter(map(tuple, spark.read.csv(str(folder), header=True, multiLine=True, escape='"').collect()))
    assert Counter(map(tuple, load._split_csv(spark, str(folder), ",").collect())) == want
    assert sum(want.values()) == 300 * len(kinds)


def test_a_file_without_quoted_newlines_is_read_by_many_tasks(spark, tmp_path, small_splits):
    write_csv(tmp_path / "x.csv", 3000, "plain")
    assert load.load_csv(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() > 10
    assert load.load_csv(spark, str(tmp_path / "x.csv"), multi_line=True).rdd.getNumPartitions() == 1


def test_lines_of_records_that_span_lines_are_read_by_many_tasks(spark, tmp_path, small_splits):
    write_csv(tmp_path / "x.csv", 1000, "spanning")
    lines = load._lines(spark, [str(tmp_path / "x.csv")], ",")
    assert lines.rdd.getNumPartitions() > 5
    records, unfit = load._joined_records(lines, True)
    assert records.count() == 1001 and unfit.count() == 0


def test_csv_types_and_other_separators(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('n|x|t|b\n1|1.5|"a|b"|true\n2||"c\nd"|False\n', encoding="utf-8")
    df = load.load_csv(spark, str(path), sep="|")
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("t", "string"), ("b", "boolean")]
    assert sorted(map(tuple, df.collect())) == [(1, 1.5, "a|b", True), (2, None, "c\nd", False)]


# isolation forest

def test_isolation_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(2500, 2)))] + [(7, 0.5, 0.5)] * 800 + [(9, 8.0, -8.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    found = [sorted((r["i"], r["score"], r["label"]) for r in anomaly.isolation_forest(df.repartition(n), ["a", "b"], 20).collect())
             for n in (1, 8, 50)]
    assert found[0] == found[1] == found[2]
    assert max(found[0], key=lambda r: r[1])[0] == 9


def test_isolation_trees_and_scores_in_plain_python(spark):
    rng = np.random.default_rng(2)
    data = [tuple(map(float, r)) for r in rng.normal(size=(1500, 2))] + [(0.25, 0.25)] * 700
    df = spark.createDataFrame([(i if i < 1500 else -1, *r) for i, r in enumerate(data)], "i int, a double, b double")
    drawn = {}
    for r in anomaly._subsamples(df, ["a", "b"], len(data), 256, 12, 42).collect():
        drawn.setdefault(r["tree"], []).append((r["draw"], tuple(r["x"])))
    assert sorted(drawn) == list(range(12)) and min(map(len, drawn.values())) >= 256
    stock, shares, trees = Counter(data), [], []
    for tree in range(12):
        sample = [x for _, x in sorted(drawn[tree])[:256]]
        assert all(k <= stock[x] for x, k in Counter(sample).items())  # no row twice
        shares.append(sample.count((0.25, 0.25)) / 256)
        trees.append(anomaly._grow(np.array(sample), 42 * 1000 + tree))
    assert abs(np.mean(shares) - 700 / 2200) < 0.05  # copies are drawn one by one

    def depth(nodes, x):
        at = nodes[0]
        while at[1] >= 0:
            at = nodes[at[3] if x[at[1]] < at[2] else at[4]]
        return at[5]

    norm = anomaly._path_length(256)
    got = {r["i"]: r["score"] for r in anomaly.isolation_forest(df, ["a", "b"], 12).collect()}
    for i in range(0, 1500, 50):
        want = 2 ** (-np.mean([depth(t, data[i]) for t in trees]) / norm)
        assert got[i] == pytest.approx(want)


# normality

def test_normal_quantile(spark):
    p = [10.0 ** -k for k in range(1, 200, 7)] + [i / 1000 for i in range(1, 1000)] + [1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile("p").alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-12)


def test_shapiro_by_positions_equals_the_gathered_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    samples = {f"g{n}": rng.normal(size=n) if n % 2 else rng.exponential(size=n) for n in (1, 2, 3, 4, 5, 6, 7, 11, 12, 50, 700)}
    samples |= {"same": np.full(9, 2.5), "ties": np.repeat([1.0, 2.0, 2.0, 3.0, 7.0], 8), "far": 1e9 + rng.normal(size=300)}
    df = spark.createDataFrame([(g, float(x)) for g, v in samples.items() for x in v] + [("null", None)], "g string, x double")
    got = {r["group"]: r for r in hypothesis.shapiro_test(df.repartition(7), "x", "g").collect()}
    assert set(got) == set(samples)
    for g, v in samples.items():
        w, p = hypothesis.shapiro_wilk(v)
        assert got[g]["row_count"] == len(v)
        if w is None:
            assert got[g]["statistic"] is None and got[g]["status"] == "no variation"
        else:
            assert got[g]["statistic"] == pytest.approx(w, abs=1e-9) and got[g]["p_value"] == pytest.approx(p, rel=1e-4, abs=1e-9)
            assert got[g]["status"] == "tested" and got[g]["normal"] == (p > 0.05)


def test_shapiro_beyond_five_thousand(spark):
    x = np.random.default_rng(4).normal(size=9000)
    got = hypothesis.shapiro_test(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    w, _ = hypothesis.shapiro_wilk(x)
    assert got["status"] == "approximate p" and got["statistic"] == pytest.approx(w) and 0.99 < w < 1 and got["p_value"] > 0.001


# splits

def test_hash_ranks_equal_sorting(spark):
    rng = np.random.default_rng(5)
    keys = {None: 500, "a": 3000, "b": 1, "c": 40}
    rows = [(k, int(h)) for k, n in keys.items() for h in rng.integers(0, 1 << 63, n)]
    rows += [("d", 5)] * 30 + [("d", h) for h in range(1 << 62, (1 << 62) + 50)]
    wanted = [(None, 250), ("a", 1), ("b", 1), ("c", 40), ("d", 12)]
    df = spark.createDataFrame(rows, "key string, h bigint").repartition(6)
    got = {r["key"]: r for r in ranks.hash_ranks(df, spark.createDataFrame(wanted, "key string, rank bigint")).collect()}
    for key, rank in wanted:
        own = sorted(h for k, h in rows if k == key)
        cut = own[rank - 1]
        assert (got[key]["cut"], got[key]["below"], got[key]["ties"]) == (cut, sum(h < cut for h in own), own.count(cut))


def test_split_moves_no_rows_and_places_copies(spark):
    rows = [(i, "x" if i % 3 else "y", f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "i int, y string, t string").repartition(4)
    train, test = models.stratified_split(df, "y")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert Counter(r["y"] for r in test.collect()) == {"x": 120, "y": 60}
    assert sorted(map(tuple, train.collect() + test.collect())) == sorted(rows)
    again = {r["i"] for r in models.stratified_split(df.repartition(9), "y")[1].collect()}
    assert again == {r["i"] for r in test.collect()}
    copies = [(1, "x")] * 50 + [(2, "x")] * 50 + [(i, "z") for i in range(10)] + [(5, None)] * 10
    train, test = models.stratified_split(spark.createDataFrame(copies, "i int, y string"), "y")
    assert Counter(r["y"] for r in test.collect()) == {"x": 20, "z": 2, None: 2}
    assert sorted(map(repr, train.collect() + test.collect())) == sorted(map(repr, spark.createDataFrame(copies, "i int, y string").collect()))


# wide tables

def test_tiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 25))
    x[:, 3] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(25)))
    got = {(r["i"], r["j"]): r["correlation"] for r in correlate.pair_table(df.repartition(3), df.columns, tile=7).collect()}
    assert len(got) == 300
    for (i, j), r in got.items():
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 3 in (i, j) or 9 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1])


def test_wide_table_results_stay_tables(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 12))
    x[:, 5] = x[:, 2] * 2 + 0.1 * x[:, 1]
    x[:, 6] = -x[:, 2]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(12)))
    key = lambda rows: sorted((*r[:2], None if r[2] is None else round(r[2], 9), *r[3:]) for r in map(tuple, rows))
    made = {}
    for wide in (200, 8):
        for module in (correlation, quality):
            monkeypatch.setattr(module, "WIDE", wide)
        made[wide] = [key(correlation.correlation_matrix(df).collect()),
                      [(*r[:2], round(r[2], 9), r[3]) for r in correlation.correlation_pairs(df, top=9, sign="positive").collect()],
                      key(quality.detect_multicollinearity(df).collect()),
                      [r["issue_count"] for r in quality.issue_summary(df).collect() if r["issue"] == "multicollinearity"]]
    assert made[200] == made[8] and made[8][3] == [3]


# densities

@pytest.mark.parametrize("scale", [1.0, 1e-7])
def test_densities_from_cells_keep_their_bound(spark, scale):
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.normal(size=3000), rng.exponential(5, 500), [400.0], np.full(900, 0.125)]) * scale
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(data)] + [(None, 1)], "x double, g int")
    exact = {r["point"]: r["density"] for r in distribution.kde(df, ["x"], exact=True).collect()}
    got = {r["point"]: r["density"] for r in distribution.kde(df, ["x"]).collect()}
    height = 1 / (np.std(data, ddof=1) * len(data) ** -0.2 * math.sqrt(2 * math.pi))
    assert len(got) == 200 and max(abs(got[p] - exact[p]) for p in exact) <= 4 * distribution.KERNEL_BOUND * height
    for r in distribution.kde_by_group(df, "x", "g", points=9).collect():
        own = data[r["g"]::3]
        h = np.std(own, ddof=1) * len(own) ** -0.2
        want = np.exp(-0.5 * ((own - r["x"]) / h) ** 2).sum() / (len(own) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=1e-7, abs=1e-11 * height)


# duplicates

def test_only_candidates_are_shuffled(spark):
    df = spark.range(200_000).select((F.col("id") % 195_000).alias("a"), F.lit("t").alias("b"))
    found = counts.Repeats.of(df)
    marked = found.marked(df.withColumn("_h", counts.row_hash(df)))
    candidates = marked.where("_maybe").count()
    assert found.count == 5000 and 10_000 <= candidates < 10_000 + 0.08 * 200_000
    assert counts.drop_duplicate_rows(df, found).count() == 195_000
    assert counts.duplicate_groups(df, "n", found).agg(F.sum("n")).first()[0] == 10_000


# models that read their rows very often

def test_training_rows_are_dealt_over_the_cores_and_lie_there_in_order(spark):
    df = spark.range(100_000).select((F.col("id") % 7).alias("a"), F.col("id").cast("double").alias("b"))
    for rows in (df.coalesce(1), df.repartition(60)):
        got = models.dealt(rows)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert models.dealt(df.coalesce(1)).collect() == models.dealt(df.coalesce(1)).collect()
    assert models.dealt(df.limit(900).repartition(60)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert models.dealt(df.limit(900).coalesce(1)).rdd.getNumPartitions() == 1


def test_trees_train_on_rows_of_one_file_in_many_tasks(spark, monkeypatch):
    monkeypatch.setitem(models.REGRESSORS, "gradient_boosting", lambda b: models.GBTRegressor(maxIter=1, maxDepth=1, maxBins=b))
    df = spark.range(60_000).coalesce(1).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    _, _, _, train, test = models.fit_regressor(df, "y", "gradient_boosting")
    assert train.rdd.getNumPartitions() > 1 and train.count() + test.count() == 60_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_hot_key_stay_where_they_are(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("g"),
                                    ((F.col("id") * 7919) % 1009).cast("double").alias("x"))
    state = rows.groupBy("g").agg(F.max("x").alias("top")).checkpoint()
    assert "BroadcastHashJoin" in plan(quantiles._meet(rows.select("g", F.col("x").alias("_x")), state, ["g"]))
    assert "SortMergeJoin" not in plan(distribution.box_stats(rows, "x", "g"))
    hashes = rows.select(F.col("g").alias("key"), F.shiftrightunsigned(F.xxhash64("x"), 1).alias("h"))
    wanted = rows.groupBy(F.col("g").alias("key")).agg((F.count("x") / 5).cast("bigint").alias("rank"))

    def found():
        return [sorted(map(tuple, df.collect())) for df in (distribution.box_stats(rows, "x", "g"), ranks.hash_ranks(hashes, wanted))]

    few = found()
    monkeypatch.setattr(session, "SMALL_TABLE", 0)  # as with very many groups
    assert found() == few


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """Rows are not led through every tree anew at each level, and the trees are those that would be found without."""
    df = spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), (F.col("id") % 7 * 3.0 + F.col("id")).alias("y"))
    pipeline, model, _, train, _ = models.fit_regressor(df, "y", "random_forest")
    forest = pipeline.getStages()[-1]
    assert forest.getCacheNodeIds()
    plain = pipeline.copy({forest.cacheNodeIds: False}).fit(train)
    assert plain.stages[-1].toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]
