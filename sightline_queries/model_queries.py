"""Projection, clustering, supervised baselines, lag features and anomaly detection."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sightline.operators import anomaly, models
from sightline_queries.registry import query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pca")
def _(spark, read):
    return models.pca(read("lineitem"), LINE).select("l_orderkey", "l_linenumber", "pc1", "pc2", "pc3")


@query("pca_variance")
def _(spark, read):
    return models.pca_variance(read("lineitem"), LINE).drop("loadings")


@query("pca_variance_two", "select component, round(ratio, 6) as ratio, round(total, 6) as running_total from (select 1 as "
       "component, (1 + abs(r)) / 2 as ratio, (1 + abs(r)) / 2 as total from (select corr(l_quantity, l_extendedprice) as r from "
       "lineitem) union all select 2, (1 - abs(r)) / 2, 1.0 from (select corr(l_quantity, l_extendedprice) as r from lineitem))")
def _(spark, read):
    """Two standardised columns: the eigenvalues are one plus and minus the correlation."""
    return models.pca_variance(read("lineitem"), ["l_quantity", "l_extendedprice"]).drop("loadings")


def _corr_pairs_sql() -> str:
    return " union all ".join(f"select '{a}' as column_1, '{b}' as column_2, round(corr({a}, {b}), 6) as correlation from lineitem"
                              for a in LINE for b in LINE)


@query("pca_reconstruction", _corr_pairs_sql())
def _(spark, read):
    """All components together give the correlations back: the sum of variance times loading times loading."""
    found = models.pca_variance(read("lineitem"), LINE, len(LINE))
    first = found.select("component", "ratio", F.explode("loadings").alias("column_1", "a"))
    second = found.select("component", F.explode("loadings").alias("column_2", "b"))  # a row per component and column
    return first.join(second, "component").groupBy("column_1", "column_2").agg(
        (F.sum(F.col("ratio") * F.col("a") * F.col("b")) * len(LINE)).alias("correlation"))


@query("pca_scores", "select l_orderkey, l_linenumber, round(" + " + ".join(f"pow(({c} - m{i}) / s{i}, 2)" for i, c in enumerate(LINE))
       + ", 4) as square from lineitem, (select " + ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(LINE))
       + " from lineitem)", digits=4)
def _(spark, read):
    """On all components a row has the length that it has on the standardised columns."""
    found = models.pca(read("lineitem"), LINE, len(LINE))
    return found.select("l_orderkey", "l_linenumber", sum(F.pow(f"pc{i + 1}", F.lit(2)) for i in range(len(LINE))).alias("square"))


@query("kmeans_fixed_point", "select count(*) as row_count, least(8, greatest(2, count(*) // 50)) as clusters, 0 as misplaced, "
       "round(avg(c_acctbal), 4) as c_acctbal, round(avg(c_nationkey), 4) as c_nationkey from customer", digits=4)
def _(spark, read):
    """Run to its end, no row is nearer to the mean of another cluster than to that of its own."""
    names = ["c_acctbal", "c_nationkey"]
    rows = read("customer").select("*", *[x.alias(f"z{i}") for i, x in enumerate(models.standard_columns(read("customer"), names))])
    found = models.kmeans(rows, names, max_iter=500, tol=0.0)
    means = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(2)],
                                         *[F.sum(c).alias(c) for c in names])
    centres = [(r["cluster"], r["m0"], r["m1"]) for r in means.collect()]  # at most eight clusters
    distance = lambda m0, m1: F.pow(F.col("z0") - m0, F.lit(2)) + F.pow(F.col("z1") - m1, F.lit(2))
    own = F.coalesce(*[F.when(F.col("cluster") == c, distance(a, b)) for c, a, b in centres])
    bad = found.agg(F.count_if(F.least(*[distance(a, b) for _, a, b in centres]) < own - 1e-12).cast("int").alias("misplaced"))
    totals = means.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("clusters"),
                       *[(F.sum(c) / F.sum("n")).alias(c) for c in names])
    return totals.join(F.broadcast(bad))


@query("cluster_summary_totals", " union all ".join(
    f"select '{c}' as \"column\", count(*) as row_count, round(avg({c}), 4) as mean, round(sum({c} * {c}::double) / count(*), 2) as "
    f"mean_square, min({c})::double as min, max({c})::double as max from customer" for c in ("c_acctbal", "c_nationkey")), digits=4)
def _(spark, read):
    """Counts, means, deviations and ranges of the clusters put together are those of the table."""
    found = models.cluster_summary(read("customer"), ["c_acctbal", "c_nationkey"])
    n = F.col("row_count")
    square = F.sum((n - 1) * F.pow(F.coalesce("std", F.lit(0.0)), F.lit(2)) + n * F.pow("mean", F.lit(2))) / F.sum("row_count")
    return found.groupBy("column").agg(F.sum("row_count").alias("row_count"), (F.sum(n * F.col("mean")) / F.sum("row_count")).alias("mean"),
                                       F.round(square, 2).alias("mean_square"), F.min("min").alias("min"), F.max("max").alias("max"))


@query("kmeans")
def _(spark, read):
    return models.kmeans(read("lineitem"), LINE).select("l_orderkey", "l_linenumber", "cluster", "pc1", "pc2", "pc3")


@query("cluster_sizes")
def _(spark, read):
    return models.cluster_sizes(read("customer"), ["c_acctbal", "c_nationkey"])


@query("cluster_summary")
def _(spark, read):
    return models.cluster_summary(read("customer"), ["c_acctbal", "c_nationkey"])


@query("baseline_classifier")
def _(spark, read):
    return models.baseline_classifier(read("lineitem"), "l_linestatus", "logistic")


def _labelled(read):
    """Quality marks with what is known of their documents."""
    return read("labels").join(read("documents").drop("text"), "doc_id")


def _register_classifiers():
    for name in ("random_forest", "gradient_boosting", "linear_svm", "naive_bayes"):
        @query(f"baseline_classifier_{name}")
        def _(spark, read, name=name):
            return models.baseline_classifier(_labelled(read), "quality", name)


_register_classifiers()


@query("baseline_regressor")
def _(spark, read):
    return models.baseline_regressor(read("lineitem"), "l_extendedprice", "linear")


def _register_regressors():
    for name in ("random_forest", "gradient_boosting"):
        @query(f"baseline_regressor_{name}")
        def _(spark, read, name=name):
            return models.baseline_regressor(read("part"), "p_retailprice", name)


_register_regressors()


@query("stratified_split", "select l_linenumber as class, count(*) - round(0.2 * count(*))::bigint as train_rows, "
       "round(0.2 * count(*))::bigint as test_rows from lineitem group by 1")
def _(spark, read):
    train, test = models.stratified_split(read("lineitem"), "l_linenumber")
    return train.groupBy("l_linenumber").agg(F.count("*").alias("train_rows")).join(
        test.groupBy("l_linenumber").agg(F.count("*").alias("test_rows")), "l_linenumber").withColumnRenamed(
        "l_linenumber", "class")


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("linear_regression_gradient", "select feature, (select count(*) from lineitem) as row_count, true as stationary from (select "
       f"unnest({NUMBERS + ['intercept']}) as feature)")
def _(spark, read):
    """Least squares: on the training rows the residuals are orthogonal to every feature and add up to nothing."""
    _, model, used, train, test = models.fit_regressor(read("lineitem"), "l_extendedprice", "linear", NUMBERS)
    scored = model.transform(train).withColumn("r", F.col("label") - F.col("prediction")).withColumn("x", vector_to_array("_raw"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("x")[i].alias("x")) for i, c in enumerate(used)],
                    F.struct(F.lit("intercept").alias("feature"), F.lit(1.0).alias("x")))
    cosine = F.sum(F.col("r") * F.col("x")) / F.sqrt(F.sum(F.col("r") * F.col("r")) * F.sum(F.col("x") * F.col("x")))
    found = scored.select("r", F.inline(cells)).groupBy("feature").agg((F.abs(cosine) < 1e-6).alias("stationary"))
    return found.withColumn("row_count", F.lit(train.count() + test.count()).cast("bigint"))


@query("logistic_gradient", f"select feature, (select count(*) from lineitem) as row_count, true as stationary from (select "
       f"unnest({NUMBERS + ['intercept']}) as feature)")
def _(spark, read):
    """Penalised likelihood: its slope is nought in every coefficient, and without penalty in the intercept."""
    _, model, used, train, test, _ = models.fit_classifier(read("lineitem"), "l_linestatus", "logistic", NUMBERS)
    fitted = model.stages[-1]
    weights = [float(w) for w in fitted.coefficients] + [0.0]
    scored = model.transform(train).select((vector_to_array("probability")[1] - F.col("label")).alias("r"),
                                           vector_to_array("_features").alias("x"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("x")[i].alias("x"), F.lit(weights[i]).alias("w"))
                      for i, c in enumerate(used)],
                    F.struct(F.lit("intercept").alias("feature"), F.lit(1.0).alias("x"), F.lit(0.0).alias("w")))
    slope = F.avg(F.col("r") * F.col("x")) + fitted.getRegParam() * F.first("w")
    found = scored.select("r", F.inline(cells)).groupBy("feature").agg((F.abs(slope) < 1e-3).alias("stationary"))
    return found.withColumn("row_count", F.lit(train.count() + test.count()).cast("bigint"))


@query("feature_importance")
def _(spark, read):
    _, model, used, *_ = models.fit_regressor(read("part"), "p_retailprice", "gradient_boosting",
                                              ["p_partkey", "p_size", "p_brand", "p_type"])
    return models.feature_importance(spark, model, used)


def _lag_sql(count: int) -> str:
    names = ", ".join(f"lag(value, {i}) over w as lag_{i}" for i in range(1, count + 1))
    shown = ", ".join(f"round(lag_{i}, 6) as lag_{i}" for i in range(1, count + 1))
    return (f"select user_id, position, round(y, 6) as y, {shown} from (select user_id, value as y, row_number() over w as "
            f"position, {names} from events window w as (partition by user_id order by ts, value)) "
            f"where lag_{count} is not null")


@query("lag_features", _lag_sql(12))
def _(spark, read):
    return models.lag_features(read("events"), "ts", "value", 12, ["user_id"]).drop("ts")


@query("lag_features_one_series", "select position, round(y, 6) as y, round(l1, 6) as lag_1, round(l2, 6) as lag_2 from "
       "(select value as y, row_number() over w as position, lag(value, 1) over w as l1, lag(value, 2) over w as l2 "
       "from events window w as (order by ts, value)) where l2 is not null")
def _(spark, read):
    """One series over the whole table, cut into blocks so that no task holds it."""
    return models.lag_features(read("events"), "ts", "value", 2, block=1000).drop("ts")


@query("forecast_baseline")
def _(spark, read):
    return models.forecast_baseline(read("events"), "ts", "value", 12, ["user_id"])


@query("isolation_forest")
def _(spark, read):
    return anomaly.isolation_forest(read("customer"), ["c_acctbal", "c_nationkey"]).select("c_custkey", "score", "label")


@query("dbscan")
def _(spark, read):
    return anomaly.dbscan(read("customer"), ["c_acctbal", "c_nationkey"], eps=0.3, min_samples=15).select(
        "c_custkey", "cluster")


POINTS = ("pts as (select c_custkey as id, (c_acctbal - ma) / sa as x, (c_nationkey - mn) / sn as y from customer, "
          "(select avg(c_acctbal) as ma, stddev_pop(c_acctbal) as sa, avg(c_nationkey) as mn, "
          "stddev_pop(c_nationkey) as sn from customer))")


@query("dbscan_noise", f"with {POINTS}, near as (select p.id, o.id as other from pts p join pts o on "
       "(p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) <= 0.09), core as (select id from near group by id having "
       "count(*) >= 15) select pts.id as c_custkey, not exists (select 1 from near n where n.id = pts.id and n.other in "
       "(select id from core)) as noise from pts")
def _(spark, read):
    """Which rows belong to no cluster; border points may belong to either of two clusters, noise is unambiguous."""
    found = anomaly.dbscan(read("customer"), ["c_acctbal", "c_nationkey"], eps=0.3, min_samples=15)
    return found.select("c_custkey", (F.col("cluster") < 0).alias("noise"))


@query("dbscan_clusters", f"with recursive {POINTS}, near as (select p.id, o.id as other from pts p join pts o on "
       "(p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) <= 0.0225), core as (select id from near group by id having "
       "count(*) >= 8), link as (select n.id, n.other from near n where n.id in (select id from core) and n.other in "
       "(select id from core)), reach as (select id, id as other from core union select r.id, l.other from reach r join link l "
       "on r.other = l.id) select id as c_custkey, min(other) as cluster_first from reach group by id")
def _(spark, read):
    """Core rows by cluster, a cluster named by its smallest core row; a border row may belong to either of two."""
    found = anomaly.dbscan(read("customer"), ["c_acctbal", "c_nationkey"], eps=0.15, min_samples=8, with_core=True).filter("core")
    names = found.groupBy("cluster").agg(F.min("c_custkey").alias("cluster_first"))
    return found.join(names, "cluster").select("c_custkey", "cluster_first")


FIVE = {"p_partkey": "p_partkey", "p_size": "p_size", "p_retailprice": "p_retailprice", "name_chars": "length(p_name)",
        "type_chars": "length(p_type)"}


def _five_sql() -> str:
    raw = "(select " + ", ".join(f"{e} as {c}" for c, e in FIVE.items()) + " from part)"
    scaled = ", ".join(f"({c} - m{i}) / s{i} as x{i}" for i, c in enumerate(FIVE))
    moments = ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(FIVE))
    square = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(5))
    return (f"with p as (select p_partkey, {scaled} from {raw}, (select {moments} from {raw})), near as (select a.p_partkey as "
            f"id, b.p_partkey as other from p a join p b on {square} <= 0.64), core as (select id from near group by id having "
            "count(*) >= 8) select p_partkey, not exists (select 1 from near n where n.id = p.p_partkey and n.other in "
            "(select id from core)) as noise from p")


@query("dbscan_five_columns", _five_sql())
def _(spark, read):
    """All five columns take part; noise is unambiguous, border points are not."""
    rows = read("part").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name_chars"),
                               F.length("p_type").alias("type_chars"))
    found = anomaly.dbscan(rows, rows.columns, eps=0.8, min_samples=8)
    return found.select("p_partkey", (F.col("cluster") < 0).alias("noise"))


def _lof_five_sql() -> str:
    base = _five_sql().split(", near as")[0]
    square = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(5))
    return (f"{base}, near as (select a.p_partkey as id, b.p_partkey as other, sqrt({square}) as d from p a join p b on "
            "a.p_partkey <> b.p_partkey qualify row_number() over (partition by a.p_partkey order by d, b.p_partkey) <= 20), "
            "far as (select id, max(d) as k from near group by id), dense as (select n.id, 1 / (avg(greatest(far.k, n.d)) + "
            "1e-10) as lrd from near n join far on far.id = n.other group by n.id) select p_partkey, round(f, 4) as factor "
            "from (select n.id as p_partkey, avg(o.lrd) / any_value(s.lrd) as f from near n join dense o on o.id = n.other "
            "join dense s on s.id = n.id group by n.id)")


@query("local_outlier_factor_five_columns", _lof_five_sql(), digits=4)
def _(spark, read):
    rows = read("part").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name_chars"),
                               F.length("p_type").alias("type_chars"))
    return anomaly.local_outlier_factor(rows, rows.columns, 20).select("p_partkey", "factor")


@query("local_outlier_factor", f"with {POINTS}, near as (select p.id, o.id as other, sqrt((p.x - o.x) * (p.x - o.x) + "
       "(p.y - o.y) * (p.y - o.y)) as d from pts p join pts o on p.id <> o.id qualify row_number() over (partition by p.id "
       "order by d, o.id) <= 20), far as (select id, max(d) as k from near group by id), dense as (select n.id, "
       "1 / (avg(greatest(far.k, n.d)) + 1e-10) as lrd from near n join far on far.id = n.other group by n.id) "
       "select c_custkey, round(f, 4) as factor, case when f > 1.5 then -1 else 1 end as label from (select n.id as "
       "c_custkey, avg(o.lrd) / any_value(s.lrd) as f from near n join dense o on o.id = n.other join dense s on "
       "s.id = n.id group by n.id)", digits=4)
def _(spark, read):
    return anomaly.local_outlier_factor(read("customer"), ["c_acctbal", "c_nationkey"], 20).select(
        "c_custkey", "factor", "label")
