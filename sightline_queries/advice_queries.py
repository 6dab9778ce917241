"""Target analysis, readiness, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import advice
from sightline_queries.registry import NUMERIC, TEXT, columns, duck, dup_sql, outlier_sql, query, union

TARGETS = [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("lineitem", "l_linenumber"),
           ("orders", "o_totalprice"), ("customer", "c_name"), ("part", "p_type")]
NUMERIC_TARGETS = ("l_linenumber", "o_totalprice")


def _task_sql(t: str, c: str) -> str:
    if c in NUMERIC_TARGETS:
        task = "case when u <= 10 or u / n < 0.05 then 'Classification' else 'Regression' end"
    else:
        task = ("case when u = 2 then 'Binary Classification' when u <= 20 then 'Classification' "
                "else 'Text Classification' end")
    return (f"select '{c}' as target, {task} as task, n as non_null_count, u as unique_values from "
            f"(select count({c}) as n, count(distinct {c}) as u from {duck(t)})")


@query("analyze_target", union([_task_sql(t, c) for t, c in TARGETS]))
def _(spark, read):
    return reduce(DataFrame.unionByName, [advice.analyze_target(read(t), c) for t, c in TARGETS])


def _status(v: str) -> str:
    return f"case when {v} >= 7 then 'Good' when {v} >= 4 then 'Needs Work' else 'Poor' end"


def _readiness_sql(t: str, missing: str, target: str) -> str:
    n = f"(select count(*) from {duck(t)})"
    width = len(columns(t))
    mixed = 1 if NUMERIC[t] and TEXT[t] else 0
    heavy = " + ".join([f"(select count(*) from ({outlier_sql(t, [c])}) where outlier_pct > 10)" for c in NUMERIC[t]])
    encoding = " - ".join(["10"] + [
        f"(select case when count(distinct {c}) > 50 then 1 when count(distinct {c}) = count(*) then 2 else 0 end "
        f"from {duck(t)})" for c in TEXT[t]])
    rows = [("completeness", f"greatest(0, 10 - ({missing}) / 2)"),
            ("size_adequacy", f"case when {n} < 100 then 2 when {n} < 1000 then 5 when {n} < 10000 then 8 else 10 end"),
            ("feature_diversity", f"least(10, {3 if width < 3 else 6 if width < 10 else 9} + {mixed})"),
            ("data_quality", f"greatest(0, greatest(0, 10 - 100.0 * {dup_sql(t, columns(t))} / {n}) - 0.5 * ({heavy}))"),
            ("target_quality", target), ("encoding_readiness", f"greatest(0, {encoding})")]
    scores = union([f"select '{a}' as aspect, ({e})::double as score" for a, e in rows])
    return (f"with s as ({scores}) select aspect, round(score, 6) as score, {_status('score')} as status from "
            f"(select * from s union all select 'overall', avg(score) from s)")


@query("data_readiness", _readiness_sql("events", "0", "7"))
def _(spark, read):
    return advice.data_readiness(read("events"))


@query("data_readiness_missing", _readiness_sql(
    "fx_nulls", f"(select 100.0 * (3 * count(*) - count(q) - count(p) - count(rf)) / (5 * count(*)) from {duck('fx_nulls')})",
    f"(select 10 - 50.0 * (count(*) - count(rf)) / count(*) from {duck('fx_nulls')})"))
def _(spark, read):
    return advice.data_readiness(read("fx_nulls"), "rf")


@query("data_readiness_target", _readiness_sql("lineitem", "0", "select 10 - case when 100.0 * min(k) / sum(k) < 5 then 2 "
       "when 100.0 * min(k) / sum(k) < 15 then 1 else 0 end from (select count(*) as k from lineitem group by "
       "l_linenumber)"))
def _(spark, read):
    return advice.data_readiness(read("lineitem"), "l_linenumber")


@query("readiness_status", f"select l_orderkey, l_linenumber, l_quantity / 5 as score, {_status('(l_quantity / 5)')} "
       "as status from lineitem")
def _(spark, read):
    scores = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("score"))
    return advice.readiness_status(scores)


@query("suggest_algorithms", "select row_number() over (order by score desc, i)::int as position, name, score::double as score from (select 1 as i, "
       "'Random Forest' as name, 8.5 + case when n > 1000 then 0.5 else 0 end + 0.5 as score from (select count(*) as n "
       "from lineitem) union all select 2, 'Logistic Regression', 8.5 union all select 3, 'Gradient Boosting (XGBoost)', "
       "8.0 + case when n > 5000 then 1 else 0 end from (select count(*) as n from lineitem) union all select 4, "
       "'Support Vector Machine', 6.5 + case when n < 10000 then 1 else 0 end from (select count(*) as n from lineitem) "
       "union all select 5, 'Naive Bayes', 6.0)")
def _(spark, read):
    return advice.suggest_algorithms(read("lineitem"), "Classification", "l_returnflag").select(
        "position", "name", F.col("score"))


@query("compare_algorithms", "select row_number() over (order by score desc, i)::int as position, name, "
       "score::double as score, c::double as complexity_score, s::double as speed_score, r::double as "
       "interpretability_score, a::double as accuracy_potential from (select 1 as i, 'Random Forest Regressor' as name, "
       "8.0 + case when n > 1000 then 0.5 else 0 end as score, 6 as c, 7 as s, 8 as r, 8 as a from (select count(*) as n "
       "from orders) union all select 2, 'Linear Regression', 8.0, 2, 10, 10, 6 union all select 3, "
       "'Gradient Boosting Regressor', 8.5, 8, 5, 6, 9 union all select 4, 'Support Vector Regression', 6.5 + case when "
       "n < 10000 then 1 else 0 end, 7, 6, 4, 7 from (select count(*) as n from orders))")
def _(spark, read):
    return advice.compare_algorithms(advice.suggest_algorithms(read("orders"), "Regression", "o_totalprice"))


def _counted(frame: DataFrame) -> DataFrame:
    return frame.select("topic", "reason", "level", F.size("columns").alias("column_count"))


@query("feature_engineering", "select topic, reason, level, k::int as column_count from (select 'Missing Value "
       "Imputation' as topic, concat(k, ' columns have missing values') as reason, 'High' as level, k, k > 0 as ok from "
       "(select (count(q) < count(*))::int + (count(p) < count(*))::int + (count(rf) < count(*))::int as k from "
       f"{duck('fx_nulls')}) union all select 'Categorical Encoding', '1 categorical columns need encoding', 'High', 1, "
       "true union all select 'Feature Scaling', 'Features have very different scales', 'Medium', 4, greatest(a, b, c, d) "
       "/ least(a, b, c, d) > 100 from (select max(l_orderkey) - min(l_orderkey) as a, max(l_linenumber) - "
       f"min(l_linenumber) as b, max(q) - min(q) as c, max(p) - min(p) as d from {duck('fx_nulls')}) union all select "
       "'Outlier Treatment', concat(count(*), ' columns have significant outliers'), 'Medium', count(*), count(*) > 0 "
       f"from ({outlier_sql('fx_nulls', NUMERIC['fx_nulls'])}) where outlier_pct > 5) where ok")
def _(spark, read):
    return _counted(advice.feature_engineering(read("fx_nulls"), "rf"))


@query("preprocessing_steps", f"select 'Remove Duplicates' as topic, concat('Remove ', {dup_sql('fx_dups', columns('fx_dups'))}, "
       "' duplicate rows') as reason, 'High' as level, 3 as column_count union all select 'Encode Categorical "
       "Variables', 'Convert categorical variables to numerical format', 'High', 2")
def _(spark, read):
    return _counted(advice.preprocessing_steps(read("fx_dups"), "Classification", "o_orderstatus"))


@query("evaluation_strategy", "select 'MAE, MSE, RMSE, R-squared' as metrics, 'K-Fold Cross-Validation' as "
       "validation_method, 5 as cv_folds, 0.2::double as test_size from (select count(distinct o_totalprice) as u, "
       "count(o_totalprice) as n from orders) where u > 10 and u / n >= 0.05")
def _(spark, read):
    rows = read("orders")
    plan = advice.evaluation_strategy(spark, advice.target_task(rows, "o_totalprice"))
    return plan.withColumn("metrics", F.array_join("metrics", ", "))


@query("leakage_check", "select 'correlation' as \"check\", 'l_quantity' as \"column\", round(abs(corr(l_quantity, q2)), 6) "
       f"as abs_correlation from {duck('fx_coll')} having abs(corr(l_quantity, q2)) > 0.95")
def _(spark, read):
    return advice.leakage_check(read("fx_coll"), "q2")


@query("tips_and_challenges", "select kind, text from (select 'tip' as kind, 'Consider using sampling for initial model "
       "development' as text, count(*) > 100000 as ok from lineitem union all select 'tip', 'Use algorithms that scale "
       "well with large datasets', count(*) > 100000 from lineitem union all select 'tip', 'Focus on data cleaning before "
       f"model building', 10 - 100.0 * {dup_sql('fx_nulls', columns('fx_nulls'))} / count(*) < 7 from lineitem union all "
       "select 'challenge', 'High missing data rate may impact model performance', 10 - 50.0 * (3 * count(*) - count(q) - "
       f"count(p) - count(rf)) / (5 * count(*)) < 7 from {duck('fx_nulls')} union all select 'challenge', 'Small dataset "
       "size may limit model complexity', count(*) < 100 from lineitem union all select 'challenge', 'Imbalanced target "
       f"classes may require special handling', min(k) < 0.1 * (select count(*) from lineitem) from (select count(*) as k "
       f"from {duck('fx_nulls')} where rf is not null group by rf)) where ok")
def _(spark, read):
    return advice.tips_and_challenges(read("fx_nulls"), "Classification", "rf")


@query("ml_recommendations")
def _(spark, read):
    return advice.recommendation_table(read("lineitem"), target="l_returnflag")
