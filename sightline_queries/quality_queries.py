"""The ten detectors, their drill-downs, and the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import quality
from sightline_queries.registry import (NUMERIC, TEXT, TIME, columns, corr_sql, duck, dup_sql, fences_sql, outlier_sql,
                                        query, union)
from sightline_queries.profile_queries import _rates

BLANKS = "chr(32) || chr(9) || chr(10) || chr(13)"
LINE_PAIRS = [(a, b) for i, a in enumerate(NUMERIC["lineitem"]) for b in NUMERIC["lineitem"][i + 1:]]
COLL_PAIRS = [(a, b) for i, a in enumerate(NUMERIC["fx_coll"]) for b in NUMERIC["fx_coll"][i + 1:]]


@query("detect_missing_data", union([
    f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 6) as missing_pct from {duck('fx_nulls')}"
    for c in ("q", "p", "rf")]))
def _(spark, read):
    return quality.detect_missing_data(read("fx_nulls"))


@query("detect_type_mismatches", "select * from (" + union([
    f"select '{c}' as \"column\", 'string' as current_type, case when num > 0.8 * n then 'numeric' "
    f"when dat > 0.8 * n then 'datetime' end as suggested_type, round(num / n, 6) as numeric_rate, "
    f"round(dat / n, 6) as datetime_rate from {_rates(c)}" for c in TEXT["fx_types"]])
    + ") where suggested_type is not null")
def _(spark, read):
    return quality.detect_type_mismatches(read("fx_types"))


@query("detect_outliers_iqr", outlier_sql("lineitem", NUMERIC["lineitem"]))
def _(spark, read):
    return quality.detect_outliers_iqr(read("lineitem"))


@query("detect_outliers_iqr_events", outlier_sql("events", NUMERIC["events"]))
def _(spark, read):
    return quality.detect_outliers_iqr(read("events"))


@query("outlier_rows", f"select event_id, round(value, 6) as value from events, {fences_sql('events', 'value')} "
       "where value < lo or value > hi")
def _(spark, read):
    return quality.outlier_rows(read("events").select("event_id", "value"), "value")


@query("outlier_range", "select count(value) as outlier_count, round(min(value), 6) as lowest, "
       f"round(max(value), 6) as highest from events, {fences_sql('events', 'value')} where value < lo or value > hi")
def _(spark, read):
    return quality.outlier_range(read("events"), "value")


@query("zscore_outliers", "select event_id, round(value, 6) as value, round(abs(value - m) / s, 6) as z_score "
       "from events, (select avg(value) as m, stddev_pop(value) as s from events) where abs(value - m) / s > 3")
def _(spark, read):
    return quality.zscore_outliers(read("events").select("event_id", "value"), "value")


@query("detect_duplicate_rows", f"select {dup_sql('fx_dups', columns('fx_dups'))} as duplicate_count, "
       f"round(100.0 * {dup_sql('fx_dups', columns('fx_dups'))} / count(*), 6) as duplicate_pct from {duck('fx_dups')}")
def _(spark, read):
    return quality.detect_duplicate_rows(read("fx_dups"))


@query("duplicate_preview", "select o_orderkey, o_orderstatus, o_orderpriority, count(*) - 1 as surplus "
       f"from {duck('fx_dups')} group by 1, 2, 3 having count(*) > 1 order by 1, 2, 3 limit 10")
def _(spark, read):
    return quality.duplicate_preview(read("fx_dups"))


@query("duplicates_by_column", union([
    f"select '{c}' as \"column\", count(*) - count(distinct {c}) - max(case when {c} is null then 1 else 0 end) "
    f"as duplicate_count, count(distinct {c}) as unique_values, round(100.0 * (count(*) - count(distinct {c}) - "
    f"max(case when {c} is null then 1 else 0 end)) / count(*), 6) as duplicate_pct from {duck('fx_nulls')}"
    for c in ("l_orderkey", "l_linenumber", "q", "p", "rf")]))
def _(spark, read):
    return quality.duplicates_by_column(read("fx_nulls"))


@query("detect_inconsistent_categories", "select 'pr' as \"column\", base_value, variation, row_count, variation_count "
       "from (select *, count(*) over (partition by base_value) as variation_count from (select pr as variation, "
       f"lower(trim(pr, {BLANKS})) as base_value, count(*) as row_count from {duck('fx_cats')} group by 1, 2)) "
       "where variation_count > 1")
def _(spark, read):
    return quality.detect_inconsistent_categories(read("fx_cats"))


@query("case_variations", "select value, similar_values, 'Case Variation' as issue_type from (select value, "
       f"count(*) over (partition by lower(value)) - 1 as similar_values from (select distinct pr as value "
       f"from {duck('fx_cats')})) where similar_values > 0")
def _(spark, read):
    return quality.case_variations(read("fx_cats"), "pr")


def _imbalance_sql(t: str) -> str:
    rows = union([f"select '{c}' as \"column\", max(k) / min(k) as ratio, max(k) as majority_count, "
                  f"min(k) as minority_count, count(*) as classes from (select count(*) as k from {duck(t)} "
                  f"where {c} is not null group by {c})" for c in TEXT[t]])
    return (f"select \"column\", round(ratio, 6) as imbalance_ratio, majority_count, minority_count, classes "
            f"from ({rows}) where classes > 1 and ratio > 3")


@query("detect_class_imbalance", _imbalance_sql("fx_cats"))
def _(spark, read):
    return quality.detect_class_imbalance(read("fx_cats"))


@query("class_balance", "select o_orderpriority as \"class\", count(*) as class_count, "
       "round(count(*) / min(count(*)) over (), 6) as ratio_to_minority from orders group by 1")
def _(spark, read):
    return quality.class_balance(read("orders"), "o_orderpriority")


def _pop_skew(t: str, c: str) -> str:
    return (f"(select case when m2 = 0 then null else m3 / pow(m2, 1.5) end as s, n from (select "
            f"avg(pow(cast({c} as double) - m, 2)) as m2, avg(pow(cast({c} as double) - m, 3)) as m3, count({c}) as n "
            f"from {duck(t)}, (select avg({c}) as m from {duck(t)})))")


@query("detect_skewed", "select * from (" + union([
    f"select '{c}' as \"column\", round(s, 6) as skewness, case when abs(s) > 2 then 'Highly Skewed' "
    f"else 'Moderately Skewed' end as interpretation from {_pop_skew('events', c)} where abs(s) > 1"
    for c in NUMERIC["events"]]) + ")")
def _(spark, read):
    return quality.detect_skewed(read("events"))


@query("skewness_table", union([
    f"select '{c}' as \"column\", round(s, 6) + 0.0 as skewness, case when abs(s) > 1 then 'Highly Skewed' "
    f"when abs(s) > 0.5 then 'Moderately Skewed' else 'Approximately Normal' end as interpretation "
    f"from {_pop_skew('lineitem', c)}" for c in NUMERIC["lineitem"]]))
def _(spark, read):
    return quality.skewness_table(read("lineitem"))


@query("sample_moments", union([
    f"select '{c}' as \"column\", round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis "
    f"from events" for c in NUMERIC["events"]]))
def _(spark, read):
    return quality.sample_moments(read("events"))


def _low_variance_sql(t: str) -> str:
    rows = [f"select '{c}' as \"column\", 'numeric' as kind, round(var_samp({c}), 6) as variance, "
            f"null::double as unique_ratio, var_samp({c}) < 0.01 as low from {duck(t)}" for c in NUMERIC[t]]
    rows += [f"select '{c}', 'categorical', null, round(count(distinct {c}) / count(*), 6), "
             f"count(distinct {c}) / count(*) < 0.01 from {duck(t)}" for c in TEXT[t] + TIME.get(t, [])]
    return f"select * exclude (low) from ({union(rows)}) where low"


@query("detect_low_variance", _low_variance_sql("fx_const"))
def _(spark, read):
    return quality.detect_low_variance(read("fx_const"))


@query("detect_low_variance_lineitem", _low_variance_sql("lineitem"))
def _(spark, read):
    return quality.detect_low_variance(read("lineitem"))


@query("low_variance_details", "select 'k_num' as \"column\", 'numeric' as kind, round(var_samp(k_num), 6) as variance, "
       "round(stddev_samp(k_num), 6) as std, max(k_num) - min(k_num) as value_range, null::bigint as unique_values, "
       f"null::double as unique_ratio, null::varchar as most_common from {duck('fx_const')} union all "
       "select 'k_txt', 'categorical', null, null, null, count(distinct k_txt), "
       f"round(count(distinct k_txt) / count(*), 6), min(k_txt) from {duck('fx_const')}")
def _(spark, read):
    return quality.low_variance_details(read("fx_const"))


@query("detect_multicollinearity", "select column_1, column_2, round(r, 6) as correlation, case when abs(r) > 0.9 "
       f"then 'Very High' else 'High' end as strength from ({corr_sql('fx_coll', COLL_PAIRS)}) where abs(r) > 0.8")
def _(spark, read):
    return quality.detect_multicollinearity(read("fx_coll"))


RULES = [("discount_rate", "Invalid Percentage", "discount_rate < 0 or discount_rate > 100"),
         ("age_days", "Invalid Age", "age_days < 0 or age_days > 150"),
         ("net_price", "Negative Financial Value", "net_price < 0")]


@query("detect_invalid_values", union([
    f"select '{c}' as \"column\", '{issue}' as issue, count(*) filter (where {bad}) as invalid_count, "
    f"(select string_agg(v::decimal(18, 4)::varchar, ',' order by v) from (select cast({c} as double) as v "
    f"from {duck('fx_rates')} where {bad} order by v limit 5)) as examples from {duck('fx_rates')}"
    for c, issue, bad in RULES]))
def _(spark, read):
    found = quality.detect_invalid_values(read("fx_rates"))
    texts = F.transform("examples", lambda v: F.round(v, 4).cast("decimal(18,4)").cast("string"))
    return found.withColumn("examples", F.array_join(texts, ","))


@query("detect_invalid_values_pages", "select 'page_id' as \"column\", 'Invalid Age' as issue, "
       "count(*) as invalid_count from pages where page_id < 0 or page_id > 150 having count(*) > 0")
def _(spark, read):
    return quality.detect_invalid_values(read("pages")).drop("examples")


def _summary_sql(t: str) -> str:
    """Issue summary of a table without missing values, type mismatches or invalid values."""
    n = f"(select count(*) from {duck(t)})"
    pairs = [(a, b) for i, a in enumerate(NUMERIC[t]) for b in NUMERIC[t][i + 1:]]
    dup = dup_sql(t, columns(t))
    outliers = f"(select coalesce(sum(outlier_count), 0)::bigint from ({outlier_sql(t, NUMERIC[t])}))"
    outlier_cols = f"(select count(*) from ({outlier_sql(t, NUMERIC[t])}))"
    groups = "(select count(*) from (" + union([
        f"select 1 from (select distinct {c} as v from {duck(t)}) group by lower(trim(v, {BLANKS})) having count(*) > 1"
        for c in TEXT[t]]) + "))"
    imbalance = f"(select count(*) from ({_imbalance_sql(t)}))"
    worst = f"(select coalesce(max(imbalance_ratio), 0) from ({_imbalance_sql(t)}))"
    skew = "(select count(*) from (" + union([f"select s from {_pop_skew(t, c)} where abs(s) > 1" for c in NUMERIC[t]]) + "))"
    low = f"(select count(*) from ({_low_variance_sql(t)}))"
    coll = f"(select count(*) from ({corr_sql(t, pairs)}) where abs(r) > 0.8)"
    rows = [("missing_data", "0::bigint", "'Low'", "'0 columns have missing values'"),
            ("data_type_mismatches", "0::bigint", "'Low'", "'0 columns may have incorrect data types'"),
            ("outliers", outliers, f"case when {outliers} > 0.1 * {n} then 'High' when {outliers} > 0 then 'Medium' "
             "else 'Low' end", f"concat({outliers}, ' outliers detected across ', {outlier_cols}, ' columns')"),
            ("duplicate_rows", dup, f"case when {dup} > 0.1 * {n} then 'High' when {dup} > 0 then 'Medium' else 'Low' "
             "end", f"concat({dup}, ' duplicate rows found (', printf('%.1f', 100.0 * {dup} / {n}), '%)')"),
            ("inconsistent_categories", groups, f"case when {groups} > 0 then 'Medium' else 'Low' end",
             f"concat({groups}, ' inconsistent categories detected')"),
            ("class_imbalance", imbalance, f"case when {worst} > 10 then 'High' when {imbalance} > 0 then 'Medium' "
             "else 'Low' end", f"concat({imbalance}, ' columns show class imbalance')"),
            ("skewed_distributions", skew, f"case when {skew} > 0 then 'Medium' else 'Low' end",
             f"concat({skew}, ' columns have skewed distributions')"),
            ("low_variance_columns", low, f"case when {low} > 0 then 'Medium' else 'Low' end",
             f"concat({low}, ' columns have low variance')"),
            ("multicollinearity", coll, f"case when {coll} > 0 then 'High' else 'Low' end",
             f"concat({coll}, ' highly correlated pairs detected')"),
            ("invalid_values", "0::bigint", "'Low'", "'0 columns contain invalid values'")]
    return union([f"select '{i}' as issue, {k} as issue_count, {s} as severity, {d} as description, "
                  f"case when {k} > 0 then 'Needs Attention' else 'OK' end as status" for i, k, s, d in rows])


@query("issue_summary", _summary_sql("events"))
def _(spark, read):
    return quality.issue_summary(read("events"))


@query("issue_summary_found", f"select * from ({_summary_sql('part')}) where issue_count > 0")
def _(spark, read):
    return quality.issue_summary(read("part"), only_found=True)


def _all_issues_sql(t: str) -> str:
    pairs = [(a, b) for i, a in enumerate(NUMERIC[t]) for b in NUMERIC[t][i + 1:]]
    return union([
        f"select 'outliers' as issue, \"column\" as item, outlier_count::double as measure "
        f"from ({outlier_sql(t, NUMERIC[t])})",
        f"select 'duplicate_rows', 'table', {dup_sql(t, columns(t))}::double",
        f"select 'class_imbalance', \"column\", imbalance_ratio from ({_imbalance_sql(t)})",
        *[f"select 'skewed_distributions', '{c}', round(s, 6) from {_pop_skew(t, c)} where abs(s) > 1"
          for c in NUMERIC[t]],
        f"select 'low_variance_columns', \"column\", coalesce(variance, unique_ratio) from ({_low_variance_sql(t)})",
        f"select 'multicollinearity', column_1, round(r, 6) from ({corr_sql(t, pairs)}) where abs(r) > 0.8"])


@query("detect_all_issues", _all_issues_sql("events"))
def _(spark, read):
    return quality.all_issues_table(read("events"))


def _score_sql(t: str, completeness: str, consistency: str, validity: str) -> str:
    return (f"select *, round(0.3 * completeness + 0.3 * uniqueness + 0.2 * consistency + 0.2 * validity, 6) as overall "
            f"from (select round(({completeness})::double, 6) as completeness, round(100.0 * (count(*) - "
            f"{dup_sql(t, columns(t))}) / count(*), 6) as uniqueness, {consistency}::double as consistency, "
            f"{validity}::double as validity from {duck(t)})")


@query("quality_score", _score_sql("fx_nulls", "100.0 * (2 * count(*) + count(q) + count(p) + count(rf)) / "
                                   "(5 * count(*))", "100", "100"))
def _(spark, read):
    return quality.quality_score(read("fx_nulls"))


@query("quality_score_categories", _score_sql("fx_cats", "100.0", "case when (select count(distinct lower(pr)) < "
       f"count(distinct pr) from {duck('fx_cats')}) then 0 else 100 end", "100"))
def _(spark, read):
    return quality.quality_score(read("fx_cats"))


@query("quality_score_validity", _score_sql(
    "fx_rates", "100.0", "100", "100 - 100.0 * ((count(*) filter (where discount_rate < 0 or discount_rate > 100) > 0)"
    "::int + (count(*) filter (where age_days < 0 or age_days > 150) > 0)::int) / 2"))
def _(spark, read):
    return quality.quality_score(read("fx_rates"))
