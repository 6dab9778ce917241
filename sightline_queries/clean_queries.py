"""Cleaning stages, pipeline, reports and value transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import cleaning, transforms
from sightline.plans import cleaning_plan
from sightline.sources import export
from sightline_queries.registry import boxcox_best_sql, columns, duck, dup_sql, fences_sql, query, union


def _filled(q: str, p: str) -> str:
    mode = f"(select rf from {duck('fx_nulls')} where rf is not null group by 1 order by count(*) desc, rf limit 1)"
    return (f"select l_orderkey, l_linenumber, round(coalesce(q, (select {q} from {duck('fx_nulls')})), 6) as q, "
            f"round(coalesce(p, (select {p} from {duck('fx_nulls')})), 6) as p, coalesce(rf, {mode}) as rf "
            f"from {duck('fx_nulls')}")


@query("impute_median", _filled("quantile_cont(q, 0.5)", "quantile_cont(p, 0.5)"))
def _(spark, read):
    return cleaning.impute(read("fx_nulls"))[0]


@query("impute_mean", _filled("avg(q)", "avg(p)"))
def _(spark, read):
    return cleaning.impute(read("fx_nulls"), numeric="mean")[0]


@query("standardize", "select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders, "
       "(select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)")
def _(spark, read):
    return transforms.standardize(read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("standardize_sample", "select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders, "
       "(select avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from orders)")
def _(spark, read):
    return transforms.standardize(read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ddof=1)


@query("normalize_minmax", "select l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) as l_quantity "
       "from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)")
def _(spark, read):
    return transforms.normalize_minmax(read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("log_transform", "select o_orderkey, round(ln(o_totalprice), 6) as o_totalprice from orders")
def _(spark, read):
    return transforms.log_transform(read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("sqrt_transform", "select event_id, round(sqrt(value), 6) as value from events")
def _(spark, read):
    return transforms.sqrt_transform(read("events").select("event_id", "value"), "value")


@query("square_transform", "select event_id, round(value * value, 6) as value from events")
def _(spark, read):
    return transforms.square_transform(read("events").select("event_id", "value"), "value")


@query("boxcox", boxcox_best_sql("orders", "o_totalprice") + " select o_orderkey, (exp(g * ln(o_totalprice)) - 1) / g as "
       "o_totalprice from orders, best5")
def _(spark, read):
    return transforms.boxcox(read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("lowercase", "select c_custkey, lower(c_mktsegment) as c_mktsegment from customer")
def _(spark, read):
    return transforms.lowercase(read("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("uppercase", "select doc_id, upper(source) as source from documents")
def _(spark, read):
    return transforms.uppercase(read("documents").select("doc_id", "source"), "source")


@query("titlecase", "select p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), "
       "'[a-z]+|[^a-z]+'), lambda w: concat(upper(w[1]), w[2:])), '') as p_name from part")
def _(spark, read):
    return transforms.titlecase(read("part").select("p_partkey", "p_name"), "p_name")


@query("strip_text", f"select o_orderkey, trim(pr) as pr from {duck('fx_cats')}")
def _(spark, read):
    return transforms.strip_text(read("fx_cats"), "pr")


@query("drop_duplicates", f"select distinct * from {duck('fx_dups')}")
def _(spark, read):
    return cleaning.drop_duplicates(read("fx_dups"))[0]


@query("fix_types", f"select event_id, try_cast(num_txt as double) as num_txt, cast(try_cast(date_txt as timestamp) "
       f"as varchar) as date_txt, event_type from {duck('fx_types')}")
def _(spark, read):
    return cleaning.fix_types(read("fx_types"))[0].withColumn("date_txt", F.col("date_txt").cast("string"))


@query("cap_outliers", "select event_id, round(least(greatest(value, lo), hi), 6) as value from events, "
       f"{fences_sql('events', 'value')}")
def _(spark, read):
    return cleaning.cap_outliers(read("events").select("event_id", "value"))[0]


@query("fix_categories", f"select o_orderkey, lower(trim(pr)) as pr from {duck('fx_cats')}")
def _(spark, read):
    return cleaning.fix_categories(read("fx_cats"))[0]


@query("fix_categories_log", "select 1 as step, concat('Fixed inconsistent categories in ''pr'': ', "
       f"count(distinct pr), ' → ', count(distinct lower(trim(pr))), ' unique values') as operation from {duck('fx_cats')}")
def _(spark, read):
    rows = read("fx_cats")
    return cleaning.log_frame(rows, cleaning.fix_categories(rows)[1])


@query("drop_low_variance", "select event_id, round(value, 6) as value from events")
def _(spark, read):
    return cleaning.drop_low_variance(read("fx_const"))[0]


@query("clean_default", "select distinct * from (" + _filled("quantile_cont(q, 0.5)", "quantile_cont(p, 0.5)") + ")")
def _(spark, read):
    return cleaning.clean(read("fx_nulls"))[0]


_CAPPED = f"(select event_id, least(greatest(value, lo), hi) as v from events, {fences_sql('events', 'value')})"


@query("clean_scaled", "select round((event_id - i) / si, 6) as event_id, round((v - m) / s, 6) as value from "
       f"{_CAPPED}, (select avg(event_id) as i, stddev_pop(event_id) as si, avg(v) as m, stddev_pop(v) as s "
       f"from {_CAPPED})")
def _(spark, read):
    options = {"types": True, "outliers": True, "scale": True, "categories": True, "low_variance": True}
    return cleaning.clean(read("fx_const"), options)[0]


PLAN_MEDIAN = {"priority_issues": [{"issue": "Missing values", "strategy": "fill with the median"}]}
PLAN_CAP = {"priority_issues": [{"issue": "Outliers in value", "strategy": "cap them at the fences"}]}
PLAN_CLIP = {"priority_issues": [{"issue": "Outlier rows", "strategy": "clip"}]}
PLAN_TYPE = {"priority_issues": [{"issue": "Wrong data types", "strategy": "convert"}]}


@query("apply_cleaning_plan_median", _filled("quantile_cont(q, 0.5)", "quantile_cont(p, 0.5)"))
def _(spark, read):
    return cleaning_plan.apply_cleaning_plan(read("fx_nulls"), PLAN_MEDIAN)[0]


@query("apply_cleaning_plan_cap", "select event_id, round(least(greatest(value, lo), hi), 6) as value from events, "
       f"{fences_sql('events', 'value')}")
def _(spark, read):
    return cleaning_plan.apply_cleaning_plan(read("events"), PLAN_CAP)[0].select("event_id", "value")


@query("apply_cleaning_plan_clip", "select l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 6) as "
       f"l_extendedprice from lineitem, {fences_sql('lineitem', 'l_extendedprice')}")
def _(spark, read):
    return cleaning_plan.apply_cleaning_plan(read("lineitem"), PLAN_CLIP)[0].select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("apply_cleaning_plan_type", "select event_id, try_cast(num_txt as double) as num_txt, date_txt, event_type "
       f"from {duck('fx_types')}")
def _(spark, read):
    return cleaning_plan.apply_cleaning_plan(read("fx_types"), PLAN_TYPE)[0]


PLAN = {"priority_issues": [
    {"issue": "Missing values", "strategy": "fill with the mean"}, {"issue": "duplicate rows", "strategy": "drop"},
    {"issue": "Outliers in p", "strategy": "look at them"}, {"issue": "layout", "strategy": "none"}]}


@query("apply_cleaning_plan", "select distinct * from (" + _filled("avg(q)", "avg(p)") + ")")
def _(spark, read):
    return cleaning_plan.apply_cleaning_plan(read("fx_nulls"), PLAN)[0]


@query("compare", "select *, before - after as reduction from (select 'rows' as metric, count(*) as before, "
       f"(select count(*) from (select distinct * from {duck('fx_dups')})) as after from {duck('fx_dups')} union all "
       "select 'columns', 3, 3 union all select 'missing_cells', 0, 0 union all select 'duplicate_rows', "
       f"{dup_sql('fx_dups', columns('fx_dups'))}, 0)")
def _(spark, read):
    rows = read("fx_dups")
    return cleaning.compare(rows, cleaning.drop_duplicates(rows)[0])


@query("compare_types", "select * from (values ('date_txt', 'string', 'timestamp_ntz', true), ('event_id', 'bigint', "
       "'bigint', false), ('event_type', 'string', 'N/A', true), ('num_txt', 'string', 'double', true)) "
       "as t(\"column\", original_type, cleaned_type, changed)")
def _(spark, read):
    rows = read("fx_types")
    return cleaning.compare_types(rows, cleaning.fix_types(rows)[0].drop("event_type"))


@query("completeness_metrics", "select 'completeness' as metric, round(100.0 * (2 * count(*) + count(q) + count(p) + "
       f"count(rf)) / (5 * count(*)), 6) as original_pct, 100.0::double as cleaned_pct from {duck('fx_nulls')} union all "
       f"select 'uniqueness', round(100.0 * (count(*) - {dup_sql('fx_nulls', columns('fx_nulls'))}) / count(*), 6), "
       f"100.0::double from {duck('fx_nulls')}")
def _(spark, read):
    rows = read("fx_nulls")
    return cleaning.completeness_metrics(rows, cleaning.clean(rows)[0])


@query("cleaning_report_shape", "select *, before - after as reduction from (select 'rows' as metric, count(*) as before, "
       f"(select count(*) from (select distinct * from {duck('fx_dups')})) as after from {duck('fx_dups')} union all "
       "select 'columns', 3, 3 union all select 'missing_cells', 0, 0 union all select 'duplicate_rows', "
       f"{dup_sql('fx_dups', columns('fx_dups'))}, 0)")
def _(spark, read):
    """The shapes inside the report."""
    rows = read("fx_dups")
    report = export.cleaning_report(rows, *cleaning.clean(rows))
    schema = "shape array<struct<metric: string, before: bigint, after: bigint, reduction: bigint>>"
    return report.select(F.from_json("document", schema).alias("d")).select(F.expr("inline(d.shape)"))


@query("cleaning_report")
def _(spark, read):
    rows = read("fx_dups")
    return export.cleaning_report(rows, *cleaning.clean(rows))


NUMBERS = r"[-+]?\d*\.\d+|[-+]?\d+"


@query("extract_number_first", f"select s_suppkey, try_cast(regexp_extract(lat_lon, '{NUMBERS}') as double) as lat_lon "
       f"from {duck('fx_geo')}")
def _(spark, read):
    return transforms.extract_number(read("fx_geo"), "lat_lon")


@query("extract_number_last", f"select s_suppkey, try_cast(regexp_extract_all(lat_lon, '{NUMBERS}')[-1] as double) "
       f"as lat_lon from {duck('fx_geo')}")
def _(spark, read):
    return transforms.extract_number(read("fx_geo"), "lat_lon", "last")


@query("geo_points", f"select * from (select s_suppkey, lat_lon, try_cast(regexp_extract(lat_lon, '{NUMBERS}') as "
       f"double) as latitude, try_cast(regexp_extract_all(lat_lon, '{NUMBERS}')[-1] as double) as longitude "
       f"from {duck('fx_geo')}) where latitude between -90 and 90 and longitude between -180 and 180")
def _(spark, read):
    return transforms.geo_points(read("fx_geo"))


@query("extract_json", "select event_id, json_extract_string(props, '$.k')::bigint as k, event_type in ('error') "
       "as failed from events")
def _(spark, read):
    """Three spellings per row: clean JSON, JSON inside prose, and no JSON at all for events of type error."""
    noisy = read("events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "no json { here")
                                  .when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure: "), "props", F.lit(" done.")))
                                  .otherwise(F.col("props")).alias("reply"), "props")
    out = transforms.extract_json(noisy, "reply")
    failed = F.get_json_object("json", "$.error").isNotNull()
    k = F.get_json_object(F.when(failed, F.col("props")).otherwise(F.col("json")), "$.k").cast("bigint")
    return out.select("event_id", k.alias("k"), failed.alias("failed"))
