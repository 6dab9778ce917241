"""Group-by, hierarchies, KPIs, charts, distributions, correlation and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.normal import quantile_sql
from sightline.operators import charts, correlation, distribution, groups, hypothesis, transforms
from sightline.plans import dashboard
from sightline_queries.registry import NUMERIC, boxcox_best_sql, corr_sql, duck, query, union

PRICE = "l_extendedprice"


@query("group_mean", "select l_returnflag, round(avg(l_quantity), 6) as mean_value from lineitem group by 1")
def _(spark, read):
    return groups.group_mean(read("lineitem"), "l_returnflag", "l_quantity")


@query("group_count", f"select rf, count(*) as row_count from {duck('fx_nulls')} where rf is not null group by 1")
def _(spark, read):
    return groups.group_count(read("fx_nulls"), "rf")


@query("group_sum", "select p_brand, p_type, round(sum(p_retailprice), 2) as total from part group by 1, 2", digits=2)
def _(spark, read):
    return groups.group_sum(read("part"), ["p_brand", "p_type"], "p_retailprice")


@query("value_counts", "select p_name as value, count(*) as row_count from part group by 1 order by 2 desc, 1 limit 20")
def _(spark, read):
    return groups.value_counts(read("part"), "p_name", 20)


@query("class_distribution", "select rf as \"class\", count(*) as class_count, round(100.0 * count(*) / "
       f"(select count(*) from lineitem), 2) as percentage from {duck('fx_nulls')} where rf is not null group by 1")
def _(spark, read):
    return groups.class_distribution(read("fx_nulls"), "rf")


@query("crosstab", "select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as \"1-URGENT\", "
       "count(*) filter (where o_orderpriority = '2-HIGH') as \"2-HIGH\", count(*) filter (where o_orderpriority = "
       "'3-MEDIUM') as \"3-MEDIUM\", count(*) filter (where o_orderpriority = '4-NOT SPECIFIED') as "
       "\"4-NOT SPECIFIED\", count(*) filter (where o_orderpriority = '5-LOW') as \"5-LOW\" from orders group by 1")
def _(spark, read):
    return groups.crosstab(read("orders"), "o_orderstatus", "o_orderpriority")


@query("crosstab_long", "select o_orderstatus, o_orderpriority, count(*) as row_count from orders group by 1, 2")
def _(spark, read):
    return groups.crosstab_long(read("orders"), "o_orderstatus", "o_orderpriority")


def _rollup_sql(t: str, levels: list[str], value: str) -> str:
    keys = ", ".join(levels)
    depth = " + ".join(f"(1 - grouping({c}))" for c in levels)
    where = " and ".join(f"{c} is not null" for c in levels)
    return f"select {keys}, ({depth})::int as depth, {value} as total from {duck(t)} where {where} group by rollup({keys})"


@query("hierarchy_rollup", _rollup_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"],
                                       "round(sum(l_quantity), 2)"), digits=2)
def _(spark, read):
    return groups.hierarchy_rollup(read("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")


@query("hierarchy_rollup_count", _rollup_sql("part", ["p_brand", "p_type"], "count(*)::double"))
def _(spark, read):
    return groups.hierarchy_rollup(read("part"), ["p_brand", "p_type"])


@query("hierarchy_statistics", "select count(*) as categories, sum(k)::double as total_value, round(avg(k), 6) as average "
       "from (select count(*) as k from part group by p_brand, p_type)")
def _(spark, read):
    return groups.hierarchy_statistics(read("part"), ["p_brand", "p_type"])


@query("treemap_data", _rollup_sql("customer", ["c_mktsegment"], "round(sum(c_acctbal), 2)"), digits=2)
def _(spark, read):
    return groups.treemap_data(read("customer"), ["c_mktsegment"], "c_acctbal")


def _kpi_format(v: str) -> str:
    return (f"case when {v} >= 1e6 then printf('%.1fM', {v} / 1e6) when {v} >= 1e3 then printf('%.1fK', {v} / 1e3) "
            f"else printf('%.1f', {v}) end")


KPIS = [("lineitem", "l_extendedprice", "sum", "sum(l_extendedprice)"), ("lineitem", "l_quantity", "mean", "avg(l_quantity)"),
        ("lineitem", "l_discount", "max", "max(l_discount)"), ("lineitem", "l_returnflag", "sum", "count(l_returnflag)"),
        ("fx_types", "num_txt", "sum", "sum(try_cast(num_txt as double))"),
        ("lineitem", "l_tax", "count", "count(l_tax)")]


@query("kpi", union([f"select '{c}' as \"column\", '{a}' as aggregation, round(v, 2) as value, {_kpi_format('v')} as "
                     f"formatted from (select ({e})::double as v from {duck(t)})" for t, c, a, e in KPIS]), digits=2)
def _(spark, read):
    return reduce(DataFrame.unionByName, [groups.kpi(read(t), c, a) for t, c, a, _ in KPIS])


@query("format_kpi", f"select o_orderkey, {_kpi_format('(o_totalprice * 10)')} as formatted from orders")
def _(spark, read):
    return read("orders").select("o_orderkey", groups.format_kpi(F.col("o_totalprice") * 10).alias("formatted"))


SPEC = {"dashboard_title": "Lines", "kpis": [
    {"name": "Revenue", "column": "l_extendedprice", "aggregation": "sum"},
    {"name": "Lines", "column": "l_orderkey", "aggregation": "count"}, {"name": "None", "column": "missing"}],
    "charts": [{"title": "By flag", "type": "bar", "x_column": "l_returnflag", "y_column": None},
               {"title": "Share", "type": "pie", "x_column": "l_linestatus"},
               {"title": "Prices", "type": "bar", "x_column": "l_extendedprice"},
               {"title": "Boxes", "type": "box", "x_column": "l_returnflag", "y_column": "l_quantity"},
               {"title": "Heat", "type": "heatmap"}, {"title": "Odd", "type": "radar", "x_column": "l_tax"}],
    "layout": {"rows": 2, "columns": 2}}


@query("run_dashboard_kpis", "select name, \"column\", aggregation, round(v, 2) as value, "
       f"{_kpi_format('v')} as formatted from (select 'Revenue' as name, 'l_extendedprice' as \"column\", "
       "'sum' as aggregation, sum(l_extendedprice) as v from lineitem union all select 'Lines', 'l_orderkey', 'count', "
       "count(l_orderkey)::double from lineitem)", digits=2)
def _(spark, read):
    return dashboard.run_dashboard(read("lineitem"), SPEC)["kpis"]


@query("run_dashboard", "select 'By flag' as chart, l_returnflag as item, count(*)::double as measure from lineitem "
       "group by 2 union all select 'Share', l_linestatus, count(*) from lineitem group by 2 union all "
       "select 'Boxes', l_returnflag, quantile_cont(l_quantity, 0.5) from lineitem group by 2")
def _(spark, read):
    made = dashboard.run_dashboard(read("lineitem"), SPEC)
    pick = {"By flag": ("value", "row_count"), "Share": ("value", "row_count"), "Boxes": ("l_returnflag", "median")}
    return reduce(DataFrame.unionByName, [made[t].select(F.lit(t).alias("chart"), F.col(i).alias("item"),
                                                         F.col(m).cast("double").alias("measure"))
                                          for t, (i, m) in pick.items()])


@query("chart_data", "select o_orderpriority as value, count(*) as row_count from orders group by 1 "
       "order by 2 desc, 1 limit 10")
def _(spark, read):
    return charts.chart_data(read("orders"), {"type": "bar", "x_column": "o_orderpriority"})


@query("line_data", "select event_type as series, event_id as x, round(value, 6) as y from events")
def _(spark, read):
    return charts.line_data(read("events"), "event_id", "value", "event_type")


@query("scatter_data", "select l_quantity::double as x, round(l_extendedprice, 6) as y, l_returnflag as category, "
       "round(l_discount / max(l_discount) over (partition by l_returnflag) * 20 + 5, 6) as marker_size from lineitem")
def _(spark, read):
    return charts.scatter_data(read("lineitem"), "l_quantity", PRICE, color="l_returnflag", size="l_discount")


@query("scatter_data_3d", "select l_quantity::double as x, round(l_extendedprice, 6) as y, l_tax::double as z, "
       "round(l_discount / (select max(l_discount) from lineitem) * 20 + 5, 6) as marker_size from lineitem")
def _(spark, read):
    return charts.scatter_data(read("lineitem"), "l_quantity", PRICE, "l_tax", size="l_discount")


@query("scatter_matrix_data", "select l_quantity, round(l_extendedprice, 6) as l_extendedprice, l_discount from lineitem")
def _(spark, read):
    return charts.scatter_matrix_data(read("lineitem"), ["l_quantity", PRICE, "l_discount"])


@query("rug_data", f"select round(p, 6) as value from {duck('fx_nulls')} where p is not null")
def _(spark, read):
    return charts.rug_data(read("fx_nulls"), "p")


@query("time_series", f"select cast(cast(day_txt as timestamp) as varchar) as moment, round(value, 6) as value "
       f"from {duck('fx_dates')}")
def _(spark, read):
    return charts.time_series(read("fx_dates"), "day_txt", "value").withColumn("moment", F.col("moment").cast("string"))


@query("time_series_monthly", "select cast(date_trunc('month', o_orderdate) as date) as period, "
       "round(avg(o_totalprice), 6) as mean_value, count(o_totalprice) as value_count from orders group by 1")
def _(spark, read):
    return charts.time_series(read("orders"), "o_orderdate", "o_totalprice", "month").withColumn(
        "period", F.col("period").cast("date"))


def _hist_sql(t: str, c: str, bins: int, name: str | None = None) -> str:
    head = f"'{name}' as \"column\", " if name else ""
    tail = "" if name else f", round(coalesce(k, 0) / (n * w), 12) as density"
    return (f"select {head}b.bin::int as bin, round(lo + b.bin * w, 6) as bin_start, round(lo + (b.bin + 1) * w, 6) "
            f"as bin_end, coalesce(k, 0) as row_count{tail} from range({bins}) as b(bin) cross join "
            f"(select min({c})::double as lo, (max({c}) - min({c}))::double / {bins} as w, count({c}) as n "
            f"from {duck(t)}) left join (select least(floor(({c} - lo) / w), {bins - 1}) as bin, count(*) as k "
            f"from {duck(t)}, (select min({c})::double as lo, (max({c}) - min({c}))::double / {bins} as w "
            f"from {duck(t)}) where {c} is not null group by 1) h on h.bin = b.bin")


@query("histogram", f"select bin, bin_start, bin_end, row_count, round(density, 6) as density from "
       f"({_hist_sql('events', 'value', 30)})")
def _(spark, read):
    return distribution.histogram(read("events"), "value", 30)


@query("histogram_missing", f"select bin, bin_start, bin_end, row_count, round(density, 6) as density from "
       f"({_hist_sql('fx_nulls', 'p', 15)})")
def _(spark, read):
    return distribution.histogram(read("fx_nulls"), "p", 15)


@query("histogram_series", "select f.series, f.bin::int as bin, round(lo + f.bin * w, 6) as bin_start, "
       "round(lo + (f.bin + 1) * w, 6) as bin_end, count(h.bin) as row_count, round(count(h.bin) / (any_value(f.n) * w), "
       "6) as density from (select event_type as series, n, bin from (select event_type, count(*) as n from events "
       "group by 1), range(10) as r(bin)) f cross join (select min(value) as lo, (max(value) - min(value)) / 10 as w "
       "from events) left join (select event_type as series, least(floor((value - lo) / w), 9) as bin from events, "
       "(select min(value) as lo, (max(value) - min(value)) / 10 as w from events)) h on h.series = f.series and "
       "h.bin = f.bin group by f.series, f.bin, lo, w")
def _(spark, read):
    return distribution.histogram(read("events"), "value", 10, "event_type")


@query("histogram_overlaid", union([_hist_sql("lineitem", c, 20, c) for c in ("l_quantity", "l_extendedprice")]))
def _(spark, read):
    return distribution.histogram_overlaid(read("lineitem"), ["l_quantity", "l_extendedprice"], 20)


def _box_sql(t: str, c: str, by: str | None) -> str:
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    on = f"using ({by})" if by else "on true"
    return (f"select {key}count({c}) as row_count, round(avg({c}), 6) as mean, round(any_value(q1), 6) as q1, "
            f"round(any_value(q2), 6) as median, round(any_value(q3), 6) as q3, round(any_value(q3 - q1), 6) as iqr, "
            f"round(any_value(q1 - 1.5 * (q3 - q1)), 6) as lower_fence, "
            f"round(any_value(q3 + 1.5 * (q3 - q1)), 6) as upper_fence, "
            f"round(min({c}) filter (where {c} >= q1 - 1.5 * (q3 - q1) and {c} <= q3 + 1.5 * (q3 - q1))::double, 6) as whisker_low, "
            f"round(max({c}) filter (where {c} >= q1 - 1.5 * (q3 - q1) and {c} <= q3 + 1.5 * (q3 - q1))::double, 6) as whisker_high, "
            f"round(any_value(q2) - 1.57 * any_value(q3 - q1) / sqrt(count({c})), 6) as notch_low, "
            f"round(any_value(q2) + 1.57 * any_value(q3 - q1) / sqrt(count({c})), 6) as notch_high, "
            f"count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count, "
            f"round(100.0 * count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / "
            f"count({c}), 6) as outlier_pct from {duck(t)} join (select {key}quantile_cont({c}::double, 0.25) as q1, "
            f"quantile_cont({c}::double, 0.5) as q2, quantile_cont({c}::double, 0.75) as q3 from {duck(t)} {group}) "
            f"{on} {group}")


@query("box_stats", _box_sql("events", "value", None))
def _(spark, read):
    return distribution.box_stats(read("events"), "value")


@query("box_stats_by_group", _box_sql("events", "value", "event_type"))
def _(spark, read):
    return distribution.box_stats(read("events"), "value", "event_type")


def _kde_sql(c: str, t: str, points: int, width: str) -> str:
    return (f"select '{c}' as \"column\", i::int as point, round(g, 6) as x, round(sum(exp(-0.5 * pow(({c} - g) / h, 2)))"
            f" / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) as density from {duck(t)}, (select r.i, lo + "
            f"(hi - lo) * r.i / {points - 1} as g, n, h from range({points}) as r(i), (select min({c}) as lo, "
            f"max({c}) as hi, count({c}) as n, {width} as h from {duck(t)})) group by i, g")


SCOTT = "stddev_samp({c}) * pow(count({c}), -0.2)"


@query("kde", _kde_sql("o_totalprice", "orders", 200, SCOTT.format(c="o_totalprice")), digits=9)
def _(spark, read):
    return distribution.kde(read("orders"), ["o_totalprice"]).withColumn("x", F.round("x", 6))


@query("kde_multi", union([_kde_sql(c, "events", 100, SCOTT.format(c=c)) for c in ("value", "user_id")]), digits=9)
def _(spark, read):
    return distribution.kde(read("events"), ["value", "user_id"], points=100).withColumn("x", F.round("x", 6))


def _violin_kde(points: int) -> str:
    return (f"select event_type, i::int as point, round(g, 6) as x, round(sum(exp(-0.5 * pow((value - g) / h, 2))) / "
            f"(any_value(n) * any_value(h) * sqrt(2 * pi())), 9) as density from events join (select event_type, r.i, "
            f"lo + (hi - lo) * r.i / {points - 1} as g, n, h from range({points}) as r(i), (select event_type, "
            f"min(value) as lo, max(value) as hi, count(value) as n, 1.0 as h from events group by 1)) "
            f"using (event_type) group by event_type, i, g")


@query("violin_data", f"select k.*, b.row_count, b.mean, b.q1, b.median, b.q3 from ({_violin_kde(50)}) k join "
       f"({_box_sql('events', 'value', 'event_type')}) b using (event_type)", digits=9)
def _(spark, read):
    made = distribution.violin_data(read("events"), "value", "event_type", points=50, bandwidth=1.0)
    return made.select("event_type", "point", F.round("x", 6).alias("x"), "density", "row_count",
                       *[F.round(c, 6).alias(c) for c in ("mean", "q1", "median", "q3")])


@query("normal_curve", "select i::int as point, round(lo + (hi - lo) * i / 199, 6) as x, round(exp(-0.5 * pow((lo + "
       "(hi - lo) * i / 199 - m) / s, 2)) / (s * sqrt(2 * pi())), 9) as density from range(200) as r(i), (select "
       "min(value) as lo, max(value) as hi, avg(value) as m, stddev_samp(value) as s from events)", digits=9)
def _(spark, read):
    return distribution.normal_curve(read("events"), "value").withColumn("x", F.round("x", 6))


@query("qq_points", union([
    f"select {i} as point, round({0.01 + (0.99 - 0.01) * i / 98!r}::double, 6) as probability, "
    f"round(quantile_cont(value, {0.01 + (0.99 - 0.01) * i / 98!r}), 6) as sample from events" for i in range(99)]))
def _(spark, read):
    return distribution.qq_points(read("events"), "value").drop("theoretical")


@query("correlation_matrix", "select column_1, column_2, round(r, 6) + 0.0 as correlation from (" + corr_sql(
    "lineitem", [(a, b) for a in NUMERIC["lineitem"] for b in NUMERIC["lineitem"]]) + ")")
def _(spark, read):
    return correlation.correlation_matrix(read("lineitem"))


@query("correlation_matrix_missing", "select column_1, column_2, round(r, 6) as correlation from (" + corr_sql(
    "fx_nulls", [(a, b) for a in NUMERIC["fx_nulls"] for b in NUMERIC["fx_nulls"]]) + ")")
def _(spark, read):
    return correlation.correlation_matrix(read("fx_nulls"))


PAIRS = [(a, b) for i, a in enumerate(NUMERIC["fx_coll"]) for b in NUMERIC["fx_coll"][i + 1:]]
STRENGTH = ("case when abs(r) > 0.8 then 'Very Strong' when abs(r) > 0.6 then 'Strong' when abs(r) > 0.4 "
            "then 'Moderate' else 'Weak' end")


@query("correlation_pairs", f"select column_1, column_2, round(r, 6) as correlation, {STRENGTH} as strength "
       f"from ({corr_sql('fx_coll', PAIRS)})")
def _(spark, read):
    return correlation.correlation_pairs(read("fx_coll"))


@query("correlation_pairs_top", f"select column_1, column_2, round(r, 6) as correlation, {STRENGTH} as strength "
       f"from ({corr_sql('fx_coll', PAIRS)}) where r > 0 order by r desc limit 5")
def _(spark, read):
    return correlation.correlation_pairs(read("fx_coll"), top=5, sign="positive")


@query("correlation", "select round(corr(l_quantity, l_extendedprice), 6) as correlation from lineitem")
def _(spark, read):
    return correlation.correlation(read("lineitem"), "l_quantity", "l_extendedprice")


@query("correlation_constant", "select null::double as correlation from events limit 1")
def _(spark, read):
    return correlation.correlation(read("fx_const"), "k_num", "value")


@query("target_correlation", union([
    f"select '{c}' as \"column\", round(abs(corr({c}, q2)), 6) as abs_correlation from {duck('fx_coll')}"
    for c in NUMERIC["fx_coll"] if c != "q2"]))
def _(spark, read):
    return correlation.target_correlation(read("fx_coll"), "q2")


@query("ols_trend", "select round(regr_slope(q2, l_quantity), 6) as slope, round(regr_intercept(q2, l_quantity), 6) as "
       "intercept, round(regr_r2(q2, l_quantity), 6) as r_squared, regr_count(q2, l_quantity)::bigint as row_count "
       f"from {duck('fx_coll')}")
def _(spark, read):
    return correlation.ols_trend(read("fx_coll"), "l_quantity", "q2")


@query("bivariate_numeric", "select round(regr_slope(q2, l_quantity), 6) as slope, round(regr_intercept(q2, "
       "l_quantity), 6) as intercept, round(regr_r2(q2, l_quantity), 6) as r_squared, regr_count(q2, l_quantity)"
       f"::bigint as row_count, round(corr(q2, l_quantity), 6) as correlation from {duck('fx_coll')}")
def _(spark, read):
    return charts.bivariate(read("fx_coll"), "l_quantity", "q2")


@query("bivariate_mixed", _box_sql("customer", "c_acctbal", "c_mktsegment"))
def _(spark, read):
    return charts.bivariate(read("customer"), "c_mktsegment", "c_acctbal")


@query("bivariate_categories", "select o_orderstatus, o_orderpriority, count(*) as row_count from orders group by 1, 2")
def _(spark, read):
    return charts.bivariate(read("orders"), "o_orderstatus", "o_orderpriority")


@query("parallel_coordinates", "select round((l_quantity - a) / (b - a), 6) as l_quantity, round((l_extendedprice - c) / "
       "(d - c), 6) as l_extendedprice, l_returnflag from lineitem, (select min(l_quantity) as a, max(l_quantity) as b, "
       "min(l_extendedprice) as c, max(l_extendedprice) as d from lineitem)")
def _(spark, read):
    return transforms.parallel_coordinates(read("lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"])


def _cells(x: str, y: str, bins: int, extra: str) -> str:
    return (f"select least(floor(({x} - xl) / ((xh - xl) / {bins})), {bins - 1})::int as x_bin, "
            f"least(floor(({y} - yl) / ((yh - yl) / {bins})), {bins - 1})::int as y_bin, {extra} from lineitem, "
            f"(select min({x})::double as xl, max({x})::double as xh, min({y})::double as yl, max({y})::double as yh "
            f"from lineitem) group by 1, 2")


@query("density_2d", _cells("l_quantity", PRICE, 20, "count(*) as row_count"))
def _(spark, read):
    return distribution.density_2d(read("lineitem"), "l_quantity", PRICE)


@query("surface_grid", _cells("l_quantity", PRICE, 20, "round(avg(l_discount), 6) as mean_z, count(l_discount) as row_count"))
def _(spark, read):
    return distribution.surface_grid(read("lineitem"), "l_quantity", PRICE, "l_discount")


@query("heatmap_3d", "select l_quantity, l_linenumber, round(avg(l_extendedprice), 6) as mean_z from lineitem group by 1, 2")
def _(spark, read):
    return distribution.heatmap_3d(read("lineitem"), "l_quantity", "l_linenumber", PRICE)


@query("bar_3d", "select l_quantity, l_linenumber, round(avg(l_extendedprice), 6) as mean_z from lineitem where "
       "l_quantity in (select distinct l_quantity from lineitem order by 1 limit 20) and l_linenumber in (select "
       "distinct l_linenumber from lineitem order by 1 limit 20) group by 1, 2")
def _(spark, read):
    return distribution.bar_3d(read("lineitem"), "l_quantity", "l_linenumber", PRICE)


@query("correlation_pairs_bottom", f"select column_1, column_2, round(r, 6) as correlation, {STRENGTH} as strength "
       f"from ({corr_sql('lineitem', [(a, b) for i, a in enumerate(NUMERIC['lineitem']) for b in NUMERIC['lineitem'][i + 1:]])}) "
       "where r < 0 order by r limit 5")
def _(spark, read):
    return correlation.correlation_pairs(read("lineitem"), top=5, sign="negative")


@query("chart_data_line", "select o_orderdate as x, o_totalprice as y from orders")
def _(spark, read):
    return charts.chart_data(read("orders"), {"type": "line", "x_column": "o_orderdate", "y_column": "o_totalprice"})


@query("chart_data_scatter", "select l_quantity as x, l_extendedprice as y, l_returnflag as category, 8.0::double as "
       "marker_size from lineitem")
def _(spark, read):
    return charts.chart_data(read("lineitem"), {"type": "scatter", "x_column": "l_quantity", "y_column": "l_extendedprice",
                                                "color_column": "l_returnflag"})


def _skew_sql() -> str:
    """Histograms with 30 bins of the four variants; the exponent is that of ``boxcox_sql``."""
    variants = {"original": "o_totalprice", "log": "ln(o_totalprice)", "sqrt": "sqrt(o_totalprice)",
                "boxcox": "(exp(g * ln(o_totalprice)) - 1) / g"}
    parts = []
    for v, e in variants.items():
        source = f"(select {e} as x from orders{', (select g from best5)' if v == 'boxcox' else ''})"
        parts.append(f"select '{v}' as variant, bin, row_count from (select least(floor((x - lo) / ((hi - lo) / 30)), 29)::int "
                     f"as bin, count(*) as row_count from {source}, (select min(x) as lo, max(x) as hi from {source}) group by 1)")
    return boxcox_best_sql("orders", "o_totalprice") + " " + " union all ".join(parts)


@query("skew_transforms", _skew_sql())
def _(spark, read):
    made = transforms.skew_transforms(read("orders"), "o_totalprice")
    return reduce(DataFrame.unionByName, [
        distribution.histogram(d, "o_totalprice", 30).filter("row_count > 0").select(F.lit(v).alias("variant"), "bin", "row_count")
        for v, d in made.items()])


# Standard normal distribution as its power series, enough terms for |z| < 7.
PHI = ("0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: sign(z) * "
       "exp((2 * k + 1) * ln(abs(z) + 1e-300) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))")


# Kolmogorov's series for the chance of a larger distance, for many rows
KS_CHANCE = ("2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * "
             "exp(-2.0 * k * k * n * d * d)))")


@query("ks_normal_test", "select \"column\", round(d, 6) as statistic, round(p, 6) as p_value, p > 0.05 as normal from (select *, "
       f"least(1, greatest(0, {KS_CHANCE})) as p from (select 'o_totalprice' as \"column\", any_value(n) as n, max(greatest(i / n - p, "
       f"p - (i - 1) / n)) as d from (select i, n, {PHI} as p from (select row_number() over (order by o_totalprice) as i, "
       "count(*) over () as n, (o_totalprice - m) / s as z from orders, (select avg(o_totalprice) as m, "
       "stddev_samp(o_totalprice) as s from orders)))))")
def _(spark, read):
    return hypothesis.ks_normal_test(read("orders"), "o_totalprice")


def _shapiro_sql() -> str:
    """The statistic from weights by position, for groups of more than five values."""
    m = quantile_sql("p", lambda x: f"{x!r}::double")
    poly = lambda c: " + ".join(f"({x!r}::double) * pow(u, {k})" for k, x in enumerate(c))
    return (f"with o as (select user_id::varchar as g, value - avg(value) over w as c, row_number() over (partition by user_id "
            "order by value) as i, count(*) over w as n from events where value is not null window w as (partition by user_id)), "
            f"q as (select *, (i - 0.375::double) / (n + 0.25::double) as p from o), m as (select *, {m} as m from q), "
            "s as (select g, any_value(n) as n, 1 / sqrt(any_value(n)) as u, sum(m * m) as t, sum(c * c) as ss, sum(m * c) filter "
            "(where i > 2 and i <= n - 2) as d, max(c) filter (where i = n) - max(c) filter (where i = 1) as o1, max(c) filter "
            "(where i = n - 1) - max(c) filter (where i = 2) as o2, max(m) filter (where i = n) as m1, max(m) filter (where "
            f"i = n - 1) as m2 from m group by g), a as (select *, m1 / sqrt(t) + {poly(hypothesis.WEIGHT_LAST)} as a1, "
            f"m2 / sqrt(t) + {poly(hypothesis.WEIGHT_NEXT)} as a2 from s) select g as \"group\", n as row_count, round(least(1, "
            "pow(a1 * o1 + a2 * o2 + d / sqrt((t - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss), 6) "
            "as statistic from a where n > 5 and ss > 0")


@query("shapiro_statistic", _shapiro_sql())
def _(spark, read):
    """Groups of more than five values; p-values need the error function, which SQL has not."""
    found = hypothesis.shapiro_test(read("events"), "value", "user_id")
    return found.filter("row_count > 5 and statistic is not null").select("group", "row_count", "statistic")


@query("shapiro_test")
def _(spark, read):
    return hypothesis.shapiro_test(read("events").withColumn("series", F.col("user_id").cast("string")), "value", "series")
