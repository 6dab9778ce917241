"""Scans, selection, overview, typing and description."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import filters, overview, typing
from sightline.plans import profile
from sightline.sources import export, load
from sightline_queries.registry import (NUMERIC, TEXT, columns, describe_sql, duck, dup_sql, query,
                                        top_value_sql, union)

ORDERS = columns("orders")


@query("load_table", "select * exclude (o_orderdate), cast(o_orderdate as date) as o_orderdate from orders")
def _(spark, read):
    return read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("preview_head", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem "
       "order by l_orderkey, l_linenumber, l_partkey, l_quantity limit 10")
def _(spark, read):
    return filters.preview(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 10)


@query("preview_tail", "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 10")
def _(spark, read):
    return filters.preview(read("orders").select("o_orderkey", "o_totalprice"), 10, "tail", ["o_orderkey"])


@query("sample_rows")
def _(spark, read):
    return filters.sample_rows(read("lineitem"), 5000)


@query("limit_columns", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
       "l_discount, l_tax, round(l_quantity * 2, 6) as d0, round(l_quantity * 3, 6) as d1, "
       "round(l_quantity * 4, 6) as d2, round(l_quantity * 5, 6) as d3, round(l_quantity * 6, 6) as d4, "
       "round(l_quantity * 7, 6) as d5, round(l_quantity * 8, 6) as d6, l_returnflag, l_linestatus from lineitem")
def _(spark, read):
    wide = read("lineitem").select("*", *[(F.col("l_quantity") * (i + 2)).alias(f"d{i}") for i in range(12)])
    return filters.limit_columns(wide)


@query("drop_columns", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(spark, read):
    return filters.drop_columns(read("orders"), ["o_totalprice", "o_orderdate", "o_orderpriority"])


@query("rename_column", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment as segment from customer")
def _(spark, read):
    return filters.rename_column(read("customer"), "c_mktsegment", "segment")


@query("filter_isin", f"select l_orderkey, l_linenumber, rf from {duck('fx_nulls')} where rf in ('A', 'R')")
def _(spark, read):
    return filters.filter_isin(read("fx_nulls").select("l_orderkey", "l_linenumber", "rf"), "rf", ["A", "R"])


@query("filter_isin_with_null", f"select l_orderkey, l_linenumber, rf from {duck('fx_nulls')} "
       "where rf = 'A' or rf is null")
def _(spark, read):
    return filters.filter_isin(read("fx_nulls").select("l_orderkey", "l_linenumber", "rf"), "rf", ["A", None])


@query("filter_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20")
def _(spark, read):
    return filters.filter_range(read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
                                "l_quantity", 10, 20)


@query("apply_filters", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem "
       "where l_quantity between 10 and 20 and l_returnflag in ('A')")
def _(spark, read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return filters.apply_filters(rows, {"l_quantity": (10, 20), "l_returnflag": ["A"]})


@query("filter_report", "select count(*) as rows_before, count(*) filter (where l_quantity between 10 and 20 and "
       "l_returnflag = 'A') as rows_after, 11 as column_count from lineitem")
def _(spark, read):
    return filters.filter_report(read("lineitem"), {"l_quantity": (10, 20), "l_returnflag": ["A"]})


@query("filter_domain_range", "select s_suppkey, round(s_acctbal / 50, 6) as lat, round(s_acctbal / 30, 6) as lon "
       "from supplier where s_acctbal / 50 between -90 and 90 and s_acctbal / 30 between -180 and 180")
def _(spark, read):
    places = read("supplier").select("s_suppkey", (F.col("s_acctbal") / 50).alias("lat"),
                                     (F.col("s_acctbal") / 30).alias("lon"))
    return filters.filter_domain_range(places, "lat", "lon")


@query("overview", f"select count(*) as row_count, 3 as column_count, 0::bigint as missing_cells, "
       f"0.0::double as missing_pct, {dup_sql('fx_dups', columns('fx_dups'))} as duplicate_rows from {duck('fx_dups')}")
def _(spark, read):
    return overview.overview(read("fx_dups"))


@query("overview_missing", "select count(*) as row_count, 5 as column_count, "
       "(3 * count(*) - count(q) - count(p) - count(rf))::bigint as missing_cells, "
       "round(100.0 * (3 * count(*) - count(q) - count(p) - count(rf)) / (5 * count(*)), 6) as missing_pct, "
       f"{dup_sql('fx_nulls', columns('fx_nulls'))} as duplicate_rows from {duck('fx_nulls')}")
def _(spark, read):
    return overview.overview(read("fx_nulls"))


WIDTHS = {"o_orderkey": 8, "o_custkey": 8, "o_totalprice": 8, "o_orderdate": 8}


@query("memory_usage", union([f"select '{c}' as \"column\", " + (
    f"(count({c}) * {WIDTHS[c]})::bigint" if c in WIDTHS else f"sum(strlen({c}))::bigint") + " as bytes from orders"
    for c in ORDERS]))
def _(spark, read):
    return overview.memory_usage(read("orders"))


KINDS = {"o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"),
         "o_orderstatus": ("string", "categorical"), "o_totalprice": ("double", "numeric"),
         "o_orderdate": ("timestamp_ntz", "datetime"), "o_orderpriority": ("string", "categorical")}


@query("basic_info", union([
    f"select {i} as position, '{c}' as \"column\", '{KINDS[c][0]}' as dtype, '{KINDS[c][1]}' as kind, "
    f"count(*) - count({c}) as missing_count, count(*) as row_count, {dup_sql('orders', ORDERS)} as duplicate_rows "
    f"from orders" for i, c in enumerate(ORDERS)]))
def _(spark, read):
    return overview.basic_info(read("orders"))


TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "q": "double", "p": "double", "rf": "string"}


@query("column_types", union([
    f"select '{c}' as \"column\", '{t}' as dtype, count({c}) as non_null_count, "
    f"count(*) - count({c}) as null_count from {duck('fx_nulls')}" for c, t in TYPES.items()]))
def _(spark, read):
    return overview.column_types(read("fx_nulls"), samples=0)


@query("column_samples", union([
    f"select '{c}' as \"column\", (select string_agg(cast(v as varchar), ', ' order by v) from (select distinct {c} as v "
    f"from part order by v limit 3)) as sample_values" for c in columns("part")]))
def _(spark, read):
    return overview.sample_values(read("part"), 3)


@query("dtype_distribution", "select * from (values ('bigint', 3), ('int', 1), ('double', 4), ('string', 2), "
       "('timestamp_ntz', 1)) as t(dtype, column_count)")
def _(spark, read):
    return overview.dtype_distribution(read("lineitem"))


@query("missing_summary", union([
    f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 2) as missing_pct from {duck('fx_nulls')}"
    for c in ("q", "p", "rf")]))
def _(spark, read):
    return overview.missing_summary(read("fx_nulls"))


def _null_flags() -> str:
    return (f"(select case when q is null then 1.0 else 0.0 end as q, case when p is null then 1.0 else 0.0 end as p, "
            f"case when rf is null then 1.0 else 0.0 end as rf from {duck('fx_nulls')})")


@query("nullity_correlation", union([
    f"select '{a}' as column_1, '{b}' as column_2, round(corr({a}, {b}), 6) as correlation from {_null_flags()}"
    for a, b in (("q", "p"), ("q", "rf"), ("p", "rf"))]))
def _(spark, read):
    return overview.nullity_correlation(read("fx_nulls"))


@query("nullity_patterns", "select concat('00', case when q is null then '1' else '0' end, case when p is null then "
       "'1' else '0' end, case when rf is null then '1' else '0' end) as pattern, count(*) as row_count "
       f"from {duck('fx_nulls')} group by 1")
def _(spark, read):
    return overview.nullity_patterns(read("fx_nulls"))


@query("missing_pattern_by_row", "select (q is null)::int + (p is null)::int + (rf is null)::int as missing_cells, "
       f"count(*) as row_count from {duck('fx_nulls')} group by 1")
def _(spark, read):
    return overview.missing_pattern_by_row(read("fx_nulls"))


@query("describe_numeric", describe_sql("lineitem", NUMERIC["lineitem"]))
def _(spark, read):
    return overview.describe_numeric(read("lineitem"))


@query("describe_numeric_missing", describe_sql("fx_nulls", NUMERIC["fx_nulls"]))
def _(spark, read):
    return overview.describe_numeric(read("fx_nulls"))


def _label(value: str, flat: str, high: str, low: str) -> str:
    return f"case when abs({value}) < 0.5 then '{flat}' when {value} > 0.5 then '{high}' else '{low}' end"


@query("describe_extended", union([
    f"select d.*, (select v from (select cast({c} as double) as v, count(*) as k from events where {c} is not null "
    f"group by 1) order by k desc, v limit 1) as mode, round(s, 6) as skewness, round(k, 6) as kurtosis, "
    f"round(max - min, 6) as value_range, round(q75 - q25, 6) as iqr, "
    f"{_label('s', 'Approximately symmetric', 'Right-skewed', 'Left-skewed')} as skew_label, "
    f"{_label('k', 'Normal kurtosis', 'Heavy-tailed', 'Light-tailed')} as kurtosis_label "
    f"from ({describe_sql('events', [c])}) d, (select skewness({c}) as s, kurtosis({c}) as k from events)"
    for c in NUMERIC["events"]]))
def _(spark, read):
    return overview.describe_extended(read("events"))


@query("describe_categorical", union([top_value_sql("part", c) for c in TEXT["part"]]))
def _(spark, read):
    return overview.describe_categorical(read("part"))


def _describe_all_sql(t: str) -> str:
    empty = "null::bigint as \"unique\", null::varchar as top, null::bigint as freq"
    numbers = f"select *, {empty} from ({describe_sql(t, NUMERIC[t])})"
    texts = union([f"select \"column\", count, null::double, null::double, null::double, null::double, null::double, "
                   f"null::double, null::double, unique_values, most_frequent, frequency from "
                   f"({top_value_sql(t, c)})" for c in TEXT[t]])
    return union([numbers, texts])


@query("describe_all", _describe_all_sql("part"))
def _(spark, read):
    return overview.describe_all(read("part"))


@query("export_statistics", _describe_all_sql("customer"))
def _(spark, read):
    return export.export_statistics(read("customer"))


@query("column_quality_table", union([
    f"select \"column\", '{t}' as dtype, round(100.0 * (n - count) / n, 6) as missing_pct, unique_values, "
    f"cast(most_frequent as varchar) as most_frequent from ({top_value_sql('fx_nulls', c)}), "
    f"(select count(*) as n from lineitem)" for c, t in TYPES.items()]))
def _(spark, read):
    return overview.column_quality_table(read("fx_nulls"))


@query("summarize", union(
    [f"select 'basic_info' as section, 'table' as item, '{m}' as measure, cast({e} as double) as value from part"
     for m, e in (("row_count", "count(*)"), ("column_count", "max(6)"), ("missing_cells", "max(0)"),
                  ("duplicate_rows", f"any_value({dup_sql('part', columns('part'))})"))]
    + [f"select 'numeric_summary', \"column\", '{m}', cast({m} as double) from ({describe_sql('part', [c])})"
       for c in NUMERIC["part"] for m in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
    + [f"select 'categorical_summary', \"column\", '{m}', cast({m} as double) from ({top_value_sql('part', c)})"
       for c in TEXT["part"] for m in ("unique_values", "frequency")]))
def _(spark, read):
    return overview.summary_table(read("part"))


@query("data_overview", union([
    f"select *, null::bigint as unique_values, null::varchar as most_frequent, null::bigint as frequency "
    f"from ({describe_sql('part', NUMERIC['part'])})"]
    + [f"select \"column\", count, null::double, null::double, null::double, null::double, null::double, null::double, "
       f"null::double, unique_values, most_frequent, frequency from ({top_value_sql('part', c)})" for c in TEXT["part"]]))
def _(spark, read):
    parts = overview.data_overview(read("part"))
    return parts["numeric"].unionByName(parts["categorical"], allowMissingColumns=True)


def _profile_sql() -> str:
    """Column information, type suggestions and quality scores of part, which has neither nulls nor text that converts."""
    n, dup = "(select count(*) from part)", dup_sql("part", columns("part"))
    types = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"}
    rows = []
    for i, (c, t) in enumerate(types.items()):
        few = f"(select count(distinct {c}) < 0.1 * count(*) from part)" if t == "string" else "false"
        share = f"(select count(distinct {c}) / count(*) from part)"
        rows.append(
            f"select '{c}' as \"column\", {i} as position, '{t}' as dtype, '{'categorical' if t == 'string' else 'numeric'}' as "
            f"kind, 0::bigint as missing_count, {n} as row_count, {dup} as duplicate_rows, '{t}' as current_type, case when {few} "
            f"then 'category' else '{t}' end as suggested_type, case when {few} then round({share}, 6) end as ratio, case when "
            f"{few} then concat('Only ', printf('%.1f%%', 100.0 * {share}), ' unique values - good candidate for categorical') "
            f"else 'No change needed' end as reason, 100.0::double as completeness, round(100.0 * ({n} - {dup}) / {n}, 6) as "
            f"uniqueness, 100.0::double as consistency, 100.0::double as validity, round(70 + 30.0 * ({n} - {dup}) / {n}, 6) as overall")
    return union(rows)


@query("profile", _profile_sql())
def _(spark, read):
    parts = profile.profile(read("part"))
    return parts["basic_info"].join(parts["type_suggestions"], "column").join(F.broadcast(parts["quality_scores"]))


@query("dataset_context")
def _(spark, read):
    return profile.dataset_context(read("customer"))


def _parsed(frame, schema: str, part: str):
    """One list of a JSON document as rows."""
    return frame.select(F.from_json("document", schema).alias("d")).select(F.expr(f"inline(d.{part})"))


STATISTICS = "array<struct<column: string, count: bigint, mean: double, std: double, min: double, q25: double, q50: double, " \
             "q75: double, max: double>>"


@query("dataset_context_statistics", describe_sql("customer", NUMERIC["customer"]))
def _(spark, read):
    """The statistics inside the document."""
    return _parsed(profile.dataset_context(read("customer")), f"summary_stats {STATISTICS}", "summary_stats")


@query("dataset_context_sample", "select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as "
       "c_nationkey, cast(c_acctbal as varchar) as c_acctbal, c_mktsegment from customer order by customer.c_custkey limit 3")
def _(spark, read):
    fields = ", ".join(f"{c}: string" for c in columns("customer"))
    return _parsed(profile.dataset_context(read("customer")), f"sample_data array<struct<{fields}>>", "sample_data")


@query("export_summary_numeric", describe_sql("part", NUMERIC["part"]))
def _(spark, read):
    """The numeric summary inside the document."""
    return _parsed(export.export_summary(read("part")), f"numeric {STATISTICS}", "numeric")


@query("export_summary_categorical", union([top_value_sql("part", c) for c in TEXT["part"]]))
def _(spark, read):
    return _parsed(export.export_summary(read("part")), "categorical array<struct<column: string, count: bigint, unique_values: "
                   "bigint, most_frequent: string, frequency: bigint>>", "categorical")


@query("sample_rows_properties", "select least(5000, count(*)) as row_count, 0::bigint as foreign_rows from lineitem")
def _(spark, read):
    """The sample has the asked number of rows, all of them rows of the table."""
    rows = read("lineitem")
    sample = filters.sample_rows(rows, 5000)
    foreign = sample.join(rows.distinct(), rows.columns, "left_anti").agg(F.count("*").alias("foreign_rows"))
    return sample.agg(F.count("*").alias("row_count")).join(F.broadcast(foreign))  # one row each


@query("export_summary")
def _(spark, read):
    return export.export_summary(read("part"))


NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _rates(c: str) -> str:
    return (f"(select count(*) as n, count(*) filter (where regexp_matches({c}, {NUMBER})) as num, "
            f"count(try_cast({c} as timestamp)) as dat, count(distinct {c}) as uni from {duck('fx_types')})")


def _percent(e: str) -> str:
    return f"printf('%.1f%%', 100.0 * {e})"


@query("suggest_types", union(
    ["select 'event_id' as \"column\", 'bigint' as current_type, 'bigint' as suggested_type, null::double as ratio, "
     "'No change needed' as reason"]
    + [f"select '{c}', 'string', case when num > 0.8 * n then 'numeric' when dat > 0.8 * n then 'datetime' "
       f"when uni < 0.1 * n then 'category' else 'string' end, round(case when num > 0.8 * n then num / n "
       f"when dat > 0.8 * n then dat / n when uni < 0.1 * n then uni / n end, 6), "
       f"case when num > 0.8 * n then concat({_percent('num / n')}, ' values can be converted to numeric') "
       f"when dat > 0.8 * n then concat({_percent('dat / n')}, ' values can be converted to datetime') "
       f"when uni < 0.1 * n then concat('Only ', {_percent('uni / n')}, "
       f"' unique values - good candidate for categorical') else 'No change needed' end from {_rates(c)}"
       for c in TEXT["fx_types"]]))
def _(spark, read):
    return typing.suggest_types(read("fx_types"))


@query("type_conversion_suggestions", "select \"column\", current_type, suggested_type, convertible, reason from (" + union(
    [f"select '{c}' as \"column\", 'string' as current_type, 'numeric' as suggested_type, num as convertible, "
     f"concat('Can convert ', num, ' values to numeric') as reason, num > 0 as ok from {_rates(c)}"
     for c in TEXT["fx_types"]]
    + [f"select '{c}', 'string', 'datetime', dat, concat('Can convert ', dat, ' values to datetime'), dat > 0.5 * n "
       f"from {_rates(c)}" for c in ("date_txt", "event_type")]) + ") where ok")
def _(spark, read):
    return typing.type_conversion_suggestions(read("fx_types"))


@query("numeric_columns", "select 'event_id' as \"column\", 'numeric' as kind, 1.0::double as fraction union all "
       f"select 'num_txt', 'numeric-like', round(num / n, 6) from {_rates('num_txt')} where num / n >= 0.8")
def _(spark, read):
    return typing.numeric_columns(read("fx_types"))


@query("detect_date_columns", f"select 'day_txt' as \"column\", count(day_txt) as value_count from {duck('fx_dates')} "
       "having count(day_txt) = count(try_cast(day_txt as timestamp))")
def _(spark, read):
    return typing.detect_date_columns(read("fx_dates"))


@query("detect_geo_columns", f"select 'lat_lon' as \"column\", true as latitude, true as longitude, "
       f"count(lat_lon) as value_count from {duck('fx_geo')}")
def _(spark, read):
    return typing.detect_geo_columns(read("fx_geo"))


@query("load_csv", f"select * from {duck('fx_types')}")
def _(spark, read):
    """The table written as CSV to a fresh folder under the checkpoint folder and read back with inference."""
    import uuid
    from sightline.session import scratch_folder
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    export.write_csv(read("fx_types").withColumn("num_txt", F.concat(F.lit("u"), "num_txt")), path)
    back = load.load_csv(spark, path)
    return back.withColumn("num_txt", F.substring("num_txt", 2, 20))


@query("load_csv_text", "select * from documents")
def _(spark, read):
    """Whole documents, newlines included, written as CSV and read back."""
    import uuid
    from sightline.session import scratch_folder
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    export.write_csv(read("documents"), path)
    return load.load_csv(spark, path)
