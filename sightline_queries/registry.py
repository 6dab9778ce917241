"""Registration, table access, the planted-problem views, and rounding shared by all queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.sources.load import load_table
from sightline.types import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Views with planted problems; {string} and {double} are the type names of the engine.
VIEWS = {
    "fx_nulls": "select l_orderkey, l_linenumber, case when l_orderkey % 10 = 0 then null else l_quantity end as q, "
                "case when l_orderkey % 3 > 0 then null else l_extendedprice end as p, "
                "case when l_suppkey % 20 = 0 then null else l_returnflag end as rf from lineitem",
    "fx_dups": "select o_orderkey, o_orderstatus, o_orderpriority from orders union all "
               "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 50 = 0",
    "fx_cats": "select o_orderkey, case when o_orderkey % 7 = 0 then lower(o_orderpriority) "
               "when o_orderkey % 11 = 0 then concat(' ', o_orderpriority, ' ') else o_orderpriority end as pr "
               "from orders",
    "fx_types": "select event_id, case when event_id % 10 = 0 then 'n/a' else cast(user_id as {string}) end as num_txt, "
                "case when event_id % 8 = 0 then 'bad' else concat('2024-01-', "
                "lpad(cast(1 + event_id % 28 as {string}), 2, '0')) end as date_txt, event_type from events",
    "fx_dates": "select event_id, concat('2024-', lpad(cast(1 + event_id % 12 as {string}), 2, '0'), '-', "
                "lpad(cast(1 + event_id % 28 as {string}), 2, '0')) as day_txt, event_type, value from events",
    "fx_const": "select event_id, cast(5.0 as {double}) as k_num, 'A' as k_txt, value from events",
    "fx_geo": "select s_suppkey, concat(cast(s_suppkey % 181 - 90 as {string}), '.5 N, ', "
              "cast(s_suppkey % 361 - 180 as {string}), '.25 E') as lat_lon from supplier",
    "fx_rates": "select l_orderkey, l_linenumber, l_discount * 1200 as discount_rate, "
                "cast(l_quantity * 4 - 10 as {double}) as age_days, l_extendedprice - 5000 as net_price from lineitem",
    "fx_coll": "select l_orderkey, l_linenumber, l_quantity, l_quantity * 2 + l_linenumber * cast(0.1 as {double}) "
               "as q2, l_extendedprice from lineitem",
}
SOURCES = {"fx_nulls": "lineitem", "fx_dups": "orders", "fx_cats": "orders", "fx_types": "events",
           "fx_dates": "events", "fx_const": "events", "fx_geo": "supplier", "fx_rates": "lineitem",
           "fx_coll": "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table (none holds NaN), or a view derived from one."""
    if name not in VIEWS:
        return load_table(spark, f"{sf_dir}/{name}.parquet", has_nan=False)
    source = SOURCES[name]
    load_table(spark, f"{sf_dir}/{source}.parquet", has_nan=False).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name].format(string="string", double="double"))


def duck(name: str) -> str:
    """The SQL of a table or view as a DuckDB subquery."""
    return f"({VIEWS[name].format(string='varchar', double='double')})" if name in VIEWS else name


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractional columns rounded, so that both engines show the same value."""
    return df.select(*[(F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a query (spark, read) -> DataFrame under ``name``; ``read`` gives tables by name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, lambda t: table(spark, sf_dir, t)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


# Columns by kind in the given tables, for building SQL that lists one row per column.
NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "events": ["event_id", "user_id", "value"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "pages": ["page_id"],
    "fx_nulls": ["l_orderkey", "l_linenumber", "q", "p"],
    "fx_coll": ["l_orderkey", "l_linenumber", "l_quantity", "q2", "l_extendedprice"],
    "fx_rates": ["l_orderkey", "l_linenumber", "discount_rate", "age_days", "net_price"],
    "fx_const": ["event_id", "k_num", "value"],
    "fx_dups": ["o_orderkey"], "fx_cats": ["o_orderkey"], "fx_types": ["event_id"],
}
TEXT = {
    "lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"], "events": ["event_type", "props"],
    "customer": ["c_name", "c_mktsegment"], "pages": ["url", "html"], "fx_nulls": ["rf"], "fx_coll": [],
    "fx_rates": [], "fx_const": ["k_txt"], "fx_dups": ["o_orderstatus", "o_orderpriority"], "fx_cats": ["pr"],
    "fx_types": ["num_txt", "date_txt", "event_type"],
}
TIME = {"lineitem": ["l_shipdate"], "orders": ["o_orderdate"], "events": ["ts"]}


def columns(name: str) -> list[str]:
    return {"lineitem": NUMERIC["lineitem"] + TEXT["lineitem"] + TIME["lineitem"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
            "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
            "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
            "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]}.get(
        name, NUMERIC.get(name, []) + TEXT.get(name, []))


def boxcox_best_sql(t: str, c: str) -> str:
    """CTEs best1 to best5: the exponent g of the smallest variance on values over their geometric mean, first among -5 to
    5 in steps of a half, then four times among a tenth of the step around it (an inner optimum is assumed)."""
    parts, step = [f"v as (select ln({c}) - (select avg(ln({c})) from {t}) as y from {t})"], 0.5
    for k in range(1, 6):
        low = "-5.0::double" if k == 1 else f"(select g from best{k - 1}) - {step * 10!r}::double"
        parts.append(f"grid{k} as (select {low} + {step!r}::double * i as g from range(21) r(i))")
        parts.append(f"best{k} as (select arg_min(g, s) as g from (select g, var_pop(case when abs(g) < 1e-9 then y else "
                     f"(exp(g * y) - 1) / g end) as s from v, grid{k} group by g))")
        step /= 10
    return "with " + ", ".join(parts)


def describe_sql(t: str, cols: list[str]) -> str:
    return union([f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 6) as mean, "
                  f"round(stddev_samp({c}), 6) as std, round(cast(min({c}) as double), 6) as min, "
                  f"round(quantile_cont(cast({c} as double), 0.25), 6) as q25, "
                  f"round(quantile_cont(cast({c} as double), 0.5), 6) as q50, "
                  f"round(quantile_cont(cast({c} as double), 0.75), 6) as q75, "
                  f"round(cast(max({c}) as double), 6) as max from {duck(t)}" for c in cols])


def top_value_sql(t: str, c: str) -> str:
    """Per column: non-null rows, distinct values, most frequent value (ties to the smallest) and its count."""
    return (f"select '{c}' as \"column\", cast(sum(k) as bigint) as count, count(*) as unique_values, "
            f"arg_min(v, r) as most_frequent, max(k) as frequency from (select v, k, row_number() over "
            f"(order by k desc, v) as r from (select {c} as v, count(*) as k from {duck(t)} where {c} is not null "
            f"group by 1))")


def fences_sql(t: str, c: str) -> str:
    return (f"(select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (select "
            f"quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 "
            f"from {duck(t)}))")


def outlier_sql(t: str, cols: list[str]) -> str:
    rows = union([f"select '{c}' as \"column\", count(*) filter (where {c} < lo or {c} > hi) as outlier_count, "
                  f"round(100.0 * count(*) filter (where {c} < lo or {c} > hi) / count({c}), 6) as outlier_pct, "
                  f"round(any_value(lo), 6) as lower_bound, round(any_value(hi), 6) as upper_bound "
                  f"from {duck(t)}, {fences_sql(t, c)}" for c in cols])
    return f"select * from ({rows}) where outlier_count > 0"


def dup_sql(t: str, cols: list[str]) -> str:
    return (f"(select coalesce(sum(k - 1), 0)::bigint from (select count(*) as k from {duck(t)} "
            f"group by {', '.join(cols)}))")


def corr_sql(t: str, pairs: list[tuple[str, str]]) -> str:
    return union([f"select '{a}' as column_1, '{b}' as column_2, case when isnan(corr({a}, {b})) then null "
                  f"else corr({a}, {b}) end as r from {duck(t)}" for a, b in pairs])
