"""Value transforms of single columns; parameters come from one aggregate and enter as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.parsing import embedded_number, json_or_error, strip, title_case
from sightline.operators.filters import filter_domain_range
from sightline.operators.typing import geo_column_names
from sightline.types import col, is_numeric, num, require, sql_lit, sql_num

BOXCOX_START, BOXCOX_STEPS, BOXCOX_ROUNDS = 5.0, 20, 5  # first bracket -5 to 5, points per scan, refinements


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.withColumns(changed) if changed else df


def standardize(df: DataFrame, names: list[str], ddof: int = 0) -> DataFrame:
    """(x - mean) / standard deviation; a constant column becomes zero with ddof 0, null with ddof 1."""
    require(df, *names)
    spread = "stddev_pop" if ddof == 0 else "stddev_samp"
    row = df.agg(*[F.expr(e).alias(f"{k}{i}") for i, x in enumerate(map(sql_num, names)) for k, e in (
        ("m", f"if(min({x}) = max({x}), min({x}), avg({x}))"),
        ("s", f"if(min({x}) = max({x}), 0D, {spread}({x}))"))]).first()
    changed = {}
    for i, c in enumerate(names):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None or (not s and ddof):
            changed[c] = F.lit(None).cast("double")
        else:
            changed[c] = (num(c) - F.lit(m)) / F.lit(s if s else 1.0)
    return _replace(df, changed)


def normalize_minmax(df: DataFrame, *names: str) -> DataFrame:
    """(x - min) / (max - min); null for a constant column."""
    require(df, *names)
    limits = _limits(df, names)
    return _replace(df, {c: (F.try_divide(num(c) - F.lit(lo), F.lit(hi - lo)) if lo is not None
                             else F.lit(None).cast("double")) for c, (lo, hi) in limits.items()})


def parallel_coordinates(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns scaled to [0, 1]; constant and text columns stay as they are."""
    require(df, *names)
    limits = _limits(df, [c for c in names if is_numeric(df.schema[c].dataType)])
    return df.select(*[((num(c) - F.lit(limits[c][0])) / F.lit(limits[c][1] - limits[c][0])).alias(c)
                       if c in limits and limits[c][0] is not None and limits[c][1] > limits[c][0] else col(c)
                       for c in names])


def _limits(df: DataFrame, names) -> dict[str, tuple[float, float]]:
    if not names:
        return {}
    row = df.agg(*[f(num(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]
                 ).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(names)}


def log_transform(df: DataFrame, name: str) -> DataFrame:
    """Natural logarithm; the minimum must be positive."""
    require(df, name)
    low = _limits(df, [name])[name][0]
    if low is not None and low <= 0:
        raise ValueError(f"log needs positive values; the minimum of {name!r} is {low}")
    return df.withColumn(name, F.ln(num(name)))


def sqrt_transform(df: DataFrame, name: str) -> DataFrame:
    """Square root; the minimum must not be negative."""
    require(df, name)
    low = _limits(df, [name])[name][0]
    if low is not None and low < 0:
        raise ValueError(f"sqrt needs values from 0 up; the minimum of {name!r} is {low}")
    return df.withColumn(name, F.sqrt(num(name)))


def square_transform(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.withColumn(name, num(name) * num(name))


def boxcox_value(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-9 else (F.exp(F.lit(lam) * F.ln(x)) - 1.0) / F.lit(lam)


def _boxcox_sql(name: str, lam: float, log_mean: float) -> str:
    """Variance of the transform of values divided by their geometric mean, whose logarithms sum to zero."""
    y, g = f"(ln({sql_num(name)}) - {sql_lit(log_mean)})", sql_lit(lam)
    return f"var_pop({y})" if abs(lam) < 1e-9 else f"var_pop((exp({g} * {y}) - 1D) / {g})"


def boxcox_lambda(df: DataFrame, name: str) -> float | None:
    """The exponent of highest likelihood: a grid of likelihoods per scan, refined around its best point.

    The bracket is open: while the best point is an end of it, the bracket moves on and doubles.
    """
    require(df, name)
    x = num(name)
    low, high, n, log_mean = df.agg(F.min(x), F.max(x), F.count(x), F.avg(F.ln(F.when(x > 0, x)))).first()
    if not n or low == high:
        return None
    if low <= 0:
        raise ValueError(f"Box-Cox needs positive values; the minimum of {name!r} is {low}")
    lo, hi, refined, best = -BOXCOX_START, BOXCOX_START, 0, None
    while refined < BOXCOX_ROUNDS:
        step = (hi - lo) / BOXCOX_STEPS
        grid = [lo + step * i for i in range(BOXCOX_STEPS + 1)]
        row = df.agg(*[F.expr(_boxcox_sql(name, g, log_mean)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        spread = {g: row[f"v{i}"] for i, g in enumerate(grid)}
        spread = {g: v for g, v in spread.items() if v is not None and 0 < v < float("inf")}
        if not spread:
            return best
        best = min(spread, key=spread.get)
        if not refined and best in (grid[0], grid[-1]):  # overflow ends this, long before any sensible exponent
            lo, hi = (best - 2 * (hi - lo), best + step) if best == grid[0] else (best - step, best + 2 * (hi - lo))
            continue
        refined += 1
        lo, hi = best - step, best + step
    return best


def boxcox(df: DataFrame, name: str) -> DataFrame:
    lam = boxcox_lambda(df, name)
    return df if lam is None else df.withColumn(name, boxcox_value(num(name), lam))


def skew_transforms(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """The column as it is and made more symmetric: logarithm, square root, Box-Cox; those its values do not allow are
    left out (logarithm and Box-Cox need positive values, the root none below zero)."""
    require(df, name)
    rows = df.select(col(name))
    low = _limits(rows, [name])[name][0]
    made = {"original": rows}
    if low is not None and low > 0:
        made["log"] = log_transform(rows, name)
    if low is not None and low >= 0:
        made["sqrt"] = sqrt_transform(rows, name)
    if low is not None and low > 0:
        made["boxcox"] = boxcox(rows, name)
    return made


def lowercase(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lower(col(name)))


def uppercase(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.upper(col(name)))


def titlecase(df: DataFrame, name: str) -> DataFrame:
    """A capital after every non-letter."""
    return df.withColumn(name, title_case(col(name)))


def strip_text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, strip(col(name)))


def extract_number(df: DataFrame, name: str, pick: str = "first") -> DataFrame:
    """The first or last number inside each text."""
    require(df, name)
    if is_numeric(df.schema[name].dataType):
        return df.withColumn(name, num(name))
    return df.withColumn(name, embedded_number(col(name), pick))


def geo_points(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Rows with usable coordinates: latitude from the first, longitude from the last number of the text."""
    names = geo_column_names(df)
    lat = lat or next((c for c in names if "lat" in c.lower()), None)
    lon = lon or next((c for c in names if "lon" in c.lower()), None)
    if lat is None or lon is None:
        raise ValueError("no latitude or longitude column found")

    def coordinate(name, pick):
        return num(name) if is_numeric(df.schema[name].dataType) else embedded_number(col(name), pick)

    placed = df.withColumns({"latitude": coordinate(lat, "first"), "longitude": coordinate(lon, "last")})
    return filter_domain_range(placed, "latitude", "longitude")


def extract_json(df: DataFrame, name: str, out: str = "json") -> DataFrame:
    """JSON text of the column: as it is, else its outermost braces, else an error record."""
    require(df, name)
    return df.withColumn(out, json_or_error(col(name)))
