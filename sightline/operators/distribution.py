"""Tables behind distribution charts: histograms, boxes, densities, grids."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.quantiles import exact_quantiles, grouped_quantiles
from sightline.functions.tablestats import number_stats
from sightline.session import cut_lineage, small_side
from sightline.types import col, num, require, small_frame


def _range(df: DataFrame, *names: str) -> list[tuple[float, float]]:
    row = df.agg(*[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names)
                   for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(names))]


def _bucket(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the maximum belongs to the last bin."""
    width = (hi - lo) / bins
    place = F.floor((x - F.lit(lo)) / F.lit(width)) if width > 0 else F.lit(0)
    return F.when(x.isNotNull(), F.least(place, F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, name: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """``bins`` equal-width bins with count and density, empty bins included; one series per value of ``color``."""
    require(df, name, *([color] if color else []))
    lo, hi = _range(df, name)[0]
    series = [col(color).alias("series")] if color else []
    keys = ["series"] if color else []
    schema = "bin int, bin_start double, bin_end double, row_count bigint, density double"
    if lo is None:
        return df.sparkSession.createDataFrame([], schema)
    width = (hi - lo) / bins if hi > lo else 0.0
    counted = (df.select(*series, _bucket(num(name), lo, hi, bins).alias("bin")).filter("bin is not null")
               .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("row_count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if color:  # every series gets every bin
        totals = counted.groupBy("series").agg(F.sum("row_count").alias("_n"))
        frame = totals.select("series", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        full = frame.alias("f").join(counted.alias("c"), (F.col("f.bin") == F.col("c.bin"))
                                     & F.col("f.series").eqNullSafe(F.col("c.series")), "left").select(
            "f.series", "f.bin", "_n", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    else:
        total = counted.agg(F.sum("row_count").alias("_n"))  # one row
        full = grid.join(counted, "bin", "left").na.fill(0, ["row_count"]).join(F.broadcast(total))
    density = F.try_divide(F.col("row_count"), F.col("_n") * F.lit(width)) if width else F.lit(None).cast("double")
    return full.select(*keys, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "row_count",
                       density.alias("density"))


def histogram_overlaid(df: DataFrame, names: list[str], bins: int = 30) -> DataFrame:
    """Histograms of several columns, each over its own range, from one pass over the rows."""
    require(df, *names)
    ranges = {n: r for n, r in zip(names, _range(df, *names)) if r[0] is not None}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), _bucket(num(n), lo, hi, bins).alias("bin"))
                      for n, (lo, hi) in ranges.items()])
    counted = (df.select(F.inline(cells)).filter("bin is not null").groupBy("column", "bin")
               .agg(F.count(F.lit(1)).alias("row_count")))
    edges = small_frame(df.sparkSession, [(n, i, lo + i * (hi - lo) / bins, lo + (i + 1) * (hi - lo) / bins)
                                          for n, (lo, hi) in ranges.items() for i in range(bins)],
                        "column string, bin int, bin_start double, bin_end double")
    return edges.join(counted, ["column", "bin"], "left").na.fill(0, ["row_count"])


BOX_FIELDS = ("row_count", "mean", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low",
              "whisker_high", "notch_low", "notch_high", "outlier_count", "outlier_pct")


def box_stats(df: DataFrame, name: str, by: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers, notch and outliers of one column, per group when ``by`` is given."""
    require(df, name, *([by] if by else []))
    x = num(name)
    if by:
        rows = df.select(col(by), x.alias("_x")).filter(col(by).isNotNull() & F.col("_x").isNotNull())
        quart = grouped_quantiles(rows, [by], F.col("_x"))
        bounds = cut_lineage(quart.select(col(by).alias("_g"), *[F.col("quantiles")[i].alias(q)
                                                                 for i, q in enumerate(("q1", "median", "q3"))]))
        joined = rows.join(small_side(bounds), col(by) == F.col("_g")).drop("_g")
        keys = [col(by), F.col("q1"), F.col("median"), F.col("q3")]
    else:
        q1, median, q3 = exact_quantiles(df, [name])[name]
        joined = df.select(x.alias("_x")).filter("_x is not null").select(
            "_x", F.lit(q1).cast("double").alias("q1"), F.lit(median).cast("double").alias("median"),
            F.lit(q3).cast("double").alias("q3"))
        keys = [F.col("q1"), F.col("median"), F.col("q3")]
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - F.lit(k) * iqr, F.col("q3") + F.lit(k) * iqr
    inside = F.col("_x").between(low, high)
    got = joined.groupBy(*keys).agg(
        F.count("_x").alias("row_count"), F.avg("_x").alias("mean"), F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"), F.count_if(~inside).alias("outlier_count"))
    notch = 1.57 * iqr / F.sqrt("row_count")
    got = got.select(*([col(by)] if by else []), "row_count", "mean", "q1", "median", "q3", iqr.alias("iqr"),
                     low.alias("lower_fence"), high.alias("upper_fence"), "whisker_low", "whisker_high",
                     (F.col("median") - notch).alias("notch_low"), (F.col("median") + notch).alias("notch_high"),
                     "outlier_count", (100.0 * F.col("outlier_count") / F.col("row_count")).alias("outlier_pct"))
    return got


def _grid(lo: float, hi: float, points: int) -> list[float]:
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)] if points > 1 else [lo]


CELLS = 32  # cells per bandwidth whose values are told by their moments
MOMENTS = 5  # highest moment kept; a cell's kernels are then within KERNEL_BOUND of their true sum, per value of the cell
KERNEL_BOUND = 4e-13  # 15 * (1 / (2 * CELLS)) ** 6 / 6!, the next term of the expansion, with a margin for rounding


def _cell(x: Column, lo: Column, h: Column) -> tuple[Column, Column]:
    """Cell of a value, and the value's distance from the cell's middle in bandwidths."""
    cell = F.floor((x - lo) * CELLS / h).cast("bigint")
    return cell, (x - lo) / h - (cell + 0.5) / CELLS


def _moments() -> list[Column]:
    power = F.lit(1.0)
    sums = [F.count(F.lit(1)).cast("double").alias("m0")]
    for k in range(1, MOMENTS + 1):
        power = power * F.col("t")
        sums.append(F.sum(power).alias(f"m{k}"))
    return sums


def moment_sums(centres: np.ndarray, moments: np.ndarray, grid: np.ndarray, h: float, step: int = 2_000) -> np.ndarray:
    """Sum of the kernels of all values at every point, from the moments of cells (one row per cell, order 0 first).

    The kernel of a value e bandwidths off the middle is the middle's times the sum of He_k(z) e^k / k! over k.
    """
    total = np.zeros(len(grid))
    for start in range(0, len(centres), step):
        z = (grid - centres[start:start + step, None]) / h
        part = moments[start:start + step]
        older, hermite = np.ones_like(z), z
        series = part[:, 0, None] * older + part[:, 1, None] * hermite
        factorial = 1.0
        for k in range(2, MOMENTS + 1):
            older, hermite = hermite, z * hermite - (k - 1) * older
            factorial *= k
            series += part[:, k, None] * hermite / factorial
        total += (np.exp(-0.5 * z * z) * series).sum(axis=0)
    return total


def kernel_sums(x: np.ndarray, grid: np.ndarray, h: float, step: int = 2_000) -> np.ndarray:
    """Sum of the kernels of all values at every point, a bounded block of values at a time; missing values are nothing."""
    x = x[~np.isnan(x)]
    total = np.zeros(len(grid))
    for start in range(0, len(x), step):
        z = (x[start:start + step, None] - grid) / h
        total += np.exp(-0.5 * z * z).sum(axis=0)
    return total


def kde(df: DataFrame, names: list[str], points: int = 200, bandwidth: float | None = None, exact: bool = False) -> DataFrame:
    """Gaussian density of whole columns at evenly spaced points between minimum and maximum.

    One scan for all columns: rows are reduced to six moments per cell of a 32nd of the bandwidth, whatever the number of
    points, and the kernels are summed up from the cells; a density is off by at most ``KERNEL_BOUND`` of a kernel's height.
    ``exact`` adds up the kernel of every row at every point instead. The default bandwidth is n^(-1/5) times the standard
    deviation.
    """
    require(df, *names)
    stats = number_stats(df, names, quartiles=False)
    made = {}
    for name in names:
        st = stats[name]
        h = bandwidth if bandwidth is not None else (st.std * st.n ** -0.2 if st.n > 1 else 0.0)
        if st.n >= 2 and h:
            made[name] = (st.n, h, _grid(st.low, st.high, points))
    if not made:
        return small_frame(df.sparkSession, [], "column string, point int, x double, density double")
    settings = list(made.values())
    totals_of = "i int, point int, total double"

    def table(totals) -> pd.DataFrame:
        return pd.DataFrame({"i": np.repeat(np.arange(len(settings)), points), "point": np.tile(np.arange(points), len(settings)),
                             "total": np.concatenate(totals)})

    def add_rows(batches):
        totals = [np.zeros(points) for _ in settings]
        for batch in batches:
            for i, (_, h, grid) in enumerate(settings):
                totals[i] += kernel_sums(batch[f"x{i}"].to_numpy(dtype="float64"), np.asarray(grid), h)
        yield table(totals)

    def add_cells(batches):
        totals = [np.zeros(points) for _ in settings]
        for batch in batches:
            for i, part in batch.groupby("i"):
                _, h, grid = settings[i]
                centres = grid[0] + (part["cell"].to_numpy() + 0.5) * (h / CELLS)
                totals[i] += moment_sums(centres, part[[f"m{k}" for k in range(MOMENTS + 1)]].to_numpy(), np.asarray(grid), h)
        yield table(totals)

    if exact:
        parts = df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(made)]).mapInPandas(add_rows, totals_of)
    else:
        cells = []
        for i, (c, (_, h, grid)) in enumerate(made.items()):
            cell, t = _cell(num(c), F.lit(grid[0]), F.lit(float(h)))
            cells.append(F.struct(F.lit(i).alias("i"), cell.alias("cell"), t.alias("t")))
        parts = df.select(F.inline(F.array(*cells))).filter("t is not null").groupBy("i", "cell").agg(*_moments()).mapInPandas(
            add_cells, totals_of)
    sums = parts.groupBy("i", "point").agg(F.sum("total").alias("total"))
    out = [(c, p, x, n * h * math.sqrt(2 * math.pi), i) for i, (c, (n, h, grid)) in enumerate(made.items())
           for p, x in enumerate(grid)]
    grid = small_frame(df.sparkSession, out, "column string, point int, x double, scale double, i int")
    return grid.join(sums, ["i", "point"]).select("column", "point", "x", (F.col("total") / F.col("scale")).alias("density"))


def kde_by_group(df: DataFrame, name: str, by: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """Density of every group over the group's own range; rows meet their group's range in one join and are reduced to
    moments per group and cell (as in ``kde``), from which the kernels are summed up."""
    require(df, name, by)
    rows = df.select(col(by).alias("_g"), num(name).alias("_x")).filter("_g is not null and _x is not null")
    params = rows.groupBy("_g").agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
                                    F.stddev_samp("_x").alias("_s"))
    h = F.lit(float(bandwidth)) if bandwidth is not None else F.col("_s") * F.pow("_n", F.lit(-0.2))
    params = params.withColumn("_h", h).filter("_n > 1 and _h > 0 and _hi > _lo").drop("_s")
    cell, t = _cell(F.col("_x"), F.col("_lo"), F.col("_h"))
    cells = rows.join(params, "_g").select("_g", "_n", "_lo", "_hi", "_h", cell.alias("cell"), t.alias("t")).groupBy(
        "_g", "_n", "_lo", "_hi", "_h", "cell").agg(*_moments())
    kind = rows.schema["_g"].dataType.simpleString()
    share = np.arange(points) / (points - 1) if points > 1 else np.zeros(1)

    def add_up(batches):
        for batch in batches:
            parts = []
            for key, part in batch.groupby("_g", sort=False):
                n, lo, hi, h = part[["_n", "_lo", "_hi", "_h"]].iloc[0]
                grid = lo + (hi - lo) * share
                moments = part[[f"m{k}" for k in range(MOMENTS + 1)]].to_numpy()
                parts.append(pd.DataFrame({
                    "_g": [key] * points, "point": np.arange(points), "x": grid, "scale": n * h * math.sqrt(2 * math.pi),
                    "total": moment_sums(lo + (part["cell"].to_numpy() + 0.5) * (h / CELLS), moments, grid, h)}))
            if parts:
                yield pd.concat(parts)

    sums = cells.mapInPandas(add_up, f"_g {kind}, point int, x double, scale double, total double")
    return sums.groupBy("_g", "point").agg(F.first("x").alias("x"), (F.sum("total") / F.first("scale")).alias("density")).select(
        F.col("_g").alias(by), "point", "x", "density")


def normal_curve(df: DataFrame, name: str, points: int = 200) -> DataFrame:
    """Normal density with the column's mean and standard deviation on the same points."""
    require(df, name)
    st = number_stats(df, [name], quartiles=False)[name]
    rows = []
    if st.n > 1 and st.std:
        normal = NormalDist(st.mean, st.std)
        rows = [(i, g, normal.pdf(g)) for i, g in enumerate(_grid(st.low, st.high, points))]
    return small_frame(df.sparkSession, rows, "point int, x double, density double")


def qq_points(df: DataFrame, name: str, points: int = 99) -> DataFrame:
    """Sample quantiles against standard normal quantiles at evenly spaced probabilities 0.01 to 0.99."""
    require(df, name)
    probs = _grid(0.01, 0.99, points)
    values = exact_quantiles(df, [name], tuple(probs))[name]
    rows = [(i, p, NormalDist().inv_cdf(p), v) for i, (p, v) in enumerate(zip(probs, values)) if v is not None]
    return small_frame(df.sparkSession, rows, "point int, probability double, theoretical double, sample double")


def violin_data(df: DataFrame, name: str, by: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """Density outline of every group with the group's quartiles, median and mean on each row."""
    box = box_stats(df, name, by).select(col(by), "row_count", "mean", "q1", "median", "q3")
    return kde_by_group(df, name, by, points, bandwidth).join(box, by)


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Row counts on a grid of equal cells; cells without rows are left out."""
    return _grid_cells(df, x, y, bins).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("row_count"))


def _grid_cells(df: DataFrame, x: str, y: str, bins: int, *extra: Column) -> DataFrame:
    require(df, x, y)
    pairs = df.filter(col(x).isNotNull() & col(y).isNotNull())
    (x_lo, x_hi), (y_lo, y_hi) = _range(pairs, x, y)
    if x_lo is None:
        x_lo = x_hi = y_lo = y_hi = 0.0
    return pairs.select(_bucket(num(x), x_lo, x_hi, bins).alias("x_bin"),
                        _bucket(num(y), y_lo, y_hi, bins).alias("y_bin"), *extra)


def surface_grid(df: DataFrame, x: str, y: str, z: str, bins: int = 20) -> DataFrame:
    """Mean of z on a grid over x and y."""
    require(df, z)
    return (_grid_cells(df, x, y, bins, num(z).alias("_z")).groupBy("x_bin", "y_bin")
            .agg(F.avg("_z").alias("mean_z"), F.count("_z").alias("row_count")))


def heatmap_3d(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Mean of z for every pair of x and y values."""
    require(df, x, y, z)
    return df.dropna(subset=[x, y]).groupBy(col(x), col(y)).agg(F.avg(num(z)).alias("mean_z"))


def bar_3d(df: DataFrame, x: str, y: str, z: str, most: int = 20) -> DataFrame:
    """Mean of z for every pair among the first 20 distinct values of x and of y (in value order)."""
    require(df, x, y, z)
    def first(name):
        return df.select(col(name)).filter(col(name).isNotNull()).distinct().orderBy(col(name)).limit(most)

    kept = df.join(F.broadcast(first(x)), x, "left_semi").join(F.broadcast(first(y)), y, "left_semi")
    return heatmap_3d(kept, x, y, z)
