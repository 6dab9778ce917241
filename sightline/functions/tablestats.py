"""Statistics shared by the operators: each kind is one fused job, done at most once per object."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import counts, quantiles
from sightline.functions.parsing import to_moment, to_number
from sightline.session import cut_lineage
from sightline.types import chunks, col, is_numeric, numeric_names, sql_lit, sql_num, string_names

QUARTILES = (0.25, 0.5, 0.75)
COLUMNS_PER_JOB = 40
MOMENT_COLUMNS = 4  # more would make one generated method too large for the JIT compiler


@dataclass
class NumberStats:
    n: int = 0
    mean: float | None = None
    var_pop: float | None = None
    low: float | None = None
    high: float | None = None
    skew: float | None = None  # population
    kurt: float | None = None  # population excess
    q1: float | None = None
    median: float | None = None
    q3: float | None = None

    @property
    def var(self):
        return None if self.n < 2 else self.var_pop * self.n / (self.n - 1)

    @property
    def std(self):
        return None if self.var is None else math.sqrt(self.var)

    @property
    def std_pop(self):
        return None if self.var_pop is None else math.sqrt(self.var_pop)

    @property
    def iqr(self):
        return None if self.n == 0 else self.q3 - self.q1

    def fences(self, k: float = 1.5):
        return (None, None) if self.n == 0 else (self.q1 - k * self.iqr, self.q3 + k * self.iqr)

    @property
    def sample_skew(self):
        n = self.n
        if n < 3 or self.var_pop is None:
            return None
        if self.skew is None:
            return 0.0
        return self.skew * math.sqrt(n * (n - 1.0)) / (n - 2)

    @property
    def sample_kurt(self):
        n = self.n
        if n < 4 or self.var_pop is None:
            return None
        if self.kurt is None:
            return 0.0
        return (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * self.kurt + 6)


@dataclass
class ValueStats:
    unique: int = 0
    non_null: int = 0
    top: str | None = None
    top_count: int = 0
    rarest: int = 0


class TableStats:
    """Lazily computed statistics of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession
        self.numeric = numeric_names(df)
        self.strings = string_names(df)

    @classmethod
    def of(cls, table) -> "TableStats":
        return table if isinstance(table, TableStats) else cls(table)

    @cached_property
    def _counts(self) -> tuple[int, dict[str, int]]:
        rows, out = 0, {}
        for group in chunks(self.df.columns, 200) or [[]]:
            row = self.df.agg(F.count(F.lit(1)).alias("n"),
                              *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(group)]).first()
            rows = row["n"]
            out.update({c: row[f"c{i}"] for i, c in enumerate(group)})
        return rows, out

    @property
    def rows(self) -> int:
        return self._counts[0]

    @property
    def non_null(self) -> dict[str, int]:
        return self._counts[1]

    @property
    def nulls(self) -> dict[str, int]:
        return {c: self.rows - n for c, n in self.non_null.items()}

    @property
    def missing_cells(self) -> int:
        return sum(self.nulls.values())

    @property
    def cells(self) -> int:
        return self.rows * len(self.df.columns)

    @cached_property
    def numbers(self) -> dict[str, NumberStats]:
        """Moments, range and exact quartiles of every numeric column: two scans."""
        return number_stats(self.df, self.numeric)

    @cached_property
    def moments(self) -> dict[str, NumberStats]:
        """As ``numbers`` but without quartiles: one scan, inside code generation."""
        if "numbers" in self.__dict__:
            return self.numbers
        return number_stats(self.df, self.numeric, quartiles=False)

    @cached_property
    def values(self) -> dict[str, ValueStats]:
        """Distinct-value summary of the string columns."""
        return value_stats(self.df, self.strings)

    @cached_property
    def all_values(self) -> dict[str, ValueStats]:
        """Distinct-value summary of all columns."""
        found = value_stats(self.df, self.df.columns)
        self.__dict__.setdefault("values", {c: found[c] for c in self.strings})
        return found

    @cached_property
    def mixed_case(self) -> list[str]:
        """Text columns with values that differ in case only."""
        if not self.strings:
            return []
        return [r["column"] for r in counts.folded_counts(self.df, self.strings).collect() if r["after"] < r["before"]]

    @cached_property
    def duplicates(self) -> int:
        return counts.duplicate_count(self.df).first()[0]

    @cached_property
    def parse_counts(self) -> dict[str, tuple[int, int]]:
        """Per string column: values that read as a number, values that read as a moment."""
        out = {}
        for group in chunks(self.strings, COLUMNS_PER_JOB):
            row = self.df.agg(*[a for i, c in enumerate(group) for a in (
                F.count(to_number(col(c))).alias(f"n{i}"), F.count(to_moment(col(c))).alias(f"m{i}"))]).first()
            out.update({c: (row[f"n{i}"], row[f"m{i}"]) for i, c in enumerate(group)})
        return out

    @cached_property
    def outliers(self) -> dict[str, int]:
        """Values strictly outside the 1.5-IQR fences."""
        return count_outside(self.df, {c: self.numbers[c].fences() for c in self.numeric if self.numbers[c].n})

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float | None]:
        from sightline.functions.correlate import pair_correlations
        return pair_correlations(self.df, self.numeric, self.non_null, self.rows)

    @cached_property
    def correlation_table(self) -> DataFrame:
        """All pairs of numeric columns by position, for tables too wide to hold them on the driver."""
        from sightline.functions.correlate import pair_table
        return cut_lineage(pair_table(self.df, self.numeric))

    def is_numeric(self, name: str) -> bool:
        return is_numeric(self.df.schema[name].dataType)


def share(part, whole):
    return None if not whole else part / whole


def number_stats(df: DataFrame, names: list[str], quartiles: bool = True) -> dict[str, NumberStats]:
    """Moments in one code-generated scan per ``MOMENT_COLUMNS`` columns, quartiles apart from them.

    Sketches are not code-generated; mixing both kinds in one aggregate would slow the moments down.
    """
    out: dict[str, NumberStats] = {}
    for group in chunks(names, MOMENT_COLUMNS):
        row = df.agg(*[a.alias(f"{k}{i}") for i, name in enumerate(group) for k, a in _moment_aggs(sql_num(name))]).first()
        for i, name in enumerate(group):
            out[name] = NumberStats(row[f"n{i}"], row[f"mean{i}"], row[f"var{i}"], row[f"lo{i}"], row[f"hi{i}"],
                                    row[f"skew{i}"], row[f"kurt{i}"])
            if out[name].n and out[name].low == out[name].high:  # rounding may leave a constant a tiny deviation
                out[name].mean, out[name].var_pop, out[name].skew, out[name].kurt = out[name].low, 0.0, None, None
    if quartiles and names:
        for name, values in quantiles.exact_quantiles(df, names, QUARTILES).items():
            out[name].q1, out[name].median, out[name].q3 = values
    return out


def _moment_aggs(x):
    return [(k, F.expr(f"{f}({x})")) for k, f in (("n", "count"), ("mean", "avg"), ("var", "var_pop"), ("lo", "min"),
                                                  ("hi", "max"), ("skew", "skewness"), ("kurt", "kurtosis"))]


def value_stats(df: DataFrame, names: list[str]) -> dict[str, ValueStats]:
    out = {name: ValueStats() for name in names}
    if names:
        for r in counts.column_value_summary(df, names).collect():  # one row per column
            out[r["column"]] = ValueStats(r["unique_values"], r["non_null"], r["most_frequent"], r["frequency"],
                                          r["rarest"])
    return out


def count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for group in chunks(list(bounds), 100):
        row = df.agg(*[F.expr(f"count_if({sql_num(c)} < {sql_lit(bounds[c][0])} or {sql_num(c)} > "
                              f"{sql_lit(bounds[c][1])}) as k{i}") for i, c in enumerate(group)]).first()
        out.update({c: row[f"k{i}"] for i, c in enumerate(group)})
    return out
