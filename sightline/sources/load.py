"""Sources: CSV with type inference over the whole file, parquet, and the generated dirty sample."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sightline.functions.parsing import INFINITY_PATTERN, NUMBER_PATTERN, strip, to_number
from sightline.types import chunks, col

# Texts read as a missing value.
NA_TOKENS = ["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INTEGER_PATTERN = r"^\s*[+-]?\d{1,18}\s*$"


def _line_rules(sep: str) -> dict[str, str]:
    """Patterns of well-formed lines by where they start: outside or inside of a quoted field that newlines may split.

    All loops are possessive, so a line is read once. A line that fits none holds a stray quote."""
    mark = re.escape(sep)
    inner = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{inner}"|[^"{mark}]*+)'
    rest = f"(?:{mark}{field}(?={mark}|$))*+"
    return {"whole": f"^{field}{rest}$", "opens": f'^(?:{field}{mark})*+"{inner}$', "within": f"^{inner}$",
            "closes": f'^{inner}"{rest}$', "reopens": f'^{inner}"{rest}{mark}"{inner}$'}


def _lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """file, block, at, line, returned (a carriage return came before its newline), quotes, whole, starts_well,
    continues_well: every line of the files, split among tasks.

    Lines of one file ascend by block (first byte of the split) and at. The verdicts say whether the line is well formed if it
    begins outside or inside of quotes; lone carriage returns and blank lines count as not, since readers differ on them."""
    rules = _line_rules(sep)
    line = F.col("line")
    lines = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.endswith("value", F.lit("\r")).alias("returned"),
        F.regexp_replace("value", "\r$", "").alias("line"))
    plain = ~line.contains('"')
    odd = line.contains("\r") | line.rlike("^[\\x00-\\x20]+$")
    return lines.select(
        "*", (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).alias("quotes"),
        (~odd & (plain | line.rlike(rules["whole"]))).alias("whole"),
        (~odd & (plain | line.rlike(rules["whole"]) | line.rlike(rules["opens"]))).alias("starts_well"),
        (~line.contains("\r") & (plain | line.rlike(rules["within"]) | line.rlike(rules["closes"])
                                 | line.rlike(rules["reopens"]))).alias("continues_well"))


def _joined_records(lines: DataFrame, returns: bool) -> tuple[DataFrame, DataFrame]:
    """Records of files with quoted newlines (file, block, at, value), and the files whose quotes fit no record.

    ``returns`` says that carriage returns are part of the quoted text, since lines end without them elsewhere.

    Whether a line starts inside quotes follows from the number of quotes before it: running sums inside a block, plus one row
    per block. Only lines of records that span lines are shuffled."""
    here = Window.partitionBy("file", "block").orderBy("at")  # at most one split of a file
    counted = lines.withColumn("before", F.sum("quotes").over(here) - F.col("quotes"))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = blocks.select("file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("offset"))
    placed = counted.join(offsets, ["file", "block"]).withColumn("inside", (F.col("before") + F.col("offset")) % 2 == 1)
    bad = F.when(F.col("inside"), ~F.col("continues_well")).otherwise(~F.col("starts_well"))
    if returns:
        open_end = F.col("inside") != (F.col("quotes") % 2 == 1)
        bad = bad | (F.col("returned") & ~open_end)
        placed = placed.withColumn("line", F.when(F.col("returned"), F.concat("line", F.lit("\r"))).otherwise(F.col("line")))
    unfit = placed.where(bad)
    alone = placed.where(~F.col("inside") & (F.col("quotes") % 2 == 0))
    spanning = placed.where(F.col("inside") | (F.col("quotes") % 2 == 1))
    first = F.when(~F.col("inside"), F.struct("block", "at"))
    owned = spanning.withColumn("own", F.last(first, ignorenulls=True).over(here))
    lasts = owned.groupBy("file", "block").agg(F.max("own").alias("own"))
    # lines before a block's first record belong to the last one begun in the blocks before
    prior = lasts.select("file", "block", F.last("own", ignorenulls=True).over(earlier).alias("prior"))
    record = F.coalesce("own", "prior")
    grouped = owned.join(prior, ["file", "block"]).groupBy("file", record.alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
    joined = grouped.select("file", "record.block", "record.at", F.array_join("parts.line", "\n").alias("value"))
    return alone.where("line <> ''").select("file", "block", "at", F.col("line").alias("value")).unionByName(
        joined), unfit.select("file").distinct()


def _path_of(file: str) -> str:
    return unquote(file) if "%" in file else file


def _split_csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text. Every file is read in the way that its quotes allow: by Spark's splitting reader if no quoted field
    holds a newline, else by joining its lines to records, also split; files with stray quotes by one task each."""
    options = {"header": True, "sep": sep, "escape": '"'}
    schema = spark.read.csv(path, multiLine=True, **options).schema
    every = _lines(spark, [path], sep)
    spot, bare = F.struct("block", "at"), F.count_if(~F.col("returned"))
    verdicts = every.groupBy("file").agg(
        F.bool_and("whole").alias("whole"), F.bool_and(F.col("starts_well") | F.col("continues_well")).alias("fits"),
        F.min_by("returned", spot).alias("first"), F.bool_or("returned").alias("some"),
        ((bare == 0) | ((bare == 1) & ~F.max_by("returned", spot))).alias("all")).collect()  # files, which the driver lists anyway
    kinds: dict[str, list[str]] = {"whole": [], "spans": [], "returns": [], "stray": []}
    for r in verdicts:
        even = r["all"] or not r["some"]  # one kind of line end throughout
        kind = "whole" if r["whole"] and even else "stray" if not r["fits"] else "spans" if even else \
            "stray" if r["first"] else "returns"
        kinds[kind].append(_path_of(r["file"]))
    parts = []
    for kind in ("spans", "returns"):
        files = kinds[kind]
        if files:
            records, unfit = _joined_records(_lines(spark, files, sep), kind == "returns")
            late = sorted(_path_of(r["file"]) for r in unfit.collect())
            kinds["stray"] += late
            files = [f for f in files if f not in late]
            if late and files:
                records = _joined_records(_lines(spark, files, sep), kind == "returns")[0]
        if files:
            heads = records.groupBy("file").agg(F.min(F.struct("block", "at")).alias("head"))
            body = records.join(heads, "file").where(F.struct("block", "at") != F.col("head"))
            texts = ", ".join("`" + c.replace("`", "``") + "` string" for c in schema.names)
            parsed = F.from_csv("value", texts, {"sep": sep, "escape": '"'})
            parts.append(body.select(parsed.alias("row")).select("row.*"))
    if kinds["whole"]:
        parts.append(spark.read.schema(schema).csv(kinds["whole"], **options))
    if kinds["stray"]:
        parts.append(spark.read.schema(schema).csv(kinds["stray"], multiLine=True, **options))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def load_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """CSV with a header: a column is bigint, double or boolean if all its values read so, else text.

    Every row takes part in the decision (one aggregate over the file); dates stay text. Quoted text may hold newlines. By
    default one more pass over the lines finds out how each file can be split among tasks; ``multi_line`` states it instead:
    False for files known to hold no quoted newline, True for one task per file.
    """
    raw = _split_csv(spark, path, sep) if multi_line is None else spark.read.csv(
        path, header=True, sep=sep, inferSchema=False, multiLine=multi_line, escape='"')
    text = raw.select(*[F.when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    kinds: dict[str, str] = {}
    for group in chunks(text.columns, 40):
        row = text.agg(*[a for i, c in enumerate(group) for a in (
            F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(INTEGER_PATTERN)).alias(f"i{i}"),
            F.count_if(col(c).rlike(NUMBER_PATTERN) | col(c).rlike(INFINITY_PATTERN)).alias(f"d{i}"),
            F.count_if(col(c).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"))]).first()
        for i, c in enumerate(group):
            n = row[f"n{i}"]
            if n == 0 or row[f"d{i}"] == n:
                kinds[c] = "bigint" if n and row[f"i{i}"] == n else "double"
            else:
                kinds[c] = "boolean" if row[f"b{i}"] == n else "string"
    made = {"bigint": lambda c: strip(c).cast("bigint"), "double": to_number,
            "boolean": lambda c: F.lower(c).cast("boolean"), "string": lambda c: c}
    return text.select(*[made[kinds[c]](col(c)).alias(c) for c in text.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of a missing number: NaN becomes null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else col(c)
                       for c in df.columns])


def load_table(spark: SparkSession, path: str, has_nan: bool = True) -> DataFrame:
    """Parquet table with NaN read as missing.

    For a table known to hold no NaN pass ``has_nan=False``: filters on its fractional columns then reach the
    scan, which the replacement would prevent.
    """
    df = spark.read.parquet(path)
    return nan_to_null(df) if has_nan else df


def generate_sample_dataset(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """A table with planted problems: nulls, impossible ages, salary outliers, mixed case, repeated rows."""
    # The planted categories.
    departments = F.array(*[F.lit(d) for d in ("HR", "IT", "Finance", "Marketing", "hr", "it")])

    def pick(k: int, size: int):  # about ``size`` rows in 1000, chosen by hash
        return F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1000)) < size

    base = spark.range(1, n + 1).select(
        "id", (F.lit(35.0) + 10.0 * F.randn(seed)).alias("age"),
        (-F.ln(1.0 - F.rand(seed + 1)) * 50000.0).alias("salary"),
        F.element_at(departments, (F.floor(F.rand(seed + 2) * 6) + 1).cast("int")).alias("department"),
        (F.lit(8.0) + 4.0 * F.randn(seed + 3)).alias("experience"), (1.0 + 4.0 * F.rand(seed + 4)).alias("rating"),
        F.lit("A").alias("constant_col"),
        F.when(F.col("id") > F.lit(int(n * 0.95)), "value").alias("mostly_null"),
        F.when(F.rand(seed + 5) < 0.5, "X").otherwise("Y").alias("duplicate_col"))
    dirty = base.withColumns({
        "age": F.when(pick(0, 20), F.lit(-5.0)).when(~pick(1, 50), F.col("age")),
        "salary": F.when(pick(2, 30), F.lit(500000.0)).otherwise(F.col("salary"))})
    # the repeated rows come from the same projection, so every copy is equal
    copies = F.when(F.col("id") <= 10, 2).otherwise(1)
    return dirty.withColumn("_k", F.explode(F.array_repeat(F.lit(0), copies))).drop("_k")
