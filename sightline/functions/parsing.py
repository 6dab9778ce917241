"""Column expressions that read numbers, dates and JSON out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"

# Fixed patterns: what counts as a number, and the date spellings accepted besides ISO.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
ISO_PATTERN = r"^\s*\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}([.]\d+)?)?)?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
EMBEDDED_NUMBER_PATTERN = r"[-+]?\d*\.\d+|[-+]?\d+"
DATE_REWRITES = (
    (r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"^\s*(\d{4})(\d{2})(\d{2})\s*$", "$1-$2-$3"),
)


def strip(c: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def to_number(c: Column) -> Column:
    """Text to double; null where the text is not a plain number."""
    plain = F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))
    return plain.when(c.rlike(INFINITY_PATTERN), strip(c).try_cast("double"))


def to_moment(c: Column) -> Column:
    """Text to timestamp without zone; null where no accepted date spelling matches."""
    text = c
    for pattern, iso in DATE_REWRITES:
        text = F.regexp_replace(text, pattern, iso)
    return F.when(text.rlike(ISO_PATTERN), strip(text).try_cast("timestamp_ntz"))


def embedded_number(c: Column, pick: str = "first") -> Column:
    """First or last number inside a text."""
    if pick == "first":
        found = F.regexp_extract(c, f"({EMBEDDED_NUMBER_PATTERN})", 1)
    elif pick == "last":
        found = F.try_element_at(
            F.regexp_extract_all(c, F.lit(f"({EMBEDDED_NUMBER_PATTERN})"), F.lit(1)), F.lit(-1)
        )
    else:
        raise ValueError("pick must be 'first' or 'last'")
    return found.try_cast("double")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647))), ""
    )


def json_or_error(c: Column) -> Column:
    """JSON text as it is, else its outermost braces, else an error record holding the text."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)

    def valid(text: Column) -> Column:
        return F.try_parse_json(text).isNotNull()

    failed = F.to_json(F.struct(F.lit("Invalid JSON from model").alias("error"), c.alias("raw")))
    return F.when(c.isNull(), None).when(valid(c), c).when((inner != "") & valid(inner), inner).otherwise(failed)
