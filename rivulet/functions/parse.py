"""Dirty text to typed values: times, numbers, names. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value" in station files.
NULL_TOKENS = ("", "-", "--", "/", "//", "null", "nan", "none", "na", "n/a", "—", "－", "缺测", "缺", "无")
# Lengths of named time steps in seconds.
STEP_LABELS = {3600: "1h", 7200: "2h", 10800: "3h", 21600: "6h", 43200: "12h", 86400: "24h", 604800: "7d", 2592000: "1mon"}
#: Values at or below this are a missing mark.
MISSING_BELOW = -9999.0

_DASHED = r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?)?)?$"
_SERIAL = r"^\d{5}(\.\d+)?$"


def parse_time(text: Column) -> Column:
    """timestamp_ntz of a written time, null if it is none.

    Accepts dashes, slashes, the characters for year, month and day, a T, compact digits (their number decides, so
    20151231 is a date) and five-digit spreadsheet serials counted from 1899-12-30. Month and day default to 1.
    """
    return F.get(F.transform(F.array(_cleaned(text)), _time_of), F.lit(0))  # the name of a lambda holds the cleaned text, as every mention of a column expression works it out again


def _cleaned(text: Column) -> Column:
    """A written time with dashes, single spaces and neither quotes nor a dash at its end."""
    x = F.translate(F.trim(F.translate(text, "\"'", "")), "T年月/日", " --- ")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "-$", "")
    x = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5")
    return F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})( .*)?$", "$1-$2-$3$4")


def _time_of(x: Column) -> Column:
    part = lambda i, default: F.coalesce(F.regexp_extract(x, _DASHED, i).try_cast("int"), F.lit(default))
    dashed = F.try_make_timestamp_ntz(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(16,6)"))
    seconds = F.round(x.try_cast("double") * 86400).cast("long")
    serial = F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    # a cast reads these spellings far faster; what it refuses (60 seconds) is made of its parts
    return F.when(x.rlike(_DASHED), F.coalesce(x.try_cast("timestamp_ntz"), dashed)).when(x.rlike(_SERIAL), serial)


def parse_value(text: Column, scale: float = 1.0) -> Column:
    """double of a written number; null for missing marks, non-finite numbers and those at or below MISSING_BELOW."""
    # missing marks are no numbers, or NaN, which is no less than infinity
    number = F.translate(F.trim(text), ",，", "").try_cast("double")
    return F.when((number > MISSING_BELOW) & (number < float("inf")), number * scale)


def norm_key(text: Column) -> Column:
    """A column header for comparing: no white space, underscores, dashes or brackets, in lower case."""
    return F.lower(F.regexp_replace(text, r"[\s_\-()（）]", ""))


def norm_name(text: Column) -> Column:
    """A station name for comparing: no spaces, ASCII brackets, without a suffix that says what kind of station it is."""
    x = F.translate(F.regexp_replace(text, " ", ""), "（）", "()")
    return F.lower(F.regexp_replace(x, "(水文站|雨量站|水位站|站)$", ""))


def interval_label(seconds: Column) -> Column:
    """Name of a time step; hours are tried before days."""
    named = F.create_map(*[F.lit(v) for pair in STEP_LABELS.items() for v in pair])
    whole = lambda unit: (seconds % unit == 0) & (seconds >= unit)
    count = lambda unit: F.call_function("div", seconds, F.lit(unit)).cast("string")
    other = F.when(whole(3600), F.concat(count(3600), F.lit("h"))).when(whole(86400), F.concat(count(86400), F.lit("d"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    return F.coalesce(F.try_element_at(named, seconds.cast("int")), other)
