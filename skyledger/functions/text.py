"""Fixed-width text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that marks a missing float in the station catalogue.
MISSING_FLOAT = "-999.9"


def fixed(line: Column, start: int, end: int) -> Column:
    """Trimmed slice ``[start, end)`` counted from 0; '' beyond the line's end."""
    return F.trim(F.substring(line, start + 1, end - start))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_double(c: Column) -> Column:
    """Double, or NULL for blank, the missing marker, or text that is no number."""
    text = F.trim(c)
    # Spark would also accept Java suffixes such as "1.0d"
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain & (text != MISSING_FLOAT), text.try_cast("double"))


def try_int(c: Column, on_error: str = "skip") -> Column:
    """Integer of trimmed text. Bad text is NULL, or stops the job with 'fail'."""
    text = F.trim(c)
    number = text.try_cast("int")
    if on_error == "fail":
        return F.when(
            number.isNull(), F.raise_error(F.concat(F.lit("not an integer: "), text)).cast("int")
        ).otherwise(number)
    if on_error != "skip":
        raise ValueError(f"on_error must be 'skip' or 'fail', not {on_error!r}")
    return number


def month_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))
