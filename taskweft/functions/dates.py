"""Schedule dates and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The date forms of schedule exports.
FORMATS = ["dd/MM/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy"]
WEEKDAY = r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) \w+ (\d{4})$"


def date_format(text: Column) -> Column:
    """Which form a date has: a pattern of FORMATS, ``weekday``, or null."""
    return (
        F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), "yyyy/MM/dd")
        .when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), "yyyy-MM-dd")
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "dd/MM/yyyy")
        .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), "dd-MM-yyyy")
        .when(text.rlike(WEEKDAY), "weekday")
    )


def parse_date(text: Column) -> Column:
    """Each value by its own form; what has none is null, never an error."""
    weekday = F.concat_ws(" ", *(F.regexp_extract(text, WEEKDAY, k) for k in (1, 2, 3, 4)))
    plain = [F.try_to_timestamp(text, F.lit(f.replace("dd", "d").replace("MM", "M"))) for f in FORMATS]
    return F.coalesce(*plain, F.when(text.rlike(WEEKDAY), F.try_to_timestamp(weekday, F.lit("MMM d HH:mm:ss yyyy")))).cast("timestamp_ntz")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def whole_days(start: Column, end: Column) -> Column:
    """Days between, rounded down (minus half a day is -1)."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def ratio(actual: Column, planned: Column) -> Column:
    """actual / planned; null where planned is 0."""
    return F.when(planned != 0, actual / planned)


def overrun(actual: Column, planned: Column) -> Column:
    return actual - planned


def percent_overrun(actual: Column, planned: Column) -> Column:
    return F.when(planned != 0, 100 * (actual / planned - 1))
