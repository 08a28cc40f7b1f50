"""Feature sums: filters and groups chosen at run time, built as DataFrame plans (never as SQL text)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Selection:
    """What to sum: a measure by key, with value filters, and optionally by the part of a column a pattern matches."""

    key: str
    measure: str
    filters: dict[str, list] = field(default_factory=dict)
    pattern: tuple[str, str] | None = None


class InvalidSelection(ValueError):
    pass


def validate(df: DataFrame, selections: list[Selection]) -> None:
    """At most two selections, known columns, and values that occur (one distinct scan a filter)."""
    if not 1 <= len(selections) <= 2:
        raise InvalidSelection("choose one or two features")
    for s in selections:
        for c in (s.key, s.measure, *s.filters, *([s.pattern[0]] if s.pattern else [])):
            if c not in df.columns:
                raise InvalidSelection(f"no column {c}")
        for c, values in s.filters.items():
            known = {r[0] for r in df.where(F.col(c).isin(values)).select(c).distinct().limit(len(values)).collect()}
            if missing := [v for v in values if v not in known]:
                raise InvalidSelection(f"{c} has no {missing}")


def feature_sum(df: DataFrame, s: Selection, name: str = "total") -> DataFrame:
    """(key, total); with a pattern one row for each key and matched text, which is not returned."""
    for c, values in s.filters.items():
        df = df.where(F.col(c).isin(values))
    if s.pattern is None:
        return df.groupBy(s.key).agg(F.sum(s.measure).alias(name))
    column, pattern = s.pattern
    matched = df.where(F.col(column).rlike(pattern)).withColumn("_match", F.regexp_extract(column, pattern, 0))
    return matched.groupBy(s.key, "_match").agg(F.sum(s.measure).alias(name)).drop("_match")


def combine(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner joins on the key, in order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def table_for(feature: str, year: int, routes: dict[tuple[str, int | None], str]) -> str:
    """The table of a feature: its own for the year, else its general one."""
    for at in ((feature, year), (feature, None)):
        if at in routes:
            return routes[at]
    raise InvalidSelection(f"no table for {feature} in {year}")
