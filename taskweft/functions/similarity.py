"""String similarity: bounds and the edit ratio as expressions, the gestalt ratio in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


#: Bits of a limb: the sum of two limbs and a carry stays below 64 bits.
LIMB = 62


def _full() -> Column:
    return F.lit((1 << LIMB) - 1)


def _none() -> Column:
    return F.lit(0).cast("long")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _letters(text: Column) -> Column:
    """Characters (code points), none for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _mask(letters: Column, letter: Column) -> Column:
    """A bit for each place where the letter stands."""
    bits = F.transform(letters, lambda c, i: F.when(c == letter, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(_none()))
    return F.aggregate(bits, _none(), lambda x, bit: x.bitwiseOR(bit))


def _masks(one: Column, two: Column, mask) -> Column:
    """letter -> mask, of the letters that both texts have."""
    return F.map_from_entries(F.transform(F.array_intersect(one, two), lambda c: F.struct(c, mask(c))))


def _zeros(row: Column) -> Column:
    return F.lit(LIMB) - F.bit_count(row)


def _short_lcs(one: Column, two: Column) -> Column:
    """``one`` has LIMB letters at most: a row is one number."""

    def rows(masks):
        met = F.transform(two, lambda c: F.coalesce(F.try_element_at(masks, c), _none()))
        step = lambda row, m: (row + row.bitwiseAND(m)).bitwiseOR(row.bitwiseAND(F.bitwise_not(m))).bitwiseAND(_full())
        return F.aggregate(met, _full(), step, _zeros)

    return _let(_masks(one, two, lambda c: _mask(one, c)), rows)


def _long_lcs(one: Column, two: Column) -> Column:
    """A row is a number for each LIMB letters of ``one``; sums carry from one to the next."""
    starts = F.sequence(F.lit(0), F.floor((F.size(one) - 1) / LIMB).cast("int"))
    begin = F.transform(starts, lambda _: _full())
    empty = F.struct(_none().alias("carry"), F.array().cast("array<bigint>").alias("row"))

    def limb(state, z):
        total = z["r"] + z["r"].bitwiseAND(z["m"]) + state["carry"]
        new = total.bitwiseAND(_full()).bitwiseOR(z["r"].bitwiseAND(F.bitwise_not(z["m"])))
        return F.struct(F.shiftright(total, LIMB).alias("carry"), F.concat(state["row"], F.array(new)).alias("row"))

    def rows(masks):
        met = F.filter(F.transform(two, lambda c: F.try_element_at(masks, c)), lambda m: m.isNotNull())
        step = lambda row, m: F.aggregate(F.zip_with(row, m, lambda r, x: F.struct(r.alias("r"), x.alias("m"))), empty, limb, lambda s: s["row"])
        return F.aggregate(met, begin, step, lambda row: F.aggregate(row, F.lit(0), lambda n, r: n + _zeros(r)))

    return _let(_masks(one, two, lambda c: F.transform(starts, lambda k: _mask(F.slice(one, k * LIMB + 1, F.lit(LIMB)), c))), rows)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence in characters; null for a null text.

    A bit stands for each place of ``a``, and a row of the usual table is the bits where the length does not
    grow; each letter of ``b`` takes it to the next row by one addition.  A column expression: no Python runs.
    """
    found = _let(_letters(a), lambda one: _let(_letters(b), lambda two: F.when(F.size(one) <= LIMB, _short_lcs(one, two)).otherwise(_long_lcs(one, two))))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def edit_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (|a| + |b|): 1 for equal texts, two empty ones included."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_length(a, b) / total)


def ratio_reachable(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths alone allow ``edit_ratio >= least``; exact, and far cheaper."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def gestalt_ratio(blanks_as_junk: bool = False):
    """An Arrow UDF (a, b) -> difflib's ratio, which no expression states."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        junk = (lambda c: c == " ") if blanks_as_junk else None
        return pd.Series([None if x is None or y is None else SequenceMatcher(junk, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio
