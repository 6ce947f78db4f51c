"""Column-level rules that many tables share: missing values, gates, tiers, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: done once, at ingest."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None)) for n in floats})


def finite(c: Column) -> Column:
    """Neither missing, NaN nor infinite (PRJ-06)."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clipped(c: Column, low=None, high=None) -> Column:
    """PRJ-16."""
    c = c if high is None else F.least(c, F.lit(high))
    return c if low is None else F.greatest(c, F.lit(low))


def ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    """a / b, and ``otherwise`` where b is 0 or missing; operators differ in that value, so it is always said."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def row_mean(*columns: Column) -> Column:
    """Mean of the values that are there (PRJ-15)."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def truthy(c: Column) -> Column:
    """PRJ-12."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def gate(conditions: dict[str, tuple[Column, object]]) -> Column:
    """All of the named bounds that are set: {"min_x": (column, bound or None)} (PRJ-08)."""
    tests = []
    for name, (c, bound) in conditions.items():
        if bound is None or bound is False:
            continue
        kind = name.split("_")[0]
        tests.append({"min": lambda: c >= bound, "max": lambda: c <= bound, "over": lambda: c > bound, "under": lambda: c < bound, "is": lambda: c}[kind]())
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The first rule that holds, in list order (PRJ-10)."""
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(otherwise))


def tier(c: Column, tiers: list[tuple[str, float | None, float | None]], otherwise: str = "untiered") -> Column:
    """The first tier whose inclusive bounds hold ``c``; a bound of None is open (PRJ-09)."""

    def holds(low, high):
        test = c.isNotNull()
        test = test if low is None else test & (c >= low)
        return test if high is None else test & (c <= high)

    return first_match([(name, holds(low, high)) for name, low, high in tiers], otherwise)


def directional(lfc: Column, pos: Column, neg: Column) -> Column:
    """The positive side's value where lfc > 0, else the negative side's, also where lfc is missing (PRJ-14)."""
    return F.when(lfc > 0, pos).otherwise(neg)


def classified(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Ordered rules of regular expressions; the first with any match names the class (Q-48)."""
    return first_match([(name, reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])) for name, patterns in rules], otherwise)
