"""Dates, amounts and lists of a case, checked without guessing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import casefold, let, strip

OPERATORS = ("<", "<=", "==", ">=", ">")
MONEY = "decimal(18,4)"


def parse_date(text: Column) -> Column:
    """ISO, d.m.yyyy or d.m.yy; null for any other. Years 69 to 99 of two digits are in the twentieth century."""
    value = strip(text)
    short = F.when(value.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.try_to_date(value, "d.M.yy"))
    century = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    iso = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(value, "yyyy-M-d"))
    long = F.when(value.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(value, "d.M.yyyy"))
    return F.coalesce(iso, long, century)


def compare_dates(left: Column, operator: Column, right: Column) -> Column:
    """Struct of passed and expression; passed is null if a date or the operator can't be read."""
    a, b = parse_date(left), parse_date(right)
    passed = F.when(operator == "<", a < b).when(operator == "<=", a <= b).when(operator == "==", a == b).when(operator == ">=", a >= b).when(operator == ">", a > b)
    return F.struct(passed.alias("passed"), F.concat_ws(" ", a.cast("string"), operator, b.cast("string")).alias("expression"))


def compare_all(comparisons: Column) -> Column:
    """Of an array of structs of name, operator, left and right, an array of name, passed and expression; null if it is empty."""
    done = F.transform(comparisons, lambda c: let(compare_dates(c["left"], c["operator"], c["right"]), lambda r: F.struct(c["name"].alias("name"), r["passed"].alias("passed"), r["expression"].alias("expression"))))
    return F.when(F.size(comparisons) > 0, done)


def sum_amounts(amounts: Column, expected: Column, tolerance: Column | str = "0.01") -> Column:
    """Struct of total, difference and passed, in exact decimals; null for no amounts."""
    total = F.aggregate(F.transform(amounts, lambda x: x.cast(MONEY)), F.lit(0).cast(MONEY), lambda a, b: (a + b).cast(MONEY))
    difference = (total - expected.cast(MONEY)).cast(MONEY)
    return F.when(F.size(amounts) > 0, F.struct(total.alias("total"), difference.alias("difference"), (F.abs(difference) <= (F.lit(tolerance) if isinstance(tolerance, str) else tolerance).cast(MONEY)).alias("passed")))


def _folded(values: Column) -> Column:
    return F.array_distinct(F.transform(values, casefold))


def overlap(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(_folded(left), _folded(right)))


def missing(present: Column, required: Column) -> Column:
    return F.array_sort(F.array_except(_folded(required), _folded(present)))


def round_exact(value: Column, digits: int = 3) -> Column:
    """A double rounded to so many digits by its exact binary value, ties to even, as Python rounds.

    SQL rounds the shortest decimal that reads as the double, which may lie on the other side of a half. Here the double is compared
    with the double next to the half between two results; where they are equal, with the half itself, by an error-free product.
    Doubles beyond 2 ** 52 / 10 ** digits have no further digits, and stay.
    """
    scale = 10**digits
    x = F.abs(value)
    near = F.floor(x * scale + 0.5).cast("double")

    def side(k: Column) -> Column:
        """Below 0, 0 or above 0 as x is below, on or above the half between k and k + 1."""
        half = (2 * k + 1) / (2.0 * scale)
        high = half * 134217729.0 - (half * 134217729.0 - half)  # the upper half of its digits
        rest = ((2 * k + 1) - 2.0 * scale * high) - 2.0 * scale * (half - high)  # what the half is above its double, times 2 * scale
        return F.when(x < half, -1).when(x > half, 1).otherwise(-F.signum(rest).cast("int"))

    def up(k: Column) -> Column:
        return let(side(k), lambda s: (s > 0) | ((s == 0) & (k % 2 == 1)))

    k = F.when(up(near), near + 1).when((near >= 1) & ~up(near - 1), near - 1).otherwise(near)
    return F.when(x >= 2.0**52 / scale, value).otherwise(F.signum(value) * k / scale)
