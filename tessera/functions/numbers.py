"""Numbers: six-digit decimal positions, ratios and tiered costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION = "decimal(7,6)"


def as_int(x: Column) -> Column:
    """A whole number or null."""
    return x.try_cast("long")


def metric(first: Column, second: Column) -> Column:
    """The first count, but a zero falls through to the second, as in the stored history."""
    return F.coalesce(F.nullif(as_int(first), F.lit(0).cast("long")), as_int(second))


def to_position(x: Column) -> Column:
    """x as decimal(7,6), rounded half up."""
    return F.round(x.cast("decimal(20,10)"), 6).cast(POSITION)


def mean_position(total: Column, n: Column) -> Column:
    """total / n as a position, 0 where n is 0."""
    return F.coalesce(F.round(total.cast("decimal(26,6)") / F.nullif(n, F.lit(0)).cast("decimal(10,0)"), 6), F.lit(0)).cast(POSITION)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0."""
    return F.round(F.try_divide(a, b), digits)


def normalised_rank(rank: Column, n: Column) -> Column:
    """(rank - 1) / (n - 1), from 0 to 1; 0 in a list of one."""
    return (rank - 1) / F.greatest(n - 1, F.lit(1))


def page_credits(n: Column) -> Column:
    """Credits of a page of n rows: 0 for none, one a row from 200, two a row from 100, else three a row and 60 at least."""
    return F.when(n <= 0, 0).when(n >= 200, n).when(n >= 100, 2 * n).otherwise(F.greatest(F.lit(60), 3 * n)).cast("long")


def projected_credits(count: Column, page: int = 200) -> Column:
    """Credits of full pages and the last one."""
    return (F.floor(count / page) * page + page_credits(count % page)).cast("long")
