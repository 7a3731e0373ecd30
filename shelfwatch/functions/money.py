"""Money sums that do not depend on row order.

Amounts have two decimals. Adding them as whole cents in a ``bigint`` is exact,
so partial sums may be merged in any order, and the accumulator stays a
primitive that hash aggregation updates in place (a ``decimal`` wider than 18
digits would not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column | str) -> Column:
    """Amount in whole cents."""
    return F.rint(F.col(amount) * 100 if isinstance(amount, str) else amount * 100).cast("bigint")


def from_cents(total: Column) -> Column:
    return total / F.lit(100.0)


def money_sum(amount: Column | str) -> Column:
    """Exact sum of a money column, NULL for an empty group."""
    return from_cents(F.sum(cents(amount)))


def money_avg(amount: Column | str) -> Column:
    """Mean of a money column: exact sum over the count of non-null amounts."""
    return F.try_divide(money_sum(amount), F.count(amount))
