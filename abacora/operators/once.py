"""Costly columns worked out once for equal values instead of once a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: With so many rows a value on average, or more, values are worked out apart and joined back; with fewer, the join would cost more than it spares.
COPIES = 4


def per_value(rows: DataFrame, by: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that make adds to a table of `by`, where they depend on `by` alone. Equal rows stay as many as they are, nulls are equal.

    How often values recur is estimated for the choice of the plan only; both plans give the same rows. The table of values is written
    once, so that its size is known before the join: a small one is broadcast and the rows aren't shuffled.
    """
    n, values = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*by))).first()
    if n < COPIES * values:
        return make(rows)
    made = stored(make(stored(rows.select(*by).distinct(), "values")), "made")
    new = [c for c in made.columns if c not in by]
    told = made.select(*[F.col(c).alias(f"_{c}") for c in by], *new)
    return rows.drop(*new).join(told, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left").drop(*[f"_{c}" for c in by])
