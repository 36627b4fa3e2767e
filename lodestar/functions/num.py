"""Numbers as reports show them: halves round up (towards plus infinity), in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jsround(x: Column, digits: int = 0) -> Column:
    k = float(10**digits)
    return F.floor(x.cast("double") * k + 0.5).cast("double") / k


def to_long(x: Column) -> Column:
    return jsround(x).cast("long")


def ctr_pct(ctr: Column) -> Column:
    """A fraction as percent with two places."""
    return F.floor(ctr * 10000.0 + 0.5) / 100.0


def pos1(position: Column) -> Column:
    return jsround(position, 1)


def pct_change(old: Column, new: Column) -> Column:
    """C17: percent to one place; NULL where the old value is 0 or missing."""
    change = (new.cast("double") - old.cast("double")) / F.nullif(old.cast("double"), F.lit(0.0))
    return F.floor(change * 1000.0 + 0.5) / 10.0
