"""Expressions that are evaluated once however often their value is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Catalyst repeats an expression at each place that refers to it within a conditional
    or a filter; a lambda variable holds the computed value instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_if(value: Column, keep: Callable[[Column], Column]) -> Column:
    """A generator that gives the value, computed once, of rows where ``keep`` holds.

    A plain filter on a computed column is pushed below the projection and then computes
    the column twice.
    """
    return F.explode(F.filter(F.array(value), keep))
