"""Small helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often then() names it."""
    return F.get(F.transform(F.array(value), then), 0)


def strings(*items: Column) -> Column:
    """An array of those texts that are not null."""
    return F.array_compact(F.array(*items)).cast("array<string>")
