"""Values that are computed once, however often a recipe reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, as an array's only element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def filled(text: Column) -> Column:
    """A text that is computed once; null if it is empty."""
    return F.get(F.filter(F.array(text), lambda v: v != ""), F.lit(0))
