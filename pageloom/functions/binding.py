"""Values that an expression reads several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` reads it; keeps plans of nested functions small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
