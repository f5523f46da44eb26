"""Sums that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(38,12)"


def exact_sum(value: Column) -> Column:
    """Sum as double: added as decimals where every value is one of 12 places and the total fits, else as doubles."""
    number, decimal = value.cast("double"), value.try_cast(_EXACT)
    fits = F.bool_and(value.isNull() | F.coalesce(decimal.cast("double") == number, F.lit(False)))
    return F.when(fits, F.coalesce(F.try_sum(decimal).cast("double"), F.sum(number))).otherwise(F.sum(number))
