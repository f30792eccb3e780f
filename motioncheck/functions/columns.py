"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a requirement states must hold.
OPERATORS = ("greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal")


def holds(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether a value meets an operator's threshold; NaN meets none, infinity compares."""
    met = F.when(operator == "greater_than", value > threshold).when(operator == "greater_than_or_equal", value >= threshold).when(operator == "less_than", value < threshold).when(operator == "less_than_or_equal", value <= threshold)
    return F.when(F.isnan(value), False).otherwise(met)


def wrapped_angle(x: Column) -> Column:
    """An angle in [-pi, pi], by whole turns; what is in range stays as it is."""
    turn = F.lit(2 * math.pi)
    return F.when((x >= -math.pi) & (x <= math.pi), x).otherwise(x - turn * F.floor((x + math.pi) / turn))


def time_key(x: Column) -> Column:
    """A time in whole microseconds, to join instants by."""
    return F.round(x * 1e6).cast("long")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def r6(x: Column) -> Column:
    """To six decimals as SQL's round() does with doubles: half away from zero of x * 1e6; null, NaN and infinity stay.

    F.round takes the shortest decimal of x instead, which is on the other side for some x beside a half.
    """
    y = F.abs(x) * 1e6
    whole = F.when(y < 2.0**52, F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)).otherwise(y)  # larger ones are whole
    return F.when(F.isnan(x) | (y == float("inf")), x).otherwise(F.signum(x) * whole / 1e6)


def status(passed: Column) -> Column:
    return F.when(passed.isNull(), "NOT_APPLICABLE").when(passed, "PASS").otherwise("FAIL")
