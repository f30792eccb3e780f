"""Kinematic and pairwise signals: samples (scenario_id, agent_id[, other_id], sample_ord, time_s, value).

All are windows over one partitioning by scenario and agent, or equi-joins by scenario and time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motioncheck.functions.columns import distance

TRACK = ("scenario_id", "agent_id")
PAIR = ("scenario_id", "agent_id", "other_id")


def _along(keys: tuple[str, ...], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def derivative(samples: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """Change of value per second, at the later sample."""
    w = _along(keys, "sample_ord")
    step = (F.col("value") - F.lag("value").over(w)) / (F.col("time_s") - F.lag("time_s").over(w))
    return samples.withColumn("value", step).where("value is not null")


def kinematics(states: DataFrame) -> DataFrame:
    """speed, acceleration and jerk of each state, null where there are too few before it: windows over one sort.

    Displacement per second between consecutive states, at the later one; reported velocities don't count.
    """
    w = _along(TRACK, "state_ord")
    gap = F.col("time_s") - F.lag("time_s").over(w)
    moved = F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)) / gap
    found = states.select(*TRACK, "state_ord", "time_s", moved.alias("speed"))
    for name, of in (("acceleration", "speed"), ("jerk", "acceleration")):
        found = found.withColumn(name, (F.col(of) - F.lag(of).over(w)) / gap)
    return found.withColumnRenamed("state_ord", "sample_ord")


def _one(found: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    return found.select(*keys, "sample_ord", "time_s", F.col(name).alias("value")).where("value is not null")


def speed(states: DataFrame) -> DataFrame:
    return _one(kinematics(states), "speed", TRACK)


def acceleration(states: DataFrame) -> DataFrame:
    return _one(kinematics(states), "acceleration", TRACK)


def jerk(states: DataFrame) -> DataFrame:
    return _one(kinematics(states), "jerk", TRACK)


def aligned_pairs(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """States of pairs (scenario_id, agent_id, other_id) at exactly equal times, in the subject's order."""
    subject = states.select(*TRACK, F.col("state_ord").alias("sample_ord"), "time_s", "x_m", "y_m")
    other = states.select("scenario_id", F.col("agent_id").alias("other_id"), "time_s", F.col("x_m").alias("other_x_m"), F.col("y_m").alias("other_y_m"))
    return subject.join(pairs.distinct(), list(TRACK)).join(other, ["scenario_id", "other_id", "time_s"])


def paired(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """separation, closing_speed and time_to_collision of pairs at equal times; the last two null at the first.

    Time to collision is separation over closing speed, and infinite when not closing.
    """
    apart = distance(F.col("x_m"), F.col("y_m"), F.col("other_x_m"), F.col("other_y_m"))
    found = aligned_pairs(states, pairs).select(*PAIR, "sample_ord", "time_s", apart.alias("separation"))
    w = _along(PAIR, "sample_ord")
    closing = -(F.col("separation") - F.lag("separation").over(w)) / (F.col("time_s") - F.lag("time_s").over(w))
    found = found.withColumn("closing_speed", closing)
    left = F.when(F.col("closing_speed") > 0, F.col("separation") / F.col("closing_speed")).when(F.col("closing_speed").isNotNull(), float("inf"))
    return found.withColumn("time_to_collision", left)


def separation(states: DataFrame, pairs: DataFrame) -> DataFrame:
    return _one(paired(states, pairs), "separation", PAIR)


def closing_speed(states: DataFrame, pairs: DataFrame) -> DataFrame:
    return _one(paired(states, pairs), "closing_speed", PAIR)


def time_to_collision(states: DataFrame, pairs: DataFrame) -> DataFrame:
    return _one(paired(states, pairs), "time_to_collision", PAIR)


def misaligned(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with fewer than two equal times, which signals of a pair need."""
    n = aligned_pairs(states, pairs).groupBy(*PAIR).agg(F.count("*").alias("n"))
    return pairs.distinct().join(n, list(PAIR), "left").where(F.coalesce("n", F.lit(0)) < 2).select(*PAIR)
