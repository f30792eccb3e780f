"""Predictions of other models: validation, confidences, the submission's single precision."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES, POINTS = 6, 16
MODE = ("scenario_id", "agent_id", "mode_index")

#: What a provenance names.
PROVENANCE = ("model_name", "model_version", "source_repository", "source_revision", "checkpoint_sha256", "coordinate_frame", "future_data_used")


def check_provenance(provenance: Mapping[str, object]) -> dict[str, object]:
    """The provenance with texts stripped; ValueError says what is wrong with it."""
    if missing := [k for k in PROVENANCE if k not in provenance]:
        raise ValueError(f"provenance lacks {', '.join(missing)}")
    found: dict[str, object] = {}
    for key in PROVENANCE[:-1]:
        value = provenance[key]
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"provenance {key} must be a non-blank text")
        found[key] = value.strip()
    if not re.fullmatch("[0-9a-f]{64}", str(found["checkpoint_sha256"])):
        raise ValueError("provenance checkpoint_sha256 must be 64 lower-case hex digits")
    if found["coordinate_frame"] != "scenario_global":
        raise ValueError("provenance coordinate_frame must be scenario_global")
    if provenance["future_data_used"] is not False:
        raise ValueError("provenance future_data_used must be false")
    return found | {"future_data_used": False}


def invalid_modes(points: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, reason): agents whose modes aren't 1 to 6 of 16 finite points with finite nonnegative confidences."""
    inf = float("inf")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == inf)
    modes = points.groupBy(*MODE).agg(F.count("*").alias("n"), F.bool_or(odd("x_m") | odd("y_m")).alias("odd"), F.bool_or(odd("confidence") | (F.col("confidence") < 0)).alias("unsure"))
    agents = modes.groupBy("scenario_id", "agent_id").agg(F.count("*").alias("modes"), F.bool_or(F.col("n") != POINTS).alias("short"), F.bool_or("odd").alias("odd"), F.bool_or("unsure").alias("unsure"))
    reason = F.when(F.col("modes") > MODES, "modes").when(F.col("short"), "points").when(F.col("odd"), "coordinates").when(F.col("unsure"), "confidence")
    return agents.select("scenario_id", "agent_id", reason.alias("reason")).where("reason is not null")


def normalized_confidence(modes: DataFrame) -> DataFrame:
    """modes (scenario_id, agent_id, mode_index, confidence) with confidences that sum to 1 for each agent; null where they sum to 0."""
    total = F.sum("confidence").over(Window.partitionBy("scenario_id", "agent_id"))
    return modes.withColumn("total", total).withColumn("confidence", F.when(F.col("total") > 0, F.col("confidence") / F.nullif(F.col("total"), F.lit(0.0)))).drop("total")


def population_differences(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, problem): agents that are predicted but no targets, or targets that aren't predicted."""
    p, t = points.select("scenario_id", "agent_id").distinct(), targets.select("scenario_id", "agent_id").distinct()
    return p.join(t, ["scenario_id", "agent_id"], "left_anti").withColumn("problem", F.lit("unexpected")).union(t.join(p, ["scenario_id", "agent_id"], "left_anti").withColumn("problem", F.lit("missing")))


def submitted(points: DataFrame) -> DataFrame:
    """points as a submission holds them: six modes at most, in single precision."""
    return points.where(F.col("mode_index") < MODES).select("scenario_id", "agent_id", "mode_index", "point_ord", *[F.col(c).cast("float").cast("double").alias(c) for c in ("confidence", "x_m", "y_m")])


def with_times(points: DataFrame, scenarios: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """points with the times of the scenario's timeline at their steps."""
    times = scenarios.select("scenario_id", F.posexplode(F.array(*[F.get("timestamps_s", F.lit(s)) for s in steps])).alias("point_ord", "time_s"))
    return points.join(times, ["scenario_id", "point_ord"])
