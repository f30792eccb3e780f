"""Scores of forecasts: errors, agents, scenarios, strata, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncheck.functions.columns import distance, time_key

AGENT = ("scenario_id", "agent_id")


def point_errors(points: DataFrame, states: DataFrame) -> DataFrame:
    """Each predicted point's distance to the recorded state at its time; the last state of a time counts, others are skipped."""
    truth = states.select(*AGENT, time_key(F.col("time_s")).alias("t"), "state_ord", "x_m", "y_m").groupBy(*AGENT, "t").agg(F.max(F.struct("state_ord", "x_m", "y_m")).alias("truth"))
    joined = points.withColumn("t", time_key(F.col("time_s"))).join(truth, [*AGENT, "t"])
    return joined.withColumn("error_m", distance(F.col("x_m"), F.col("y_m"), F.col("truth.x_m"), F.col("truth.y_m"))).drop("truth", "t")


def mode_errors(errors: DataFrame) -> DataFrame:
    """(agent, mode_index, ade_m, fde_m, evaluated_points): fde is the last aligned point's error.

    Errors are summed in the points' order, however a shuffle deals the rows: modes with the same
    points have the same mean to the last bit, so they tie.
    """
    along = F.array_sort(F.collect_list(F.struct("point_ord", "error_m")))  # the points of one mode
    total = F.aggregate(along, F.lit(0.0), lambda n, p: n + F.coalesce(p["error_m"], F.lit(0.0)))
    return errors.groupBy(*AGENT, "mode_index").agg(F.try_divide(total, F.count("error_m")).alias("ade_m"), F.max(F.struct("point_ord", "error_m"))["error_m"].alias("fde_m"), F.count("*").alias("evaluated_points"))


def agent_scores(points: DataFrame, states: DataFrame, miss_threshold_m: float = 2.0) -> DataFrame:
    """A row per agent: the best mode by ADE (first on ties), the least FDE of any mode, a miss beyond the threshold, coverage."""
    if miss_threshold_m < 0:
        raise ValueError("miss_threshold_m must be nonnegative")
    modes = mode_errors(point_errors(points, states))
    best = modes.groupBy(*AGENT).agg(F.min(F.struct("ade_m", "mode_index", "evaluated_points")).alias("best"), F.min("fde_m").alias("min_fde_m"), F.count("*").alias("modes"))
    # the first mode's points
    expected = points.groupBy(*AGENT, "mode_index").agg(F.count("*").alias("n")).groupBy(*AGENT).agg(F.min(F.struct("mode_index", "n"))["n"].alias("expected_points"))
    kinds = states.groupBy(*AGENT).agg(F.first("object_type").alias("object_type"))
    found = best.join(expected, list(AGENT)).join(kinds, list(AGENT))
    return found.select(*AGENT, "object_type", "modes", F.col("best.evaluated_points").alias("evaluated_points"), "expected_points", F.col("best.ade_m").alias("min_ade_m"), "min_fde_m", (F.col("min_fde_m") > miss_threshold_m).alias("miss"), F.col("best.mode_index").alias("best_mode_index"), (F.col("best.evaluated_points") / F.col("expected_points")).alias("ground_truth_coverage"))


def means(scores: DataFrame, *by: str) -> DataFrame:
    """Agents and their means, overall or by columns."""
    figures = [F.count("*").alias("agents"), F.avg("min_ade_m").alias("mean_min_ade_m"), F.avg("min_fde_m").alias("mean_min_fde_m"), F.avg(F.col("miss").cast("double")).alias("miss_rate"), F.avg("ground_truth_coverage").alias("mean_ground_truth_coverage")]
    return scores.groupBy(*by).agg(*figures)


def best_mode_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("best_mode_index").agg(F.count("*").alias("agents"))


def worst_agents(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("min_ade_m"), "scenario_id", "agent_id").limit(k)
