"""Regression of a candidate's results against a baseline's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncheck.functions.columns import status


@dataclass(frozen=True)
class RegressionPolicy:
    max_new_failures: int = 0
    fail_on_missing_candidate_scenarios: bool = True
    fail_on_lost_applicability: bool = True

    def __post_init__(self) -> None:
        if self.max_new_failures < 0:
            raise ValueError("max_new_failures must be nonnegative")


def transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(scenario_id, req_ord, requirement_id, statuses and failed samples of both, classification) of scenarios in both results."""
    failed = lambda df: F.col("failed_samples") if "failed_samples" in df.columns else F.lit(None).cast("long")
    b = baseline.select("scenario_id", "req_ord", "requirement_id", status(F.col("passed")).alias("baseline_status"), failed(baseline).alias("baseline_failed_samples"))
    c = candidate.select("scenario_id", "req_ord", status(F.col("passed")).alias("candidate_status"), failed(candidate).alias("candidate_failed_samples"))
    was, now = F.col("baseline_status"), F.col("candidate_status")
    kind = F.when(was == now, F.concat(F.lit("UNCHANGED_"), was)).when(now == "FAIL", "NEW_FAILURE").when((was == "FAIL") & (now == "PASS"), "RESOLVED").when(now == "NOT_APPLICABLE", "LOST_APPLICABILITY").otherwise("NEWLY_APPLICABLE_PASS")
    return b.join(c, ["scenario_id", "req_ord"]).withColumn("classification", kind)


def scenario_regressions(transitions: DataFrame) -> DataFrame:
    worse, better = F.col("classification").isin("NEW_FAILURE", "LOST_APPLICABILITY"), F.col("classification") == "RESOLVED"
    kind = F.when(F.bool_or(worse), "REGRESSED").when(F.bool_or(better), "IMPROVED").otherwise("UNCHANGED")
    return transitions.groupBy("scenario_id").agg(kind.alias("status"))


def missing_added(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(scenario_id, kind) of scenarios that one side lacks."""
    b, c = baseline.select("scenario_id").distinct(), candidate.select("scenario_id").distinct()
    return b.join(c, "scenario_id", "left_anti").withColumn("kind", F.lit("missing")).union(c.join(b, "scenario_id", "left_anti").withColumn("kind", F.lit("added")))


def common(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select("scenario_id").intersect(candidate.select("scenario_id"))


def gate(transitions: DataFrame, changes: DataFrame, policy: RegressionPolicy = RegressionPolicy()) -> DataFrame:
    """One row: counts of what changed, and whether the policy lets it pass."""
    kind = F.col("classification")
    counted = transitions.agg(F.count_if(kind == "NEW_FAILURE").alias("new_failures"), F.count_if(kind == "RESOLVED").alias("resolved_failures"), F.count_if(kind == "LOST_APPLICABILITY").alias("lost_applicability"))
    sets = changes.agg(F.count_if(F.col("kind") == "missing").alias("missing_candidate_scenarios"), F.count_if(F.col("kind") == "added").alias("added_candidate_scenarios"))
    bad = F.col("new_failures") > policy.max_new_failures
    if policy.fail_on_missing_candidate_scenarios:
        bad = bad | (F.col("missing_candidate_scenarios") > 0)
    if policy.fail_on_lost_applicability:
        bad = bad | (F.col("lost_applicability") > 0)
    return counted.crossJoin(F.broadcast(sets)).withColumn("gate_passed", ~bad)  # one row each
