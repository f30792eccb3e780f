"""Evidence: quality annotations, sensitivity, confidence and a scenario's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncheck.functions.columns import holds, status
from motioncheck.operators.requirements import REQ

QUALITY = ("scenario_id", "code", "severity", "agent_ids", "message")
#: What each annotation says.
MESSAGES = {
    "INSUFFICIENT_TRACK_SAMPLES": "Some tracks contain fewer than two valid states and cannot support derived metrics.",
    "IRREGULAR_SAMPLING": "One or more tracks contain time gaps greater than 1.5 times their median step.",
    "PARTIAL_REPORTED_VELOCITY": "Reported velocity is incomplete; position-derived kinematics remain available.",
    "NO_MAP_FEATURES": "No map features are attached; map-aware requirements are not applicable.",
}


def _annotation(tracks: DataFrame, code: str, severity: str) -> DataFrame:
    """An annotation with the agents of (scenario_id, track_ord, agent_id), in the tracks' order."""
    agents = F.transform(F.sort_array(F.collect_list(F.struct("track_ord", "agent_id"))), lambda s: s["agent_id"])
    return tracks.groupBy("scenario_id").agg(agents.alias("agent_ids")).select("scenario_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "agent_ids", F.lit(MESSAGES[code]).alias("message"))


def _of_scenario(scenarios: DataFrame, code: str) -> DataFrame:
    """An annotation that names no agents."""
    return scenarios.select("scenario_id", F.lit(code).alias("code"), F.lit("info").alias("severity"), F.array().cast("array<string>").alias("agent_ids"), F.lit(MESSAGES[code]).alias("message"))


def sampling_steps(states: DataFrame) -> DataFrame:
    """(scenario_id, track_ord, agent_id, n_states, steps, longest, median) per track."""
    w = Window.partitionBy("scenario_id", "agent_id").orderBy("state_ord")
    step = states.withColumn("step", F.col("time_s") - F.lag("time_s").over(w))
    return step.groupBy("scenario_id", "track_ord", "agent_id").agg(F.count("*").alias("n_states"), F.count("step").alias("steps"), F.max("step").alias("longest"), F.median("step").alias("median"))


def quality(states: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, code, severity, agent_ids, message): short tracks, irregular sampling, partial velocities, no map.

    The last two name no agents. Velocities are partial where any state lacks one of its two.
    """
    tracks = sampling_steps(states)
    short = _annotation(tracks.where("n_states < 2"), "INSUFFICIENT_TRACK_SAMPLES", "error")
    irregular = _annotation(tracks.where("steps >= 2 and longest > 1.5 * median"), "IRREGULAR_SAMPLING", "warning")
    found = short.union(irregular).union(_of_scenario(scenarios.where("map_feature_count = 0"), "NO_MAP_FEATURES"))
    if {"velocity_x_mps", "velocity_y_mps"} <= set(states.columns):
        states = states.where(F.col("velocity_x_mps").isNull() | F.col("velocity_y_mps").isNull())
    return found.union(_of_scenario(states.select("scenario_id").distinct(), "PARTIAL_REPORTED_VELOCITY"))


def relevant(resolved: DataFrame, quality: DataFrame) -> DataFrame:
    """(scenario_id, req_ord, code, severity, agent_ids, message): annotations without agents, or with the requirement's."""
    named = resolved.select(*REQ, F.filter(F.array("agent_id", "other_id"), lambda a: a.isNotNull()).alias("named"))
    return named.join(quality, "scenario_id").where((F.size("agent_ids") == 0) | F.arrays_overlap("agent_ids", "named")).drop("named")


#: How far from a requirement's threshold the swept ones are, in shares of it, or as they are where it is zero.
OFFSETS = (-0.1, 0.0, 0.1)


def swept(threshold: Column, offset: float) -> Column:
    return threshold + offset * F.when(threshold == 0, 1.0).otherwise(F.abs(threshold))


def sensitivity(judged: DataFrame, resolved: DataFrame, results: DataFrame, offsets: tuple[float, ...] = OFFSETS) -> DataFrame:
    """(scenario_id, req_ord, threshold, passed, failed_samples, failed_fraction) for each swept threshold where the requirement applies.

    Each judged sample is read once, for however many thresholds: they are counted side by side in
    one aggregation, which leaves a row per requirement before anything is joined.
    """
    failed = [F.count_if(~holds(F.col("value"), F.col("operator"), swept(F.col("threshold"), o))).alias(f"failed_{i}") for i, o in enumerate(offsets)]
    counted = judged.groupBy(*REQ).agg(F.count("value").alias("n"), *failed)
    own = resolved.select(*REQ, F.col("threshold").alias("stated")).join(results.where("applicable").select(*REQ), list(REQ)).join(counted, list(REQ), "left")
    each = F.array(*[F.struct(swept(F.col("stated"), o).alias("threshold"), F.coalesce(f"failed_{i}", F.lit(0)).alias("failed_samples")) for i, o in enumerate(offsets)])
    found = own.select(*REQ, F.coalesce("n", F.lit(0)).alias("n"), F.explode(each).alias("s")).select(*REQ, "n", "s.*")
    fraction = F.when(F.col("n") > 0, F.col("failed_samples") / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0)
    return found.select(*REQ, "threshold", (F.col("failed_samples") == 0).alias("passed"), "failed_samples", fraction.alias("failed_fraction"))


def explanations(intervals: DataFrame) -> DataFrame:
    """intervals with how far their worst value is from the threshold."""
    return intervals.withColumn("threshold_deviation", F.abs(F.col("worst_value") - F.col("threshold")))


def marks(resolved: DataFrame, quality: DataFrame) -> DataFrame:
    """(scenario_id, req_ord, error, warning, quality_annotations): of annotations without agents, or with the requirement's."""
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "code", "message"))), "; ")
    return relevant(resolved, quality).groupBy(*REQ).agg(F.bool_or(F.col("severity") == "error").alias("error"), F.bool_or(F.col("severity") == "warning").alias("warning"), listed.alias("quality_annotations"))


def confidence(results: DataFrame, resolved: DataFrame, quality: DataFrame) -> DataFrame:
    """(scenario_id, req_ord, requirement_id, grade): of annotations without agents, or with the requirement's."""
    return graded(results, marks(resolved, quality)).select(*REQ, "requirement_id", "evidence_confidence")


def graded(results: DataFrame, marks: DataFrame) -> DataFrame:
    """results with evidence_confidence and quality_annotations, of marks()."""
    n = F.col("evaluated_samples")
    grade = F.when(~F.col("applicable"), "not_applicable").when((n < 2) | F.coalesce("error", F.lit(False)), "low").when((n < 5) | F.coalesce("warning", F.lit(False)), "medium").otherwise("high")
    return results.join(marks, list(REQ), "left").withColumn("evidence_confidence", grade).drop("error", "warning")


def rollup(results: DataFrame) -> DataFrame:
    """A scenario's status: FAIL if anything fails, else NOT APPLICABLE if nothing applies, else PASS."""
    found = results.groupBy("scenario_id").agg(F.count_if(F.col("passed")).alias("passed_count"), F.count_if(F.col("applicable")).alias("applicable_count"), F.count("*").alias("total"), F.count_if(~F.col("passed")).alias("failed_count"))
    overall = F.when(F.col("failed_count") > 0, "FAIL").when(F.col("applicable_count") == 0, "NOT APPLICABLE").otherwise("PASS")
    return found.select("scenario_id", overall.alias("overall_status"), "passed_count", "applicable_count", "total")


def result_status(results: DataFrame) -> DataFrame:
    return results.select(*REQ, "requirement_id", status(F.col("passed")).alias("status"))
