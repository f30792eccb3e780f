"""JSON files: scenarios, manifests, requirements, external predictions, evaluation reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck import schema
from motioncheck.sources import parted


def read_scenarios(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One nested row per file, in schema.SCENARIO; unknown keys are ignored, missing ones get defaults."""
    own = spark.read.schema(schema.SCENARIO).json(paths, multiLine=True)
    named = F.transform("tracks", lambda t: t.withField("object_type", F.coalesce(t["object_type"], F.lit("unknown"))))
    return own.withColumns(
        {
            "tracks": named,
            "sdc_agent_id": F.nullif("sdc_agent_id", F.lit("")),
            "objects_of_interest": F.coalesce("objects_of_interest", F.array().cast("array<string>")),
            "tracks_to_predict": F.coalesce("tracks_to_predict", F.array().cast("array<string>")),
            "map_feature_count": F.coalesce("map_feature_count", F.lit(0)),
        }
    )


def manifest_paths(manifest: str) -> list[str]:
    """The files that a manifest names, relative to it."""
    listed = json.loads(Path(manifest).read_text())["scenarios"]
    if not isinstance(listed, list) or not listed:
        raise ValueError("a manifest needs a non-empty list of scenarios")
    return [str(Path(manifest).parent / p) for p in listed]


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    found = read_scenarios(spark, manifest_paths(manifest))
    if repeated := [r.scenario_id for r in duplicates(found).limit(5).collect()]:
        raise ValueError(f"scenario ids appear more than once: {', '.join(repeated)}")
    return found


def duplicates(scenarios: DataFrame) -> DataFrame:
    return scenarios.groupBy("scenario_id").agg(F.count("*").alias("n")).where("n > 1").select("scenario_id")


def states_of(scenarios: DataFrame) -> DataFrame:
    """A row per state of nested scenarios, with the order of tracks and states."""
    tracks = scenarios.select("scenario_id", F.posexplode("tracks").alias("track_ord", "track"))
    found = tracks.select("scenario_id", "track.agent_id", "track.object_type", F.col("track_ord").cast("long").alias("track_ord"), F.posexplode("track.states").alias("state_ord", "state"))
    return found.select("scenario_id", "agent_id", "object_type", "track_ord", F.col("state_ord").cast("long").alias("state_ord"), "state.*")


def map_tables(scenarios: DataFrame) -> dict[str, DataFrame]:
    """lanes, crosswalks, signs and signals of nested scenarios that hold their map; a sign is a row per lane."""
    each = lambda column, order: scenarios.select("scenario_id", F.posexplode(column).alias(order, "f"))
    long = lambda c: F.col(c).cast("long").alias(c)
    signs = each("stop_signs", "at").select("scenario_id", "at", "f", F.posexplode("f.lane_ids").alias("nth", "lane_id"))
    return {
        "lanes": each("lanes", "lane_ord").select("scenario_id", long("lane_ord"), "f.feature_id", "f.points"),
        "crosswalks": each("crosswalks", "cw_ord").select("scenario_id", long("cw_ord"), "f.points"),
        "signs": signs.select("scenario_id", (F.col("at").cast("long") * (1 << 31) + F.col("nth")).alias("sign_ord"), "lane_id", "f.position.x_m", "f.position.y_m"),
        "signals": each("signals", "signal_ord").select("scenario_id", long("signal_ord"), "f.time_s", "f.lane_id", "f.state", "f.stop_point.x_m", "f.stop_point.y_m"),
    }


def timelines(scenarios: DataFrame) -> DataFrame:
    """scenarios with a timeline: their own, or the times of the track with most states, the first on ties."""
    longest = F.array_max(F.transform("tracks", lambda t, i: F.struct(F.size(t["states"]).alias("n"), (-i).alias("at"))))
    own = F.transform(F.get(F.transform("tracks", lambda t: t["states"]), -longest["at"]), lambda s: s["time_s"])
    return scenarios.withColumn("timestamps_s", F.when(F.size("timestamps_s") > 0, F.col("timestamps_s")).otherwise(own))


def faults(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, problem) of scenarios that break a rule of the model."""
    rising = lambda times: ~F.exists(F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b <= a), lambda x: x)
    ids = F.transform("tracks", lambda t: t["agent_id"])
    times = F.transform("tracks", lambda t: F.transform(t["states"], lambda s: s["time_s"]))
    problems = F.array(
        F.when(F.coalesce("scenario_id", F.lit("")) == "", "empty scenario id"),
        F.when(F.exists(ids, lambda a: F.coalesce(a, F.lit("")) == ""), "empty agent id"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated agent id"),
        F.when(F.exists(times, lambda t: F.size(t) == 0), "track without states"),
        F.when(F.exists(times, lambda t: ~rising(t)), "state times do not increase"),
        F.when(F.col("current_time_index") < 0, "negative current time index"),
        F.when(F.coalesce(~rising(F.col("timestamps_s")), F.lit(False)), "timeline does not increase"),
    )
    return scenarios.select("scenario_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """(req_ord, requirement_id, metric, operator, threshold, subject, other, description, units)."""
    found = spark.read.schema(schema.REQUIREMENTS).json(path, multiLine=True).select(F.posexplode("requirements").alias("req_ord", "r"))
    return found.select(F.col("req_ord").cast("long").alias("req_ord"), F.col("r.id").alias("requirement_id"), "r.metric", "r.operator", "r.threshold", F.col("r.subject_agent_id").alias("subject"), F.nullif("r.other_agent_id", F.lit("")).alias("other"), "r.description", "r.units")


def read_external(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The provenance (unchecked), and points (scenario_id, agent_id, mode_index, point_ord, confidence, x_m, y_m)."""
    own = spark.read.schema(schema.EXTERNAL).json(path, multiLine=True)
    head = own.select("schema_version", "provenance").first()
    if head is None or head.schema_version != 1:
        raise ValueError("schema_version must be 1")
    agents = own.select(F.explode("predictions").alias("p")).select("p.scenario_id", F.explode("p.agents").alias("a"))
    modes = agents.select("scenario_id", "a.agent_id", F.posexplode("a.modes").alias("mode_index", "m"))
    points = modes.select("scenario_id", "agent_id", "mode_index", F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), F.posexplode("m.xy_m").alias("point_ord", "xy"))
    return (head.provenance.asDict() if head.provenance else {}), points.select("scenario_id", "agent_id", "mode_index", "point_ord", "confidence", F.get("xy", F.lit(0)).alias("x_m"), F.get("xy", F.lit(1)).alias("y_m"))


SCORES = "scenario_id string, agent_id string, object_type string, min_ade_m double, min_fde_m double, miss boolean, best_mode_index int"
MEANS = "mean_min_ade_m: double, mean_min_fde_m: double, miss_rate: double, mean_ground_truth_coverage: double"
AGENTS = "agent_id: string, object_type: string, min_ade_m: double, min_fde_m: double, miss: boolean, best_mode_index: int"
REPORT = f"summary struct<{MEANS}>, scenarios array<struct<scenario_id: string, agents: array<struct<{AGENTS}>>>>, parts struct<folder: string, rows: long>"


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An evaluation report's summary row, as it says, and its agents' scores: its own, or those of the folder that it names."""
    own = spark.read.schema(REPORT).json(path, multiLine=True)
    if parts := own.select("parts.*").where("folder is not null").first():
        return own.select("summary.*"), parted.read(spark, parts.asDict(), SCORES)
    agents = own.select(F.explode("scenarios").alias("s")).select("s.scenario_id", F.explode("s.agents").alias("a")).select("scenario_id", "a.*")
    return own.select("summary.*"), agents
