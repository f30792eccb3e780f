"""Motion tables derived from the tables events, nation, region and embeddings.

Recorded states come from the events of a user, ten users to a scenario; lanes, crosswalks,
stop signs and signals from nations and regions. Coordinates are on a grid of eighths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = 91
#: Keys of the table nation are below this, so signals of a step have numbers of their own.
NATIONS = 25
SCENARIO = F.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, agent_id, object_type, track_ord, state_ord, event_id, time_s, x_m, y_m)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    track = F.col("user_id") % 10
    kind = F.when(track == 8, "pedestrian").when(track == 9, "cyclist").otherwise("vehicle")
    return events.withColumn("rn", rn).select(
        F.concat(F.lit("s"), F.floor(F.col("user_id") / 10).cast("string")).alias("scenario_id"),
        F.col("user_id").cast("string").alias("agent_id"),
        kind.alias("object_type"),
        track.cast("long").alias("track_ord"),
        F.col("rn").cast("long").alias("state_ord"),
        "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("micros"),
        (F.col("rn") / 10.0).alias("time_s"),
        (F.col("rn") + F.floor("value") / 8.0).alias("x_m"),
        (4.0 * track + (F.col("event_id") % 16) / 8.0).alias("y_m"),
    )


def states_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """states with real gaps in time."""
    own = states(spark, sf_dir)
    first = own.agg(F.min("micros").alias("first"))
    return own.crossJoin(F.broadcast(first)).withColumn("time_s", (F.col("micros") - F.col("first")) / 1e6).drop("first")  # one row


def states_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate run: some positions shifted, scenario s1 missing, scenario s0 again as `extra`."""
    own = states(spark, sf_dir)
    moved = own.withColumn("x_m", F.when(F.col("event_id") % 5 == 0, F.col("x_m") + 40.0).otherwise(F.col("x_m")))
    extra = moved.where("scenario_id = 's0'").withColumn("scenario_id", F.lit("extra"))
    return moved.where("scenario_id <> 's1'").union(extra)


def scenarios(states: DataFrame) -> DataFrame:
    """A row per scenario, with its roles and its timeline of STEPS steps of 0.1 s.

    Tracks are told apart first, so lists are collected of a few rows a scenario and not of all states.
    """
    states = states.select("scenario_id", "track_ord", "agent_id").distinct()
    by_track = lambda tracks: F.transform(F.filter(F.sort_array(F.collect_set(F.struct("track_ord", "agent_id"))), lambda s: s["track_ord"].isin(*tracks)), lambda s: s["agent_id"])
    return states.groupBy("scenario_id").agg(
        F.lit(10).alias("current_time_index"),
        F.min(F.when(F.col("track_ord") == 0, F.col("agent_id"))).alias("sdc_agent_id"),
        by_track((1, 2, 8, 9)).alias("tracks_to_predict"),
        by_track((3,)).alias("objects_of_interest"),
        F.lit(0).alias("map_feature_count"),
    ).withColumn("timestamps_s", F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: k / 10.0))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_ord, feature_id, points): the same lanes in each scenario."""
    k = F.col("n_nationkey").cast("long")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x_m"), y.cast("double").alias("y_m"))
    return table(spark, sf_dir, "nation").select(k.alias("lane_ord"), k.cast("string").alias("feature_id"), F.array(point(0, 4 * k), point(64, 4 * k + 1), point(160, 4 * k)).alias("points"))


def crosswalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cw_ord, points): rectangles across the lanes."""
    r = F.col("r_regionkey").cast("double")
    point = lambda x, y: F.struct(x.alias("x_m"), F.lit(float(y)).alias("y_m"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("cw_ord"), F.array(point(10 + 20 * r, 0), point(12 + 20 * r, 0), point(12 + 20 * r, 40), point(10 + 20 * r, 40)).alias("points"))


def stop_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sign_ord, lane_id, x_m, y_m)."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("sign_ord"), k.cast("string").alias("lane_id"), F.lit(30.0).alias("x_m"), (4 * k + 0.5).cast("double").alias("y_m"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_ord, time_s, lane_id, state, x_m, y_m), step by step."""
    k = F.col("n_nationkey").cast("long")
    steps = table(spark, sf_dir, "nation").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    state = F.when((F.floor(F.col("step") / 10) + k) % 3 == 0, "stop").otherwise("go")
    return steps.select((F.col("step") * NATIONS + k).alias("signal_ord"), (F.col("step") / 10.0).alias("time_s"), k.cast("string").alias("lane_id"), state.alias("state"), F.lit(48.0).alias("x_m"), (4 * k + 0.75).cast("double").alias("y_m"))


#: Requirements: id, metric, operator, threshold, subject, other. Some pass, some fail, some don't apply.
REQUIREMENTS = (
    ("speed_limit", "speed", "less_than_or_equal", 200.0, "@sdc", None),
    ("moving", "speed", "greater_than", -1.0, "@prediction:-1", None),
    ("gentle", "acceleration", "less_than_or_equal", 900.0, "@prediction:0", None),
    ("smooth", "jerk", "less_than", 20000.0, "@object_of_interest:0", None),
    ("apart", "separation", "greater_than_or_equal", 10.0, "@sdc", "@prediction:0"),
    ("no_collision", "time_to_collision", "greater_than_or_equal", 0.05, "@sdc", "@prediction:1"),
    ("in_lane", "lane_lateral_offset", "less_than_or_equal", 1.5, "@sdc", None),
    ("off_crosswalk", "crosswalk_proximity", "greater_than", 0.0, "@prediction:2", None),
    ("mind_vru", "vru_crosswalk_proximity", "greater_than_or_equal", 8.0, "@sdc", None),
    ("red_light", "red_stop_line_violation", "less_than_or_equal", 0.0, "@sdc", None),
    ("full_stop", "stop_sign_crossing_speed", "less_than_or_equal", 300.0, "@sdc", None),
)

REQUIREMENT = "req_ord long, requirement_id string, metric string, operator string, threshold double, subject string, other string"


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REQUIREMENTS)], REQUIREMENT)
