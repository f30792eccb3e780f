"""Context that makes a forecast's error matter: density, separations, map, motion, tags and priority."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motioncheck.functions.columns import distance, time_key, wrapped_angle
from motioncheck.operators import geometry, grid
from motioncheck.sources.stored import stored

AGENT = ("scenario_id", "agent_id")


@dataclass(frozen=True)
class RiskThresholds:
    """Limits of the context."""

    close_interaction_m: float = 5.0
    dense_scene_agents: int = 10
    large_separation_error_m: float = 5.0
    crosswalk_context_m: float = 5.0
    control_context_m: float = 10.0
    stationary_displacement_m: float = 2.0
    turning_angle_rad: float = 0.35

    def __post_init__(self) -> None:
        lengths = (self.close_interaction_m, self.large_separation_error_m, self.crosswalk_context_m, self.control_context_m)
        if min(lengths) <= 0 or self.dense_scene_agents < 1 or self.stationary_displacement_m < 0 or not 0 < self.turning_angle_rad <= math.pi:
            raise ValueError("risk thresholds are out of range")


#: Other agents within this many metres count for density, a fixed value.
DENSITY_RADIUS = 30.0


def best_points(points: DataFrame, scores: DataFrame) -> DataFrame:
    """The predicted points of each agent's best mode, by time."""
    best = scores.select(*AGENT, F.col("best_mode_index").alias("mode_index"))
    return points.join(best, [*AGENT, "mode_index"]).select(*AGENT, "point_ord", time_key(F.col("time_s")).alias("t"), F.col("x_m").alias("predicted_x"), F.col("y_m").alias("predicted_y"))


def current_states(states: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's last state at or before its scenario's current time (targets: scenario_id, agent_id, current_time_s)."""
    own = states.join(targets.select(*AGENT, "current_time_s"), list(AGENT)).where(F.col("time_s") <= F.col("current_time_s") + 1e-6)
    last = own.groupBy(*AGENT).agg(F.max(F.struct("time_s", "state_ord", "x_m", "y_m", "current_time_s")).alias("s"))
    return last.select(*AGENT, F.col("s.current_time_s").alias("current_time_s"), F.col("s.state_ord").alias("state_ord"), F.col("s.x_m").alias("x_m"), F.col("s.y_m").alias("y_m"))


def future_states(states: DataFrame, best: DataFrame) -> DataFrame:
    """The targets' recorded states at the times of their best mode's points."""
    return states.withColumn("t", time_key(F.col("time_s"))).join(best.select(*AGENT, "t").distinct(), [*AGENT, "t"], "left_semi").select(*AGENT, "state_ord", "t", "time_s", "x_m", "y_m")


def _others(states: DataFrame) -> DataFrame:
    return states.select("scenario_id", F.col("agent_id").alias("other_id"), time_key(F.col("time_s")).alias("t"), F.col("x_m").alias("ox"), F.col("y_m").alias("oy"))


def scene_density(states: DataFrame, current: DataFrame, radius: float) -> DataFrame:
    """Other agents with a state at the current time within the radius."""
    own = current.select(*AGENT, time_key(F.col("current_time_s")).alias("t"), "x_m", "y_m")
    near = grid.neighbours(own, _others(states), ("scenario_id", "t"), radius).where(F.col("other_id") != F.col("agent_id"))
    held = near.groupBy(*AGENT).agg(F.count("*").alias("n"))
    return current.select(*AGENT).distinct().join(held, list(AGENT), "left").select(*AGENT, F.coalesce("n", F.lit(0)).alias("nearby_agents"))


def min_actor_separation(states: DataFrame, future: DataFrame, few: int = grid.FEW) -> DataFrame:
    """The least separation of an agent's future states from any other agent's at the same instant."""
    found = grid.least_separation(future, _others(states), ("scenario_id", "t"), AGENT, F.col("other_id") != F.col("agent_id"), few)
    return found.withColumnRenamed("separation_m", "min_actor_separation_m")


def sdc_interaction(states: DataFrame, scenarios: DataFrame, best: DataFrame) -> DataFrame:
    """Least actual separation from the SDC, and the largest error of the predicted one; none for the SDC itself."""
    sdc = states.join(scenarios.select("scenario_id", F.col("sdc_agent_id").alias("agent_id")), list(AGENT), "left_semi").select("scenario_id", F.col("agent_id").alias("sdc_id"), time_key(F.col("time_s")).alias("t"), F.col("x_m").alias("sx"), F.col("y_m").alias("sy"))
    own = states.select(*AGENT, time_key(F.col("time_s")).alias("t"), "x_m", "y_m")
    both = best.join(own, [*AGENT, "t"]).join(sdc, ["scenario_id", "t"]).where(F.col("sdc_id") != F.col("agent_id"))
    actual = distance(F.col("x_m"), F.col("y_m"), F.col("sx"), F.col("sy"))
    predicted = distance(F.col("predicted_x"), F.col("predicted_y"), F.col("sx"), F.col("sy"))
    return both.groupBy(*AGENT).agg(F.min(actual).alias("min_sdc_separation_m"), F.max(F.abs(predicted - actual)).alias("sdc_separation_error_m"))


def motion_class(current: DataFrame, future: DataFrame, thresholds: RiskThresholds) -> DataFrame:
    """stationary, turning or straight, by displacement and the change of bearing over steps longer than 0.1 m."""
    path = current.select(*AGENT, F.lit(-1).cast("long").alias("ord"), "x_m", "y_m").union(future.select(*AGENT, F.col("state_ord").alias("ord"), "x_m", "y_m"))
    w = Window.partitionBy(*AGENT).orderBy("ord")
    dx, dy = F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)
    step = path.withColumn("dx", dx).withColumn("dy", dy).withColumn("bearing", F.when(F.hypot("dx", "dy") > 0.1, F.atan2("dy", "dx")))
    seen = step.groupBy(*AGENT).agg(F.min(F.struct("ord", "x_m", "y_m")).alias("a"), F.max(F.struct("ord", "x_m", "y_m")).alias("z"), F.count("bearing").alias("bearings"), F.min_by("bearing", F.when(F.col("bearing").isNotNull(), F.col("ord"))).alias("first"), F.max_by("bearing", F.when(F.col("bearing").isNotNull(), F.col("ord"))).alias("last"))
    moved = distance(F.col("a.x_m"), F.col("a.y_m"), F.col("z.x_m"), F.col("z.y_m"))
    turns = (F.col("bearings") >= 2) & (F.abs(wrapped_angle(F.col("last") - F.col("first"))) >= thresholds.turning_angle_rad)
    return seen.select(*AGENT, moved.alias("displacement_m"), F.when(moved <= thresholds.stationary_displacement_m, "stationary").when(turns, "turning").otherwise("straight").alias("motion_class"))


def near_map(future: DataFrame, crosswalks: DataFrame, signs: DataFrame, signals: DataFrame, thresholds: RiskThresholds) -> DataFrame:
    """Whether any future state is near a crosswalk, or a stop sign's or any signal's stop point."""
    keys = (*AGENT, "state_ord")
    walk = geometry.polygons_within(future.select(*keys, "x_m", "y_m"), keys, crosswalks, thresholds.crosswalk_context_m).select(*AGENT, F.lit(True).alias("near_crosswalk")).distinct()
    own = geometry.scope(signs)
    stops = signs.select(*own, "x_m", "y_m").union(signals.select(*own, "x_m", "y_m")).distinct().toDF(*own, "ax", "ay")
    points = stops.withColumn("bx", F.col("ax")).withColumn("by", F.col("ay"))
    near = grid.near_segments(future.select(*keys, "x_m", "y_m"), points, own, thresholds.control_context_m)
    control = near.where(distance(F.col("x_m"), F.col("y_m"), F.col("ax"), F.col("ay")) <= thresholds.control_context_m).select(*AGENT, F.lit(True).alias("near_control")).distinct()
    return future.select(*AGENT).distinct().join(walk, list(AGENT), "left").join(control, list(AGENT), "left").select(*AGENT, F.coalesce("near_crosswalk", F.lit(False)).alias("near_crosswalk"), F.coalesce("near_control", F.lit(False)).alias("near_control"))


def map_context(states: DataFrame, points: DataFrame, scores: DataFrame, crosswalks: DataFrame, signs: DataFrame, signals: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """(agent, near_crosswalk, near_control) per scored agent, as evidence() has them, without its other parts; null without a future state."""
    best = stored(best_points(points, scores).select(*AGENT, "t"))  # read for the agents, and for the times
    future = stored(future_states(states, best))
    return best.select(*AGENT).distinct().join(near_map(future, crosswalks, signs, signals, thresholds), list(AGENT), "left")


def evidence(states: DataFrame, scenarios: DataFrame, targets: DataFrame, points: DataFrame, scores: DataFrame, crosswalks: DataFrame, signs: DataFrame, signals: DataFrame, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """A row per scored agent: its context, tags in order, and review priority."""
    # read by several parts
    scores, states = stored(scores), stored(states.select(*AGENT, "state_ord", "time_s", "x_m", "y_m"))
    best = stored(best_points(points, scores))
    current, future = stored(current_states(states, targets)), stored(future_states(states, best))
    found = scores
    for part in (scene_density(states, current, DENSITY_RADIUS), min_actor_separation(states, future), sdc_interaction(states, scenarios, best), motion_class(current, future, thresholds), near_map(future, crosswalks, signs, signals, thresholds)):
        found = found.join(part, list(AGENT), "left")
    close = F.coalesce(F.col("min_actor_separation_m") <= thresholds.close_interaction_m, F.lit(False))
    dense = F.col("nearby_agents") >= thresholds.dense_scene_agents
    off = F.coalesce(F.col("sdc_separation_error_m") >= thresholds.large_separation_error_m, F.lit(False))
    weak = F.col("object_type").isin("pedestrian", "cyclist")
    tags = F.filter(F.array(F.when(close, "close_interaction"), F.when(dense, "dense_scene"), F.when(off, "large_sdc_separation_error"), F.when(F.col("near_crosswalk"), "crosswalk_context"), F.when(F.col("near_control"), "traffic_control_context"), F.when(weak, "vulnerable_road_user")), lambda t: t.isNotNull())
    matters = close | off | F.col("near_crosswalk") | F.col("near_control")
    priority = F.when(F.col("miss") & matters, "high").when(F.col("miss") | matters, "medium").otherwise("low")
    return found.withColumn("risk_tags", tags).withColumn("review_priority", priority)


def identity(scenarios: DataFrame, points: DataFrame, scores: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, problem) where scenarios, forecasts and scores are not of the same scenarios and agents: an error of the input."""
    every, forecast, scored = (df.select(*names).distinct() for df, names in ((scenarios, ("scenario_id",)), (points, AGENT), (scores, AGENT)))
    found = None
    for a, b, on, problem in ((every, forecast, ["scenario_id"], "scenario without forecasts"), (every, scored, ["scenario_id"], "scenario without scores"), (forecast, every, ["scenario_id"], "forecast of an unknown scenario"), (forecast, scored, list(AGENT), "forecast without a score"), (scored, forecast, list(AGENT), "score without a forecast")):
        lost = a.join(b, on, "left_anti").select("scenario_id", (F.col("agent_id") if "agent_id" in a.columns else F.lit(None).cast("string")).alias("agent_id"), F.lit(problem).alias("problem"))
        found = lost if found is None else found.union(lost)
    return found


#: How reports name the columns of evidence.
REPORTED = {"displacement_m": "future_displacement_m", "nearby_agents": "scene_density_30m", "sdc_separation_error_m": "max_sdc_separation_error_m", "near_control": "near_traffic_control"}


def reported(evidence: DataFrame) -> DataFrame:
    """evidence with the columns of a report, by its names."""
    names = (*AGENT, "object_type", "motion_class", "review_priority", "risk_tags", "min_ade_m", "min_fde_m", "miss", "displacement_m", "nearby_agents", "min_actor_separation_m", "min_sdc_separation_m", "sdc_separation_error_m", "near_crosswalk", "near_control")
    return evidence.select(*names).withColumnsRenamed(REPORTED)


def counters(evidence: DataFrame) -> DataFrame:
    """(kind, name, agents) of priorities, motion classes and tags."""
    names = F.concat(F.array(F.struct(F.lit("review_priority").alias("kind"), F.col("review_priority").alias("name")), F.struct(F.lit("motion_class").alias("kind"), F.col("motion_class").alias("name"))), F.transform("risk_tags", lambda t: F.struct(F.lit("risk_tag").alias("kind"), t.alias("name"))))
    return evidence.select(F.explode(names).alias("n")).groupBy("n.kind", "n.name").agg(F.count("*").alias("agents"))


def strata(evidence: DataFrame) -> DataFrame:
    """(kind, name, agents, means) by motion class and by priority, in one pass."""
    both = F.array(F.struct(F.lit("motion_class").alias("kind"), F.col("motion_class").alias("name")), F.struct(F.lit("review_priority").alias("kind"), F.col("review_priority").alias("name")))
    each = evidence.withColumn("n", F.explode(both))
    return each.groupBy("n.kind", "n.name").agg(F.count("*").alias("agents"), F.avg("min_ade_m").alias("mean_min_ade_m"), F.avg("min_fde_m").alias("mean_min_fde_m"), F.avg(F.col("miss").cast("double")).alias("miss_rate"))


def top_cases(evidence: DataFrame, k: int = 20) -> DataFrame:
    order = F.when(F.col("review_priority") == "high", 0).when(F.col("review_priority") == "medium", 1).otherwise(2)
    return evidence.orderBy(order, F.desc(F.round(F.coalesce("sdc_separation_error_m", F.lit(0.0)), 9)), F.desc(F.round("min_ade_m", 9)), "scenario_id", "agent_id").limit(k)
