"""Requirements: selectors, samples, results, failure intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncheck.functions.columns import OPERATORS, holds
from motioncheck.operators import geometry, signals
from motioncheck.sources.stored import stored, with_all

REQ = ("scenario_id", "req_ord")
#: A requirement as its samples have it.
ASKED = (*REQ, "requirement_id", "operator", "threshold")
#: The metrics of an agent's own motion, and those that need another agent.
KINEMATIC = ("speed", "acceleration", "jerk")
PAIRED = ("separation", "time_to_collision")
#: The signals of the map, which don't apply where nothing of theirs is found.
MAPPED = ("lane_lateral_offset", "crosswalk_proximity", "vru_crosswalk_proximity", "red_stop_line_violation", "stop_sign_crossing_speed")
METRICS = (*KINEMATIC, *PAIRED, *MAPPED)


@dataclass
class Recording:
    """The tables that requirements are evaluated over. Map tables may be None: then their signals don't apply."""

    states: DataFrame
    scenarios: DataFrame
    lanes: DataFrame | None = None
    crosswalks: DataFrame | None = None
    signs: DataFrame | None = None
    signals: DataFrame | None = None


def _selected(selector: Column) -> Column:
    """The agent of a selector; negative numbers count from a list's end; null if there is none."""
    def pick(prefix: str, agents: str) -> Column:
        n = F.regexp_extract(selector, f"^{prefix}:(-?[0-9]+)$", 1)
        i = F.when(n != "", n).cast("int")
        return F.get(agents, F.when(i < 0, F.size(agents) + i).otherwise(i))

    return (
        F.when(selector == "@sdc", F.col("sdc_agent_id"))
        .when(selector.startswith("@prediction:"), pick("@prediction", "tracks_to_predict"))
        .when(selector.startswith("@object_of_interest:"), pick("@object_of_interest", "objects_of_interest"))
        .when(~selector.startswith("@"), selector)
    )


def resolve(requirements: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each requirement in each scenario, with its agents."""
    both = with_all(scenarios, requirements)
    return both.select(*REQ, "requirement_id", "metric", "operator", "threshold", _selected(F.col("subject")).alias("agent_id"), _selected(F.col("other")).alias("other_id"), F.col("other").isNotNull().alias("paired"))


def unsupported(requirements: DataFrame) -> DataFrame:
    """Requirements with a metric or an operator that there isn't."""
    known = F.col("metric").isin(*METRICS) & F.col("operator").isin(*OPERATORS)
    return requirements.where(~F.coalesce(known, F.lit(False)))


def unresolved(resolved: DataFrame) -> DataFrame:
    """Requirements whose selector finds no agent, or whose metric needs another agent and has none: an error of the input."""
    lacks = F.col("agent_id").isNull() | (F.col("paired") & F.col("other_id").isNull()) | (F.col("metric").isin(*PAIRED) & ~F.col("paired"))
    return resolved.where(lacks).select(*REQ, "requirement_id")


def unknown_agents(resolved: DataFrame, states: DataFrame) -> DataFrame:
    """Resolved agents that have no track in their scenario."""
    named = resolved.select("scenario_id", F.explode(F.array("agent_id", "other_id")).alias("agent_id")).where("agent_id is not null").distinct()
    return named.join(states.select("scenario_id", "agent_id").distinct(), ["scenario_id", "agent_id"], "left_anti")


def samples(resolved: DataFrame, of: Recording) -> DataFrame:
    """(scenario_id, req_ord, requirement_id, operator, threshold, sample_ord, time_s, value) of all requirements, from the signals that they use.

    A signal is made of the agents that its requirements ask about, not of all that any asks about: states meet the
    requirements once, and are written with the metrics that are asked of their agent.
    """
    own = resolved.select(*ASKED, "metric", "agent_id", "other_id")
    tracks = ("scenario_id", "agent_id")

    pairs = own.where(F.col("metric").isin(*PAIRED)).select("scenario_id", "agent_id", "other_id").distinct()
    agents = own.select(*tracks, "metric").union(own.where(F.col("metric").isin(*PAIRED)).select("scenario_id", "other_id", "metric"))
    asked = agents.where("agent_id is not null").groupBy(*tracks).agg(F.collect_set("metric").alias("_asked"))
    tagged = stored(of.states.join(asked, list(tracks)))

    def states(*metrics: str) -> DataFrame:
        return tagged.where(F.arrays_overlap("_asked", F.array(*map(F.lit, metrics)))).drop("_asked")

    parts = [
        _asked(signals.kinematics(states(*KINEMATIC)), own, KINEMATIC, tracks),
        _asked(signals.paired(states(*PAIRED), pairs), own, PAIRED, (*tracks, "other_id")),
    ]
    made = {}
    if of.lanes is not None:
        on_lanes = states("lane_lateral_offset", "red_stop_line_violation", "stop_sign_crossing_speed")
        near = geometry.lane_distances(on_lanes, of.lanes, geometry.LANE_RADIUS)
        if of.signals is not None or of.signs is not None:  # read by several signals
            near = stored(near)
        made["lane_lateral_offset"] = geometry.lane_offset(on_lanes, of.lanes, near)
        if of.signals is not None:
            made["red_stop_line_violation"] = geometry.red_stop_line_violation(on_lanes, of.lanes, of.signals, near)
        if of.signs is not None:
            made["stop_sign_crossing_speed"] = geometry.stop_sign_crossing_speed(on_lanes, of.lanes, of.signs, near)
    if of.crosswalks is not None:
        made["crosswalk_proximity"] = geometry.crosswalk_proximity(states("crosswalk_proximity"), of.crosswalks)
        made["vru_crosswalk_proximity"] = geometry.vru_crosswalk_proximity(of.states, of.crosswalks, own=states("vru_crosswalk_proximity"))
    mapped = None
    for metric, found in made.items():
        found = found.select(*tracks, F.lit(metric).alias("metric"), "sample_ord", "time_s", "value")
        mapped = found if mapped is None else mapped.union(found)
    if mapped is not None:
        parts.append(mapped.join(own.select(*ASKED, "agent_id", "metric"), [*tracks, "metric"]).select(*ASKED, "sample_ord", "time_s", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _asked(found: DataFrame, own: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Samples of the asked metrics, from a table with a column for each: one join for all."""
    asked = own.where(F.col("metric").isin(*metrics)).select(*ASKED, *keys[1:], "metric")
    value = None
    for m in metrics:
        value = F.when(F.col("metric") == m, F.col(m)) if value is None else value.when(F.col("metric") == m, F.col(m))
    return found.join(asked, list(keys)).select(*ASKED, "sample_ord", "time_s", value.alias("value")).where("value is not null")


def judged(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """samples with whether each meets its requirement: those of samples() have it beside them, others meet it."""
    if not set(ASKED) <= set(samples.columns):
        samples = samples.join(resolved.select(*ASKED), list(REQ))
    return samples.withColumn("met", holds(F.col("value"), F.col("operator"), F.col("threshold")))


def failed_samples(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("met"))


#: Why a requirement doesn't apply where the scenario's map lacks what it needs, and where it has it.
NO_LANES, NO_CROSSWALKS = "scenario contains no lane-center geometry", "scenario contains no crosswalk polygons"
NO_STOP_SIGNALS, NO_STOP_SIGNS = "scenario contains no stop-state traffic signals", "scenario contains no usable stop-sign lane geometry"
NOT_OBSERVED = {
    "lane_lateral_offset": f"subject is never within {geometry.LANE_RADIUS:g} m of a lane center",
    "vru_crosswalk_proximity": "no pedestrian or cyclist is observed in a mapped crosswalk context",
    "red_stop_line_violation": "subject is not aligned with an active stop-state signal",
    "stop_sign_crossing_speed": "subject does not cross a mapped stop-sign position",
}


def map_content(of: Recording) -> DataFrame:
    """(scenario_id, has_lanes, has_crosswalks, has_signs, has_stop_signals) of each scenario; a signal counts on a lane of the map."""
    found = of.scenarios.select("scenario_id")
    red = of.signals.where(F.col("state").isin(*geometry.STOP_STATES)) if of.signals is not None and of.lanes is not None else None
    if red is not None:
        named = of.lanes.select(*geometry.scope(of.lanes), F.col("feature_id").alias("lane_id"))
        red = red.join(named, [*geometry.scope(of.lanes), "lane_id"], "left_semi")
    for name, table in (("has_lanes", of.lanes), ("has_crosswalks", of.crosswalks), ("has_signs", of.signs), ("has_stop_signals", red)):
        if table is None:
            found = found.withColumn(name, F.lit(False))
        elif geometry.scope(table):
            found = found.join(table.select("scenario_id").distinct().withColumn(name, F.lit(True)), "scenario_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        else:  # one row
            found = found.crossJoin(F.broadcast(table.agg((F.count("*") > 0).alias(name))))
    return found


def with_reasons(results: DataFrame, resolved: DataFrame, of: Recording) -> DataFrame:
    """results with not_applicable_reason, null where the requirement applies."""
    metric = F.col("metric")
    lanes, walks, signs, lights = (~F.col(c) for c in ("has_lanes", "has_crosswalks", "has_signs", "has_stop_signals"))
    lacks = F.when(metric.isin("lane_lateral_offset", "red_stop_line_violation") & lanes, NO_LANES).when(metric.isin("crosswalk_proximity", "vru_crosswalk_proximity") & walks, NO_CROSSWALKS)
    lacks = lacks.when((metric == "red_stop_line_violation") & lights, NO_STOP_SIGNALS).when((metric == "stop_sign_crossing_speed") & (lanes | signs), NO_STOP_SIGNS)
    for name, text in NOT_OBSERVED.items():
        lacks = lacks.when(metric == name, text)
    both = results.join(resolved.select(*REQ, "metric"), list(REQ)).join(map_content(of), "scenario_id")
    return both.select(*results.columns, F.when(~F.col("applicable"), lacks).alias("not_applicable_reason"))


def results(judged: DataFrame, resolved: DataFrame) -> DataFrame:
    """A row per requirement and scenario; passed is null where it doesn't apply. No samples at all passes, except for signals of the map."""
    counted = judged.groupBy(*REQ).agg(F.count("*").alias("evaluated_samples"), F.count_if(~F.col("met")).alias("failed_samples"), F.min("value").alias("observed_min"), F.max("value").alias("observed_max"))
    both = resolved.select(*REQ, "requirement_id", "metric").join(counted, list(REQ), "left")
    n, bad = F.coalesce("evaluated_samples", F.lit(0)), F.coalesce("failed_samples", F.lit(0))
    applies = ~F.col("metric").isin(*MAPPED) | (n > 0)
    return both.select(*REQ, "requirement_id", n.alias("evaluated_samples"), bad.alias("failed_samples"), "observed_min", "observed_max", applies.alias("applicable"), F.when(applies, bad == 0).alias("passed"))


#: Consecutive samples that one task holds of a requirement, at most.
CHUNK = 1 << 16


def failure_intervals(judged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of failed samples: a step longer than 1.5 times their least positive step parts them.

    A requirement's series is cut into chunks of its order, so that a long one takes many tasks.
    A chunk is summed up by its first and last time and its least step; these rows give each chunk
    the time before it and the least step of the whole series. Chunks then mark where runs start,
    and a chunk's samples before its first start go on with the last run of the chunk before.
    """
    part = [*REQ, "chunk"]
    along = Window.partitionBy(*part).orderBy("sample_ord")
    series, chunks = Window.partitionBy(*REQ), Window.partitionBy(*REQ).orderBy("chunk")
    bad = failed_samples(judged).select(*REQ, "requirement_id", "operator", "threshold", "sample_ord", "time_s", "value", F.floor(F.col("sample_ord") / chunk).alias("chunk"))
    bad = stored(bad.withColumn("step", F.col("time_s") - F.lag("time_s").over(along)))  # read for the summaries, and for the runs
    ends = bad.groupBy(*part).agg(F.min_by("time_s", "sample_ord").alias("first"), F.max_by("time_s", "sample_ord").alias("last"), F.min(F.when(F.col("step") > 0, F.col("step"))).alias("least"))
    ends = ends.withColumn("before", F.col("first") - F.lag("last").over(chunks))
    ends = ends.select(*part, "before", F.min(F.least("least", F.when(F.col("before") > 0, F.col("before")))).over(series).alias("nominal"))
    step = F.coalesce("step", "before")
    starts = F.when(step.isNull() | (F.col("nominal").isNotNull() & (step > 1.5 * F.col("nominal"))), 1).otherwise(0)
    marked = bad.join(ends, part).withColumn("nth", F.sum(starts).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*part, "requirement_id", "nth").agg(F.min("time_s").alias("start_time_s"), F.max("time_s").alias("end_time_s"), F.count("*").alias("sample_count"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("operator").alias("operator"), F.first("threshold").alias("threshold"))
    opened = runs.groupBy(*part).agg(F.max("nth").alias("opened"))
    earlier = opened.select(*part, F.coalesce(F.sum("opened").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = runs.join(earlier, part).withColumn("island", F.col("earlier") + F.col("nth"))
    worst = F.when(F.first("operator").startswith("greater"), F.min("low")).otherwise(F.max("high"))
    return numbered.groupBy(*REQ, "requirement_id", "island").agg(F.min("start_time_s").alias("start_time_s"), F.max("end_time_s").alias("end_time_s"), F.sum("sample_count").alias("sample_count"), worst.alias("worst_value"), F.first("threshold").alias("threshold"))
