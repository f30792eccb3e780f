"""The queries of the motion operators over the derived motion tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.functions.columns import r6, wrapped_angle
from motioncheck.operators import compare, evidence, external, forecast, geometry, regression, requirements, risk, scoring, signals
from motioncheck.sources import framed, json_files, shards, views
from motioncheck.sources.stored import stored, workspace


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six decimals, and other numbers as longs."""
    def one(name: str, kind: str):
        return r6(F.col(name)).alias(name) if kind == "double" else F.col(name).cast("long").alias(name) if kind in ("int", "bigint", "smallint", "tinyint") else F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


class Case:
    """The tables of one data folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = spark, sf_dir

    def _view(self, make: Callable) -> DataFrame:
        return make(self.spark, self.at)

    @cached_property
    def states(self) -> DataFrame:
        return self._view(views.states)

    @cached_property
    def scenarios(self) -> DataFrame:
        return views.scenarios(self.states)

    @cached_property
    def lanes(self) -> DataFrame:
        return self._view(views.lanes)

    @cached_property
    def crosswalks(self) -> DataFrame:
        return self._view(views.crosswalks)

    @cached_property
    def signs(self) -> DataFrame:
        return self._view(views.stop_signs)

    @cached_property
    def signals(self) -> DataFrame:
        return self._view(views.signals)

    @cached_property
    def pairs(self) -> DataFrame:
        """The SDC with each agent to predict."""
        return self.scenarios.select("scenario_id", F.col("sdc_agent_id").alias("agent_id"), F.explode("tracks_to_predict").alias("other_id")).where("agent_id is not null")

    def recording(self, states: DataFrame) -> requirements.Recording:
        return requirements.Recording(states, views.scenarios(states), self.lanes, self.crosswalks, self.signs, self.signals)

    def evaluated(self, of: requirements.Recording) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Resolved requirements (written once, as all of this reads them), judged samples, results."""
        resolved = stored(requirements.resolve(views.requirements(self.spark), of.scenarios))
        judged = requirements.judged(requirements.samples(resolved, of), resolved)
        return resolved, judged, requirements.results(judged, resolved)

    @cached_property
    def recorded(self) -> requirements.Recording:
        """The recording; its states are written once, as all signals read them."""
        return self.recording(stored(self.states))

    @cached_property
    def reasoned(self) -> DataFrame:
        """Results with why a requirement doesn't apply."""
        return requirements.with_reasons(self.baseline[2], self.baseline[0], self.recorded)

    @cached_property
    def baseline(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.evaluated(self.recorded)

    def swept(self, offsets: tuple[float, ...] = evidence.OFFSETS) -> DataFrame:
        """The baseline at swept thresholds; its samples are written once, as counts and results read them."""
        resolved, judged = self.baseline[0], stored(self.baseline[1])
        return evidence.sensitivity(judged, resolved, requirements.results(judged, resolved), offsets)

    @cached_property
    def transitions(self) -> DataFrame:
        return regression.transitions(self.baseline[2], self.evaluated(self.recording(stored(self._view(views.states_candidate))))[2])

    @cached_property
    def changes(self) -> DataFrame:
        return regression.missing_added(self.scenarios, views.scenarios(self._view(views.states_candidate)))

    def points(self, model: str) -> DataFrame:
        return forecast.forecast(self.states, self.scenarios, model)

    def scores(self, model: str = "kinematic_ensemble") -> DataFrame:
        return scoring.agent_scores(self.points(model), self.states)

    @cached_property
    def deltas(self) -> DataFrame:
        return compare.agent_deltas(self.scores("constant_velocity"), self.scores())

    @cached_property
    def risk(self) -> DataFrame:
        _, points, scores = self.predicted
        return risk.evidence(self.states, self.scenarios, forecast.targets(self.scenarios), points, scores, self.crosswalks, self.signs, self.signals)

    @cached_property
    def predicted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """States, points and scores of the agents to predict; the states are written once, as all steps read them."""
        own = stored(self.states.join(forecast.targets(self.scenarios).select(*scoring.AGENT), list(scoring.AGENT), "left_semi"))
        points = forecast.forecast(own, self.scenarios, "kinematic_ensemble")
        return own, points, scoring.agent_scores(points, own)

    @cached_property
    def external(self) -> DataFrame:
        """Points of another model, from embeddings: two modes of sixteen points."""
        rows = views.table(self.spark, self.at, "embeddings").where("embedding is not null").select("vec_id", F.posexplode("embedding").alias("p", "v")).where("p < 64")
        axis = rows.groupBy("vec_id", F.floor(F.col("p") / 32).cast("int").alias("mode_index"), F.floor((F.col("p") % 32) / 2).cast("int").alias("point_ord"))
        points = axis.agg(F.max(F.when(F.col("p") % 2 == 0, F.col("v").cast("double"))).alias("x_m"), F.max(F.when(F.col("p") % 2 == 1, F.col("v").cast("double"))).alias("y_m"))
        return points.select(F.lit("s0").alias("scenario_id"), F.col("vec_id").cast("string").alias("agent_id"), "mode_index", "point_ord", (F.lit(2.0) - F.col("mode_index") + (F.col("vec_id") % 3)).cast("double").alias("confidence"), "x_m", "y_m")

    @cached_property
    def resampled(self) -> DataFrame:
        """Values of the ensemble's scores."""
        return compare.metric_values(self.scores(), ("min_ade_m", "min_fde_m", "miss"))

    @cached_property
    def quality(self) -> DataFrame:
        return evidence.quality(self._view(views.states_irregular), self.scenarios)

    @cached_property
    def evidence(self) -> DataFrame:
        """A row per requirement: its result, grade, and the annotations that concern it."""
        found = evidence.graded(self.reasoned, evidence.marks(self.baseline[0], self.quality))
        return found.select(*requirements.REQ, "requirement_id", "passed", "failed_samples", "not_applicable_reason", "evidence_confidence", "quality_annotations")

    @cached_property
    def nested(self) -> DataFrame:
        """Scenarios as nested rows, with the shared map: as files and records hold them."""
        state = F.struct("state_ord", "time_s", "x_m", "y_m")
        tracks = self.states.groupBy("scenario_id", "track_ord", "agent_id", "object_type").agg(F.sort_array(F.collect_list(state)).alias("states"))
        tracks = tracks.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("track_ord", "agent_id", "object_type", "states"))).alias("tracks"))
        listed = lambda table, order, *names: table.select(F.lit(0).alias("one"), F.struct(order, *names).alias("f")).groupBy("one").agg(F.sort_array(F.collect_list("f")).alias("f"))
        found = self.scenarios.join(tracks, "scenario_id")
        for name, table, order, names in (("lanes", self.lanes, "lane_ord", ("feature_id", "points")), ("crosswalks", self.crosswalks, "cw_ord", ("points",)), ("stop_signs", self.signs, "sign_ord", ("lane_id", "x_m", "y_m")), ("signals", self.signals, "signal_ord", ("time_s", "lane_id", "state", "x_m", "y_m"))):
            found = found.crossJoin(F.broadcast(listed(table, order, *names).select(F.col("f").alias(name))))  # one row: the shared map
        return found

    @cached_property
    def records(self) -> DataFrame:
        """(path, content): a framed file per scenario, as the binary source gives it."""
        return framed.encoded_scenarios(self.nested)


    @cached_property
    def shards(self) -> DataFrame:
        """(path, record_ord, payload): all scenarios in shards of many records, written and read in ranges.

        As many shards as the session has shuffle partitions, at most, and ranges of several records: tasks grow with
        the table, not with its scenarios.
        """
        path, n = f"{workspace(self.spark)}-shards", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shards.write_shards(framed.decoded_records(self.records).repartition(n, "path").select("payload"), path)
        return shards.read_shards(self.spark, path, range_bytes=4 << 20)


QUERIES: dict[str, Callable[[Case], DataFrame]] = {
    "scan_states": lambda c: c.states.drop("micros"),
    "scenario_timeline": lambda c: c.scenarios.select("scenario_id", F.posexplode("timestamps_s").alias("step", "time_s")),
    "scenario_summary": lambda c: c.states.groupBy("scenario_id").agg(F.countDistinct("agent_id").alias("tracks"), F.count("*").alias("n_states"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s")),
    "signal_speed": lambda c: signals.speed(c.states),
    "signal_acceleration": lambda c: signals.acceleration(c.states),
    "signal_jerk": lambda c: signals.jerk(c.states),
    "aligned_pairs": lambda c: signals.aligned_pairs(c.states, c.pairs),
    "signal_separation": lambda c: signals.separation(c.states, c.pairs),
    "signal_closing_speed": lambda c: signals.closing_speed(c.states, c.pairs),
    "signal_ttc": lambda c: signals.time_to_collision(c.states, c.pairs),
    "wrapped_angle": lambda c: c.states.select("scenario_id", "agent_id", "state_ord", wrapped_angle(F.col("x_m") / 8 - 6).alias("angle")),
    "asof_current_state": lambda c: risk.current_states(c.states, forecast.targets(c.scenarios)).drop("current_time_s"),
    "resolve_selectors": lambda c: c.baseline[0].select("scenario_id", "req_ord", "requirement_id", "agent_id", "other_id"),
    "unknown_agents": lambda c: requirements.unknown_agents(c.baseline[0].withColumn("agent_id", F.when(F.col("req_ord") == 2, F.concat("agent_id", F.lit("x"))).otherwise(F.col("agent_id"))), c.states),
    "metric_samples": lambda c: c.baseline[1].select("scenario_id", "req_ord", "sample_ord", "time_s", "value"),
    "threshold_predicates": lambda c: c.baseline[1].groupBy("scenario_id", "req_ord").agg(F.count_if("met").alias("met"), F.count_if(~F.col("met")).alias("unmet")),
    "failed_samples": lambda c: requirements.failed_samples(c.baseline[1]).select("scenario_id", "req_ord", "sample_ord", "time_s", "value"),
    "requirement_results": lambda c: c.reasoned,
    "result_status": lambda c: evidence.result_status(c.baseline[2]),
    "failure_intervals": lambda c: requirements.failure_intervals(c.baseline[1]).drop("island", "threshold"),
    "explanations": lambda c: evidence.explanations(requirements.failure_intervals(c.baseline[1])).select("scenario_id", "req_ord", "start_time_s", "worst_value", "threshold_deviation"),
    "quality_irregular": lambda c: evidence.sampling_steps(c._view(views.states_irregular)).where("steps >= 2 and longest > 1.5 * median").select("scenario_id", "agent_id", "steps", "longest", "median"),
    "quality_annotations": lambda c: evidence.quality(c._view(views.states_irregular), c.scenarios).withColumn("agent_ids", F.array_join("agent_ids", ",")),
    "sensitivity_sweep": lambda c: c.swept(),
    "evidence_confidence": lambda c: evidence.confidence(c.baseline[2], c.baseline[0], evidence.quality(c._view(views.states_irregular), c.scenarios)),
    "evidence": lambda c: c.evidence,
    "validation_rollup": lambda c: evidence.rollup(c.baseline[2]),
    "regression_transitions": lambda c: c.transitions,
    "regression_scenarios": lambda c: regression.scenario_regressions(c.transitions),
    "set_missing_added": lambda c: c.changes,
    "set_common": lambda c: regression.common(c.states, c._view(views.states_candidate)),
    "regression_gate": lambda c: regression.gate(c.transitions, c.changes),
    "lane_assoc": lambda c: geometry.lane_associations(c.states, c.lanes),
    "signal_lane_offset": lambda c: geometry.lane_offset(c.states, c.lanes),
    "polygon_distance": lambda c: geometry.polygon_distances(c.states.select(*geometry.STATE, "x_m", "y_m"), geometry.STATE, c.crosswalks, geometry.FEW_EDGES),
    "point_in_polygon": lambda c: geometry.polygon_distances(c.states.select(*geometry.STATE, "x_m", "y_m"), geometry.STATE, c.crosswalks, geometry.FEW_EDGES).groupBy("scenario_id", "agent_id", "cw_ord").agg(F.count_if("inside").alias("states_inside")),
    "signal_crosswalk": lambda c: geometry.crosswalk_proximity(c.states, c.crosswalks),
    "signal_vru_crosswalk": lambda c: geometry.vru_crosswalk_proximity(c.states, c.crosswalks, c.states),
    "signal_red_stop_line": lambda c: geometry.red_stop_line_violation(c.states, c.lanes, c.signals),
    "signal_stop_sign_speed": lambda c: geometry.stop_sign_crossing_speed(c.states, c.lanes, c.signs),
    "forecast_cv": lambda c: c.points("constant_velocity"),
    "forecast_ca": lambda c: c.points("constant_acceleration"),
    "forecast_ctrv": lambda c: c.points("constant_turn_rate"),
    "forecast_ensemble": lambda c: c.points("kinematic_ensemble"),
    "mode_errors": lambda c: scoring.mode_errors(scoring.point_errors(c.points("kinematic_ensemble"), c.states)),
    "agent_scores": lambda c: c.scores(),
    "scenario_scores": lambda c: scoring.means(c.scores(), "scenario_id"),
    "evaluation_summary": lambda c: scoring.means(c.scores()),
    "by_object_type": lambda c: scoring.means(c.scores(), "object_type"),
    "best_mode_counts": lambda c: scoring.best_mode_counts(c.scores()),
    "worst_agents_topk": lambda c: scoring.worst_agents(c.scores().select("scenario_id", "agent_id", F.round("min_ade_m", 9).alias("min_ade_m"))),
    "scenario_ranking": lambda c: scoring.means(c.scores(), "scenario_id").select("scenario_id", "mean_min_ade_m").orderBy(F.desc("mean_min_ade_m"), "scenario_id"),
    "paired_agent_deltas": lambda c: c.deltas,
    "identity_check": lambda c: compare.identity(c.scores(), c.scores("constant_velocity").where("agent_id <> '1'")),
    "change_counts": lambda c: compare.change_counts(c.deltas.withColumns({n: F.round(n, 9) for n in ("min_ade_delta_m", "min_fde_delta_m")})),
    "scenario_deltas": lambda c: compare.scenario_deltas(c.deltas),
    "top_improved_agents": lambda c: compare.most_changed(c.deltas.select("scenario_id", "agent_id", F.round("min_ade_delta_m", 9).alias("min_ade_delta_m")), False),
    "top_regressed_agents": lambda c: compare.most_changed(c.deltas.select("scenario_id", "agent_id", F.round("min_ade_delta_m", 9).alias("min_ade_delta_m")), True),
    "comparison_gate": lambda c: compare.gate(scoring.means(c.scores("constant_velocity")), scoring.means(c.scores())),
    "bootstrap_ci": lambda c: compare.bootstrap_hashed(c.resampled),
    "paired_bootstrap_ci": lambda c: compare.bootstrap_hashed(compare.metric_values(c.deltas, ("min_ade_delta_m", "min_fde_delta_m", "miss_delta"))),
    "bootstrap_exact": lambda c: compare.bootstrap_exact(c.resampled),
    "bootstrap_split": lambda c: compare.bootstrap_split(c.resampled),
    "threshold_sweep": lambda c: c.swept(tuple(i / 8 for i in range(-8, 9))),
    "external_predictions": lambda c: c.external,
    "external_invalid_modes": lambda c: external.invalid_modes(c.external.withColumn("x_m", F.when(F.col("agent_id").cast("int") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x_m"))).where("not (agent_id % 11 = 0 and point_ord = 3)")),
    "external_identity": lambda c: external.population_differences(c.external, forecast.targets(c.scenarios)),
    "normalized_confidence": lambda c: external.normalized_confidence(c.external.where("point_ord = 0").select("scenario_id", "agent_id", "mode_index", "confidence")),
    "submission_attach_times": lambda c: external.with_times(c.external, c.scenarios, forecast.STEPS).select("scenario_id", "agent_id", "mode_index", "point_ord", "time_s"),
    "float32_roundtrip": lambda c: external.submitted(c.points("kinematic_ensemble")),
    "scene_density": lambda c: c.risk.select("scenario_id", "agent_id", "nearby_agents"),
    "min_actor_separation": lambda c: c.risk.select("scenario_id", "agent_id", "min_actor_separation_m"),
    "sdc_interaction": lambda c: c.risk.select("scenario_id", "agent_id", "min_sdc_separation_m", "sdc_separation_error_m"),
    "motion_class": lambda c: c.risk.select("scenario_id", "agent_id", "displacement_m", "motion_class"),
    "near_map_context": lambda c: risk.map_context(*c.predicted, c.crosswalks, c.signs, c.signals).select("scenario_id", "agent_id", "near_crosswalk", "near_control"),
    "risk_tags": lambda c: c.risk.select("scenario_id", "agent_id", F.array_join("risk_tags", ",").alias("risk_tags")),
    "review_priority": lambda c: c.risk.select("scenario_id", "agent_id", "review_priority"),
    "risk_evidence": lambda c: risk.reported(c.risk).withColumn("risk_tags", F.array_join("risk_tags", ",")),
    "risk_counters": lambda c: risk.counters(c.risk),
    "risk_strata": lambda c: risk.strata(c.risk),
    "risk_top_cases": lambda c: risk.top_cases(c.risk).select("scenario_id", "agent_id", "review_priority", "min_ade_m"),
    "svg_projection": lambda c: geometry.canvas(c.states.select("scenario_id", "agent_id", "state_ord", "x_m", "y_m")),
    "tfrecord_scan": lambda c: framed.decoded_records(c.records).groupBy("record_ord").agg(F.count("*").alias("records"), F.count_if(F.length("payload") > 0).alias("filled")),
    "scenario_scan": lambda c: json_files.states_of(framed.decoded_scenarios(c.records)).select("scenario_id", "agent_id", "object_type", "track_ord", "time_s", "x_m", "y_m"),
    "normalize_valid_states": lambda c: framed.decoded_scenarios(c.records).select("scenario_id", F.explode("tracks").alias("t")).select("scenario_id", "t.agent_id", F.size("t.states").alias("valid_states")),
    "map_normalize": lambda c: map_counts(framed.decoded_scenarios(c.records)),
    "shard_scan": lambda c: shards.decoded(c.shards).select("scenario_id", F.size("tracks").alias("tracks"), F.aggregate("tracks", F.lit(0), lambda n, t: n + F.size(t["states"])).alias("n_states")),
    "scenario_json": lambda c: json_files.states_of(written_json(c)).select("scenario_id", "agent_id", "object_type", "track_ord", "state_ord", "time_s", "x_m", "y_m"),
    "manifest_duplicates": lambda c: json_files.duplicates(written_json(c, "s1")),
}


def map_counts(nested: DataFrame) -> DataFrame:
    """What a decoded map has, per scenario: the rows that json_files.map_tables() would make of it, null for none.

    Each record is decoded once: its lists are counted where they are, and nothing is exploded or joined.
    """
    sizes = {name: F.size(name) for name in ("lanes", "crosswalks", "signals")}
    sizes["signs"] = F.aggregate("stop_signs", F.lit(0), lambda n, s: n + F.size(s["lane_ids"]))
    return nested.select("scenario_id", "map_feature_count", *[F.nullif(F.greatest(sizes[name], F.lit(0)), F.lit(0)).alias(name) for name in ("lanes", "crosswalks", "signs", "signals")])


def written_json(c: Case, again: str | None = None) -> DataFrame:
    """The scenarios written as JSON files, one each, and read by the source of such files; `again`: a scenario with a second file."""
    folder = workspace(c.spark)
    track = lambda t: F.struct(t["agent_id"], t["object_type"], F.transform(t["states"], lambda s: F.struct(s["time_s"], s["x_m"], s["y_m"])).alias("states"))
    own = c.nested.select("scenario_id", "current_time_index", "sdc_agent_id", "tracks_to_predict", "objects_of_interest", "timestamps_s", F.transform("tracks", track).alias("tracks"))
    rows = own.select(F.col("scenario_id").alias("file"), F.to_json(F.struct(*own.columns)).alias("value"))
    if again:
        rows = rows.union(rows.where(F.col("file") == again).withColumn("file", F.concat("file", F.lit("-again"))))
    rows.repartition("file").write.partitionBy("file").text(folder)
    return json_files.read_scenarios(c.spark, [f"{folder}/*"])


def _query(make: Callable[[Case], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(make(Case(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(make) for name, make in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which a requirement fails."""
    return queries()["failure_intervals"](spark, sf_dir)
