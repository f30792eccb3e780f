"""Motion operators on hand-made recordings, binary files and commands."""

from __future__ import annotations

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from motioncheck import cli
from motioncheck.functions.columns import r6
from motioncheck.operators import compare, evidence, external, forecast, geometry, regression, requirements, risk, scoring, signals
from motioncheck.plans import experiment, queries, render
from motioncheck.sources import framed, json_files, parted, stored, submissions

STATE = "scenario_id string, agent_id string, object_type string, track_ord long, state_ord long, time_s double, x_m double, y_m double"


def track(spark, agents: dict[str, list[tuple[float, float, float]]], kinds: dict[str, str] | None = None):
    rows = [("s", a, (kinds or {}).get(a, "vehicle"), o, i, float(t), float(x), float(y)) for o, (a, points) in enumerate(agents.items()) for i, (t, x, y) in enumerate(points)]
    return spark.createDataFrame(rows, STATE)


def values(df, order="sample_ord"):
    return [r.value for r in df.orderBy(order).collect()]


def test_kinematics(spark):
    own = track(spark, {"a": [(0, 0, 0), (1, 2, 0), (2, 6, 0), (3, 12, 0)]})
    assert values(signals.speed(own)) == [2, 4, 6]
    assert values(signals.acceleration(own)) == [2, 2]
    assert values(signals.jerk(own)) == [0]


def test_pairs(spark):
    own = track(spark, {"a": [(0, 0, 0), (1, 10, 0), (2, 20, 0)], "b": [(0, 30, 0), (1, 38, 0), (2, 46, 0)], "c": [(0, 0, 0)]})
    pairs = spark.createDataFrame([("s", "a", "b")], "scenario_id string, agent_id string, other_id string")
    assert values(signals.separation(own, pairs)) == [30, 28, 26]
    assert values(signals.closing_speed(own, pairs)) == [2, 2]
    assert values(signals.time_to_collision(own, pairs)) == [14, 13]
    back = spark.createDataFrame([("s", "b", "a")], pairs.schema)
    away = track(spark, {"a": [(0, 0, 0), (1, -1, 0)], "b": [(0, 5, 0), (1, 6, 0)]})
    assert values(signals.time_to_collision(away, back)) == [math.inf]
    lone = spark.createDataFrame([("s", "a", "c")], pairs.schema)
    assert signals.misaligned(own, lone).count() == 1 and signals.misaligned(own, pairs).count() == 0


POINTS = "array<struct<x_m: double, y_m: double>>"


@pytest.fixture(scope="module")
def street(spark):
    """A lane, a crosswalk, a stop sign and red lights, as one shared map and per scenario."""
    lanes = spark.createDataFrame([(0, "1", [(0.0, 0.0), (20.0, 0.0)])], f"lane_ord long, feature_id string, points {POINTS}")
    walks = spark.createDataFrame([(0, [(9.0, -2.0), (11.0, -2.0), (11.0, 2.0), (9.0, 2.0)])], f"cw_ord long, points {POINTS}")
    signs = spark.createDataFrame([(0, "1", 10.0, 0.0)], "sign_ord long, lane_id string, x_m double, y_m double")
    lights = spark.createDataFrame([(i, float(i), "1", "stop", 10.0, 0.0) for i in range(3)], "signal_ord long, time_s double, lane_id string, state string, x_m double, y_m double")
    return lanes, walks, signs, lights


@pytest.mark.parametrize("scoped", [False, True])
def test_map_signals(spark, street, scoped):
    lanes, walks, signs, lights = (d.withColumn("scenario_id", F.lit("s")) if scoped else d for d in street)
    own = track(spark, {"a": [(0, 8, 1), (1, 9.5, 1), (2, 10.5, 1)], "p": [(0, 10, 0), (1, 10, 0), (2, 10, 0)]}, {"p": "pedestrian"})
    ego = own.where("agent_id = 'a'")
    assert values(geometry.lane_offset(ego, lanes)) == [1, 1, 1]
    assert values(geometry.crosswalk_proximity(ego, walks)) == [1, 0, 0]
    assert values(geometry.red_stop_line_violation(ego, lanes, lights)) == [0, 1]
    assert values(geometry.stop_sign_crossing_speed(ego, lanes, signs)) == [1]
    near = geometry.vru_crosswalk_proximity(own, walks, ego.select("scenario_id", "agent_id"))
    assert values(near) == pytest.approx([math.hypot(2, 1), math.hypot(0.5, 1), math.hypot(0.5, 1)])


def scenarios(spark, **over):
    row = {"scenario_id": "s", "current_time_index": 10, "sdc_agent_id": "a", "tracks_to_predict": ["b"], "objects_of_interest": ["b"], "map_feature_count": 0, "timestamps_s": [i / 10 for i in range(91)]} | over
    return spark.createDataFrame([tuple(row.values())], "scenario_id string, current_time_index int, sdc_agent_id string, tracks_to_predict array<string>, objects_of_interest array<string>, map_feature_count int, timestamps_s array<double>")


def wanted(spark, *rows):
    return spark.createDataFrame([(i, f"r{i}", *r) for i, r in enumerate(rows)], "req_ord long, requirement_id string, metric string, operator string, threshold double, subject string, other string")


def test_large_shared_tables(spark, monkeypatch):
    """A table above the limit of a broadcast is met in blocks, with the same rows; so are equal rows and an empty table."""
    rows, shared = spark.range(3).toDF("a"), spark.range(40).selectExpr("id % 5 as b", "array(id % 5, 7) as c")
    whole = sorted((r.a, r.b, *r.c) for r in stored.with_all(rows, shared).collect())
    assert len(whole) == 120
    monkeypatch.setattr(stored, "BROADCAST_BYTES", 200)
    parts = stored.with_all(rows, shared)
    assert sorted((r.a, r.b, *r.c) for r in parts.collect()) == whole
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") > 2
    assert stored.with_all(rows, shared.where("false")).count() == 0


def test_requirements(spark):
    own = track(spark, {"a": [(t, 10 * t, 0) for t in range(5)], "b": [(t, 30 + 8 * t, 0) for t in range(5)]})
    of = requirements.Recording(own, scenarios(spark))
    asked = wanted(spark, ("time_to_collision", "greater_than_or_equal", 13.5, "@sdc", "@prediction:-1"), ("lane_lateral_offset", "less_than", 1.0, "@sdc", None), ("speed", "less_than_or_equal", 10.0, "@object_of_interest:0", None))
    resolved = requirements.resolve(asked, of.scenarios)
    assert [(r.agent_id, r.other_id) for r in resolved.orderBy("req_ord").collect()] == [("a", "b"), ("a", None), ("b", None)]
    judged = requirements.judged(requirements.samples(resolved, of), resolved)
    found = requirements.results(judged, resolved)
    assert [(r.passed, r.evaluated_samples, r.failed_samples) for r in found.orderBy("req_ord").collect()] == [(False, 4, 3), (None, 0, 0), (True, 4, 0)]
    interval = requirements.failure_intervals(judged).collect()
    assert [(i.start_time_s, i.end_time_s, i.sample_count, i.worst_value) for i in interval] == [(2, 4, 3, 11)]
    assert evidence.explanations(requirements.failure_intervals(judged)).first().threshold_deviation == 2.5
    assert [(r.threshold, r.failed_samples) for r in evidence.sensitivity(judged, resolved, found).where("req_ord = 2").orderBy("threshold").collect()] == [(9.0, 0), (10.0, 0), (11.0, 0)]
    notes = evidence.quality(own, of.scenarios)
    assert {r.code for r in notes.collect()} == {"NO_MAP_FEATURES", "PARTIAL_REPORTED_VELOCITY"}
    assert [r.evidence_confidence for r in evidence.confidence(found, resolved, notes).orderBy("req_ord").collect()] == ["medium", "not_applicable", "medium"]
    assert evidence.rollup(found).first().overall_status == "FAIL"
    odd = requirements.resolve(wanted(spark, ("speed", "less_than", 1.0, "@prediction:2", None), ("separation", "less_than", 1.0, "a", None), ("speed", "less_than", 1.0, "zz", None)), of.scenarios)
    assert [r.req_ord for r in requirements.unresolved(odd).orderBy("req_ord").collect()] == [0, 1]
    assert [r.agent_id for r in requirements.unknown_agents(odd, own).collect()] == ["zz"]


def test_signals_are_made_of_the_agents_asked(spark, street, monkeypatch):
    """Each signal reads only its own requirements' agents; before, the map's signals were made of all agents that any asks about."""
    own = track(spark, {"a": [(t, 8 + t, 1) for t in range(3)], "b": [(t, 9 + t, 2) for t in range(3)], "c": [(t, 7 + t, 0) for t in range(3)]}, {"c": "cyclist"})
    of = requirements.Recording(own, scenarios(spark), *street)
    asked = wanted(spark, ("lane_lateral_offset", "less_than", 1.5, "@sdc", None), ("crosswalk_proximity", "less_than", 9.0, "b", None), ("vru_crosswalk_proximity", "less_than", 9.0, "@sdc", None), ("separation", "less_than", 2.0, "b", "c"), ("speed", "less_than", 9.0, "c", None))
    seen = {}
    for module, name in ((geometry, "lane_distances"), (geometry, "crosswalk_proximity"), (signals, "kinematics")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda states, *rest, made=made, name=name: seen.update({name: sorted({r.agent_id for r in states.collect()})}) or made(states, *rest))
    resolved = requirements.resolve(asked, of.scenarios)
    judged = requirements.judged(requirements.samples(resolved, of), resolved)
    assert seen == {"lane_distances": ["a"], "crosswalk_proximity": ["b"], "kinematics": ["c"]}
    found = requirements.results(judged, resolved).orderBy("req_ord").collect()
    assert [(r.evaluated_samples, r.failed_samples, r.passed) for r in found] == [(3, 0, True), (3, 0, True), (2, 0, True), (3, 3, False), (2, 0, True)]


def test_reasons(spark, street):
    lanes, walks, signs, lights = street
    own = track(spark, {"a": [(t, 100 + t, 50) for t in range(3)], "b": [(t, 0, 0) for t in range(3)]})
    asked = wanted(spark, *[(m, "less_than", 1.0, "@sdc", None) for m in requirements.MAPPED], ("speed", "less_than", 9.0, "@sdc", None))

    def reasons(*tables):
        of = requirements.Recording(own, scenarios(spark), *tables)
        resolved = requirements.resolve(asked, of.scenarios)
        found = requirements.results(requirements.judged(requirements.samples(resolved, of), resolved), resolved)
        return [r.not_applicable_reason for r in requirements.with_reasons(found, resolved, of).orderBy("req_ord").collect()]

    assert reasons() == [requirements.NO_LANES, requirements.NO_CROSSWALKS, requirements.NO_CROSSWALKS, requirements.NO_LANES, requirements.NO_STOP_SIGNS, None]
    there = ["subject is never within 10 m of a lane center", None, *list(requirements.NOT_OBSERVED.values())[1:], None]
    assert reasons(lanes, walks, signs, lights) == there
    assert reasons(lanes, walks, signs, lights.where("state <> 'stop'"))[3] == requirements.NO_STOP_SIGNALS
    assert reasons(*(d.withColumn("scenario_id", F.lit("s")) for d in (lanes, walks, signs, lights))) == there
    assert reasons(*(d.withColumn("scenario_id", F.lit("other")) for d in (lanes, walks, signs, lights)))[:2] == [requirements.NO_LANES, requirements.NO_CROSSWALKS]


def test_annotations_meet_requirements_once(spark):
    """Grades and listed annotations come from one meeting of both; before, each made its own."""
    resolved = requirements.resolve(wanted(spark, ("speed", "less_than", 9.0, "a", None), ("speed", "less_than", 9.0, "b", None)), scenarios(spark))
    notes = spark.createDataFrame([("s", "Z", "warning", ["a"], "z"), ("s", "A", "info", [], "a")], "scenario_id string, code string, severity string, agent_ids array<string>, message string")
    found = spark.createDataFrame([("s", i, f"r{i}", 9, 0, True) for i in range(2)], "scenario_id string, req_ord long, requirement_id string, evaluated_samples long, failed_samples long, applicable boolean")
    made = evidence.graded(found, evidence.marks(resolved, notes)).orderBy("req_ord")
    assert [(r.evidence_confidence, r.quality_annotations) for r in made.collect()] == [("medium", "A: a; Z: z"), ("high", "A: a")]
    assert [r.evidence_confidence for r in evidence.confidence(found, resolved, notes).orderBy("req_ord").collect()] == ["medium", "high"]


def test_partial_velocity_names_no_agents(spark):
    own = track(spark, {"a": [(0, 0, 0), (1, 2, 0)], "b": [(0, 0, 0), (1, 2, 0)]}).withColumn("velocity_x_mps", F.lit(1.0)).withColumn("velocity_y_mps", F.when(F.col("agent_id") == "a", 1.0))
    notes = evidence.quality(own, scenarios(spark, map_feature_count=3)).collect()
    assert [(r.code, r.agent_ids, r.message) for r in notes] == [("PARTIAL_REPORTED_VELOCITY", [], evidence.MESSAGES["PARTIAL_REPORTED_VELOCITY"])]
    assert evidence.quality(own.where("agent_id = 'a'"), scenarios(spark, map_feature_count=3)).count() == 0


def test_nan_fails_and_islands_use_failed_steps(spark):
    rows = [("s", 0, i, float(t), v) for i, (t, v) in enumerate([(0, math.nan), (1, 1.0), (10, 9.0), (11, 9.0), (13, 9.0)])]
    samples = spark.createDataFrame(rows, "scenario_id string, req_ord long, sample_ord long, time_s double, value double")
    resolved = spark.createDataFrame([("s", 0, "r", "speed", "less_than", 5.0)], "scenario_id string, req_ord long, requirement_id string, metric string, operator string, threshold double")
    found = requirements.failure_intervals(requirements.judged(samples, resolved)).orderBy("start_time_s").collect()
    assert [(i.start_time_s, i.end_time_s) for i in found] == [(0, 0), (10, 11), (13, 13)]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_of_chunks(spark, seed):
    # cut at any place, a series has the runs of the plain rule
    import random

    draw, at, rows = random.Random(seed), 0.0, []
    for i in range(60):
        at += draw.choice([0.0, 0.5, 0.5, 0.5, 0.75, 2.0])
        rows.append(("s", 0, i, at, draw.choice([0.0, 9.0, 9.0, 9.0, math.nan])))
    judged = spark.createDataFrame([(*r, "r", "less_than", 5.0, r[4] < 5) for r in rows], "scenario_id string, req_ord long, sample_ord long, time_s double, value double, requirement_id string, operator string, threshold double, met boolean")
    bad = [r for r in rows if not r[4] < 5]
    steps = [b[3] - a[3] for a, b in zip(bad, bad[1:])]
    least = min((d for d in steps if d > 0), default=None)
    runs = [[bad[0]]]
    for d, r in zip(steps, bad[1:]):
        if least is not None and d > 1.5 * least:
            runs.append([])
        runs[-1].append(r)
    want = [(r[0][3], r[-1][3], len(r)) for r in runs]
    for chunk in (1, 3, 7, 60, 1 << 16):
        found = requirements.failure_intervals(judged, chunk).orderBy("start_time_s", "island").collect()
        assert [(i.start_time_s, i.end_time_s, i.sample_count) for i in found] == want
    assert requirements.failure_intervals(judged.where("met"), 3).count() == 0


def results(spark, rows):
    return spark.createDataFrame(rows, "scenario_id string, req_ord long, requirement_id string, passed boolean")


def test_regression(spark):
    old = results(spark, [("a", 0, "r", True), ("a", 1, "q", False), ("b", 0, "r", True), ("b", 1, "q", None), ("gone", 0, "r", True)])
    new = results(spark, [("a", 0, "r", False), ("a", 1, "q", True), ("b", 0, "r", None), ("b", 1, "q", True), ("new", 0, "r", True)])
    moves = regression.transitions(old, new)
    assert [r.classification for r in moves.orderBy("scenario_id", "req_ord").collect()] == ["NEW_FAILURE", "RESOLVED", "LOST_APPLICABILITY", "NEWLY_APPLICABLE_PASS"]
    assert {r.status for r in regression.scenario_regressions(moves).collect()} == {"REGRESSED"}
    changes = regression.missing_added(old, new)
    assert not regression.gate(moves, changes, regression.RegressionPolicy(1, False, True)).first().gate_passed
    assert regression.gate(moves, changes, regression.RegressionPolicy(1, False, False)).first().gate_passed
    with pytest.raises(ValueError):
        regression.RegressionPolicy(-1)


def test_forecasts(spark):
    line = track(spark, {"a": [(i / 10, 0, 0) for i in range(91)], "b": [(i / 10, 0.5 * i, 0) for i in range(91)]})
    points = forecast.forecast(line, scenarios(spark), "kinematic_ensemble")
    found = scoring.agent_scores(points, line).first()
    assert points.count() == 48 and found.min_ade_m == pytest.approx(0, abs=1e-9) and found.best_mode_index in (0, 1, 2) and not found.miss and found.ground_truth_coverage == 1
    turning = [(i / 10, 10 * math.sin(0.2 * i / 10), 10 * (1 - math.cos(0.2 * i / 10))) for i in range(91)]
    arc = track(spark, {"a": turning, "b": turning}).withColumns({"heading_rad": 0.2 * F.col("time_s"), "velocity_x_mps": 2 * F.cos(0.2 * F.col("time_s")), "velocity_y_mps": 2 * F.sin(0.2 * F.col("time_s"))})
    assert scoring.agent_scores(forecast.forecast(arc, scenarios(spark), "constant_turn_rate"), arc).first().min_ade_m == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        forecast.forecast(line, scenarios(spark), "other")


def test_rounding(spark):
    below = [math.nextafter(k / 1e7, 0) for k in range(5, 20_000, 10)]  # one bit below a half of the sixth decimal, as a ratio may be
    values = [*below, *(-x for x in below), 2.4999999999999998e-06, 1.5, -0.0, 1e300, math.inf, -math.inf, math.nan, None]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", r6(F.col("x")).alias("x")).orderBy("i").collect()
    duck = pytest.importorskip("duckdb").connect()
    wanted = [duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert [repr(r.x) for r in found] == [repr(x) for x in wanted]


def test_scores(spark):
    truth = track(spark, {"a": [(t, t, 0) for t in (1, 2, 3)]})
    rows = [("s", "a", m, 1.0, i, float(t), float(t), off) for m, off in enumerate((4.0, 1.0, 2.1)) for i, t in enumerate((1, 2, 3, 4))]
    points = spark.createDataFrame(rows, "scenario_id string, agent_id string, mode_index int, confidence double, point_ord int, time_s double, x_m double, y_m double")
    found = scoring.agent_scores(points, truth).first()
    assert (found.min_ade_m, found.min_fde_m, found.best_mode_index, found.miss, found.ground_truth_coverage) == (1, 1, 1, False, 0.75)
    assert scoring.agent_scores(points.where("mode_index = 2"), truth).first().miss


def test_modes_with_the_same_errors_tie(spark):
    errors = [0.1 * i + 1 / 3 for i in range(16)]
    orders = ([*range(16)], [*range(15, -1, -1)], [*range(1, 16, 2), *range(0, 16, 2)])  # as shuffles may deal the rows
    rows = [("s", str(k), m, i, errors[i] * (k + 1)) for k in range(20) for m, order in enumerate(orders) for i in order]
    dealt = spark.createDataFrame(rows, "scenario_id string, agent_id string, mode_index int, point_ord int, error_m double").coalesce(1)
    assert {r.n for r in scoring.mode_errors(dealt).groupBy("agent_id").agg(F.count_distinct("ade_m").alias("n")).collect()} == {1}


def test_exact_draws():
    """The exact bootstrap's draws are those of Python's generator, call by call; they were made one by one before."""
    for n in (1, 2, 3, 64, 65, 1000, 70_001):
        one, many = random.Random(5), compare.python_draws(5, n)
        for _ in range(3):
            assert next(many).tolist() == [one.randrange(n) for _ in range(n)]


def test_comparison(spark):
    kind = "scenario_id string, agent_id string, object_type string, min_ade_m double, min_fde_m double, miss boolean, best_mode_index int, ground_truth_coverage double"
    old = spark.createDataFrame([("s", str(i), "vehicle", 2.0, 4.0, True, 0, 1.0) for i in range(5)], kind)
    new = spark.createDataFrame([("s", str(i), "vehicle", 1.0, 3.0, False, 1, 1.0) for i in range(5)], kind)
    deltas = compare.agent_deltas(old, new)
    assert {r.metric: r.improved for r in compare.change_counts(deltas).collect()} == {"min_ade_m": 5, "min_fde_m": 5, "miss": 5}
    own = compare.metric_values(deltas, ("min_ade_delta_m",))
    for made in (compare.bootstrap_exact(own, 50), compare.bootstrap_hashed(own, 50)):
        assert [(r.lower, r.upper) for r in made.collect()] == [(-1, -1)]
    from motioncheck.operators.scoring import means

    # widths of the two forms are alike, for any number of agents
    for n in (61, 601):
        some = compare.metric_values(spark.createDataFrame([("s", str(i), float(i * i % 97)) for i in range(n)], "scenario_id string, agent_id string, v double"), ("v",))
        exact, hashed = (f(some, 200).first() for f in (compare.bootstrap_exact, compare.bootstrap_hashed))
        mean = sum(i * i % 97 for i in range(n)) / n
        assert hashed.lower < mean < hashed.upper and 0.75 < (hashed.upper - hashed.lower) / (exact.upper - exact.lower) < 1.33
        # cut into blocks, a resample still draws as many as there are
        sums = compare.resampled_sums(some, 20, 5, block=16).groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
        assert len(sums) == 20 and {r.n for r in sums} == {n} and min(r.blocks for r in sums) > 1
        split = [compare.bootstrap_split(some, 200, block=block).first() for block in (16, 1 << 16)]
        assert all(s.lower < mean < s.upper and 0.75 < (s.upper - s.lower) / (exact.upper - exact.lower) < 1.33 for s in split)
        assert split[0] == compare.bootstrap_split(some.repartition(3), 200, block=16).first()
    assert compare.bootstrap_split(some.where("false")).count() == 0
    assert compare.same_agents(old, new) and compare.same_agents(old.where("false"), new.where("false"))
    assert not compare.same_agents(old, new.where("agent_id <> '2'")) and not compare.same_agents(old, new.union(new.limit(1)))
    assert compare.gate(means(old), means(new)).first().gate_passed and not compare.gate(means(new), means(old)).first().gate_passed
    assert compare.identity(old, new.where("agent_id <> '2'")).first().agent_id == "2"


def test_external(spark):
    kind = "scenario_id string, agent_id string, mode_index int, point_ord int, confidence double, x_m double, y_m double"
    rows = [("s", "1", m, i, c, 1.0, 2.0) for m, c in enumerate((2.0, 1.0)) for i in range(16)]
    assert external.invalid_modes(spark.createDataFrame(rows, kind)).count() == 0
    assert external.invalid_modes(spark.createDataFrame(rows[:-1], kind)).first().reason == "points"
    assert external.invalid_modes(spark.createDataFrame([(*r[:5], math.nan, 0.0) for r in rows], kind)).first().reason == "coordinates"
    modes = spark.createDataFrame(rows, kind).where("point_ord = 0")
    assert [r.confidence for r in external.normalized_confidence(modes).orderBy("mode_index").collect()] == pytest.approx([2 / 3, 1 / 3])
    good = {"model_name": " m ", "model_version": "1", "source_repository": "r", "source_revision": "v", "checkpoint_sha256": "0" * 64, "coordinate_frame": "scenario_global", "future_data_used": False}
    assert external.check_provenance(good)["model_name"] == "m"
    for key, bad in (("model_name", " "), ("checkpoint_sha256", "x"), ("coordinate_frame", "other"), ("future_data_used", 0)):
        with pytest.raises(ValueError):
            external.check_provenance(good | {key: bad})


def doubles(*v: float) -> bytes:
    return struct.pack(f"<{len(v)}d", *v)


def double(number: int, v: float) -> bytes:
    return framed._tag(number, 1) + struct.pack("<d", v)


def scene(name: str = "7", n: int = 91, valid=lambda track, i: True) -> bytes:
    """A scenario record: a vehicle along x with velocity, a still SDC, a lane, a crosswalk, a sign and lights."""
    def state(track: int, i: int) -> tuple[int, bytes]:
        x = float(i) if track == 0 else 0.0
        return 3, double(2, x) + double(3, 3.0 * track) + framed.encode((9, 10.0 if track == 0 else 0.0), (10, 0.0), (11, int(valid(track, i))))

    tracks = [(2, framed.encode((1, 42 + t), (2, 1), *[state(t, i) for i in range(n)])) for t in range(2)]
    point = lambda x, y: double(1, x) + double(2, y)
    lane = framed.encode((1, 5), (3, framed.encode((2, 2), (8, point(0, 0)), (8, point(90, 0)))))
    walk = framed.encode((1, 6), (8, framed.encode(*[(1, point(x, y)) for x, y in ((9, -2), (11, -2), (11, 2), (9, 2))])))
    sign = framed.encode((1, 8), (7, framed.encode((1, 5), (2, point(30, 0)))))
    lights = [(7, framed.encode((1, framed.encode((1, 5), (2, 4), (3, point(50, 0)))))) for _ in range(n)]
    return framed.encode((1, doubles(*[i / 10 for i in range(n)])), *tracks, (4, 43), (5, name), (6, 1), *lights, (8, lane), (8, walk), (8, sign), (10, 10), (11, framed.encode((1, 0))))


@pytest.fixture(scope="module")
def shard(tmp_path_factory):
    path = tmp_path_factory.mktemp("shards") / "scenes.records"
    path.write_bytes(framed.frame(scene("7")) + framed.frame(scene("8")))
    return str(path)


@pytest.fixture
def uncoalesced(spark):
    """As many tasks after a shuffle as the session asks for, however little they have to do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_frames(spark, shard):
    data = framed.frame(b"abc") + framed.frame(b"")
    assert list(framed.frames(data)) == [b"abc", b""]
    for cut, what in ((4, "length"), (10, "length checksum"), (14, "payload"), (17, "payload checksum")):
        with pytest.raises(framed.RecordFormatError, match=what):
            list(framed.frames(data[:cut]))
    assert framed.read_records(spark, shard).count() == 2


def test_decoding(spark, shard):
    own = framed.decode_scenario(scene(valid=lambda track, i: track == 0 and i != 3))
    assert (own["scenario_id"], own["sdc_agent_id"], own["tracks_to_predict"], own["objects_of_interest"]) == ("7", None, ["42"], [])
    assert len(own["tracks"]) == 1 and len(own["tracks"][0]["states"]) == 90 and own["map_feature_count"] == 3
    assert (len(own["lanes"]), len(own["crosswalks"]), own["stop_signs"][0]["lane_ids"], len(own["signals"])) == (1, 1, ["5"], 91)
    assert own["lanes"][0]["lane_type"] == "surface_street" and own["signals"][0]["state"] == "stop"
    with pytest.raises(ValueError):
        framed.decode_scenario(scene(valid=lambda track, i: False))
    nested = framed.read_scenarios(spark, shard)
    assert json_files.states_of(nested).count() == 2 * 2 * 91 and json_files.faults(nested).count() == 0
    assert json_files.map_tables(nested)["signals"].count() == 182


def test_maps_are_counted_in_one_pass(spark):
    case = queries.Case(spark, "/root/testdata/sf0.001")
    found = queries.map_counts(framed.decoded_scenarios(case.records))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Generate" not in plan[: plan.index("MapInArrow")]  # one encodes, one decodes
    maps = json_files.map_tables(framed.decoded_scenarios(case.records))
    for name, table in maps.items():
        assert {r.scenario_id: r[name] for r in found.collect()} == {r.scenario_id: r["count"] for r in table.groupBy("scenario_id").count().collect()}


def test_shards_grow_with_the_session(spark):
    shards = queries.Case(spark, "/root/testdata/sf0.01").shards
    assert shards.select("path").distinct().count() > 2 and shards.rdd.getNumPartitions() < shards.count()  # no task per record


def test_submission(spark, shard, tmp_path, uncoalesced):
    nested = framed.read_scenarios(spark, shard)
    points = forecast.forecast(json_files.states_of(nested), json_files.timelines(nested), "kinematic_ensemble")
    path = str(tmp_path / "out.binproto")
    submissions.write_submission(points, path)
    back = external.with_times(submissions.read_submission(spark, path), nested, forecast.STEPS)
    want = {tuple(r) for r in external.submitted(points).select("scenario_id", "agent_id", "mode_index", "point_ord", "x_m", "y_m").collect()}
    assert {tuple(r) for r in back.select("scenario_id", "agent_id", "mode_index", "point_ord", "x_m", "y_m").collect()} == want
    assert back.agg(F.min("time_s"), F.max("time_s")).first() == (1.5, 9.0)
    one = (tmp_path / "out.binproto").read_bytes()
    with pytest.raises(Exception, match="appears more than once"):
        submissions.write_submission(points.union(points.where("mode_index = 0")), path)
    assert (tmp_path / "out.binproto").read_bytes() == one and sorted(x.name for x in tmp_path.iterdir()) == ["out.binproto"]  # nothing half written
    # many scenarios: fragments of several tasks, read by several, and joined in the order of scenarios
    many = points.crossJoin(spark.range(40).select(F.format_string("n%02d", "id").alias("nth"))).withColumn("scenario_id", F.concat("nth", "scenario_id")).drop("nth")
    parts = tmp_path / "parts"
    submissions.write_submission(many, path, str(parts))
    names = sorted(x.name for x in parts.iterdir())
    assert len(names) > 1 and (tmp_path / "out.binproto").read_bytes() == b"".join((parts / n).read_bytes() for n in names) + submissions.KIND
    listed = list(framed.decode_submission((tmp_path / "out.binproto").read_bytes()))
    assert [x["scenario_id"] for x in listed] == sorted(x["scenario_id"] for x in listed) and len({x["scenario_id"] for x in listed}) == 80
    assert submissions.read_submission(spark, str(parts)).count() == len(listed) == submissions.read_submission(spark, path).count()
    submissions.write_parts(many, str(parts))
    assert all((parts / n).read_bytes().endswith(submissions.KIND) for n in (x.name for x in parts.iterdir()))
    submissions.write_external(many, {"model_name": "m"}, str(tmp_path / "x.json"))
    whole = json.loads((tmp_path / "x.json").read_text())
    assert whole["provenance"] == {"model_name": "m"} and [x["scenario_id"] for x in whole["predictions"]] == sorted({x["scenario_id"] for x in listed})
    assert len(whole["predictions"][0]["agents"][0]["modes"][0]["xy_m"]) == 16
    submissions.write_external(many.where("false"), {}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text())["predictions"] == []
    short = framed.encode((2, struct.pack("<3f", 1, 2, 3)))
    agent = framed.encode((1, 1), (2, framed.encode((1, short))))
    with pytest.raises(ValueError):
        list(framed.decode_submission(framed.encode((1, framed.encode((1, "s"), (2, framed.encode((1, agent))))))))


def test_commands(spark, shard, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    said = lambda: json.loads(capsys.readouterr().out)
    assert cli.main(["inspect", shard, "--limit", "1", "--svg", str(tmp_path / "s.svg")]) == 0
    assert said()["scenarios"][0]["track_count"] == 2 and "<polyline" in (tmp_path / "s.svg").read_text()
    asked = {"requirements": [{"id": "fast", "description": "", "metric": "speed", "operator": "less_than", "threshold": 55.0, "units": "m/s", "subject_agent_id": "@prediction:0"}, {"id": "red", "description": "", "metric": "red_stop_line_violation", "operator": "less_than_or_equal", "threshold": 0.0, "units": "", "subject_agent_id": "@prediction:0"}]}
    (tmp_path / "r.json").write_text(json.dumps(asked))
    assert cli.main(["verify-scenes", str(tmp_path / "r.json"), shard, "--markdown", str(tmp_path / "v.md"), "--html", str(tmp_path / "v.html")]) == 1
    found = said()
    assert found["overall_status"] == "FAIL" and [r["passed"] for r in found["results"]] == [True, False] and "FAIL" in (tmp_path / "v.md").read_text()
    assert all(x in (tmp_path / "v.md").read_text() for x in ("## Requirements", "| requirement | result |", "No sample failed.", "## Interpretation boundary"))
    out = str(tmp_path / "cv.binproto")
    assert cli.main(["forecast", out, shard, "--model", "constant_velocity"]) == 0
    said()
    assert cli.main(["evaluate", out, shard, "--bootstrap-samples", "20"]) == 0
    found = said()
    assert found["summary"]["agents"] == 2 and found["summary"]["mean_min_ade_m"] == pytest.approx(0, abs=1e-5)
    (tmp_path / "e.json").write_text(json.dumps(found))
    assert cli.main(["compare-evaluations", str(tmp_path / "e.json"), str(tmp_path / "e.json"), "--bootstrap-samples", "20", "--summary-only"]) == 0
    assert said()["gate_passed"]
    # the same report with its scores in a folder
    assert cli.main(["evaluate", out, shard, "--bootstrap-samples", "20", "--parts", str(tmp_path / "scores"), "--json", str(tmp_path / "p.json")]) == 0
    parts = said()
    assert "scenarios" not in parts and parts["parts"]["rows"] == 2 and {k: parts[k] for k in ("summary", "confidence_intervals")} == {k: found[k] for k in ("summary", "confidence_intervals")}
    assert render.evaluation(parts) == render.evaluation(found)
    whole, named = (json_files.read_report(spark, str(tmp_path / n))[1] for n in ("e.json", "p.json"))
    assert sorted(map(tuple, whole.select(named.columns).collect())) == sorted(map(tuple, named.collect()))
    assert cli.main(["compare-evaluations", str(tmp_path / "e.json"), str(tmp_path / "p.json"), "--bootstrap-samples", "20", "--summary-only"]) == 0
    assert said()["agent_count"] == 2
    next((tmp_path / "scores").glob("part-*")).unlink()
    with pytest.raises(ValueError, match="its report says 2"):
        json_files.read_report(spark, str(tmp_path / "p.json"))
    worse = json.loads(json.dumps(found))
    worse["summary"]["miss_rate"] = 0.5
    for a in worse["scenarios"][0]["agents"]:
        a["min_ade_m"] += 1.0
    (tmp_path / "worse.json").write_text(json.dumps(worse))
    assert cli.main(["compare-evaluations", str(tmp_path / "e.json"), str(tmp_path / "worse.json"), "--bootstrap-samples", "20", "--markdown", str(tmp_path / "c.md")]) == 1
    said()
    text = (tmp_path / "c.md").read_text()
    assert "- miss_rate rose by 0.5; 0 is allowed" in text and "| miss_rate | 0.000 | 0.500 | +0.5 |" in text and "## Interpretation boundary" in text
    assert "| metric | lower | upper | improved | unchanged | regressed |" in text
    text = render.evaluation(found)
    assert "| metric | estimate | lower | upper | confidence |" in text and "not those of an official challenge" in text
    doubled = worse | {"scenarios": [worse["scenarios"][0] | {"agents": worse["scenarios"][0]["agents"] * 2}, *worse["scenarios"][1:]]}
    (tmp_path / "doubled.json").write_text(json.dumps(doubled))
    with pytest.raises(ValueError, match="repeated"):
        cli.main(["compare-evaluations", str(tmp_path / "e.json"), str(tmp_path / "doubled.json"), "--bootstrap-samples", "20"])
    assert cli.main(["risk", out, shard, "--summary-only", "--html", str(tmp_path / "risk.html")]) == 0
    agents = said()["summary"]["agents"]
    assert agents == 2 and cli.main(["risk", out, shard, "--parts", str(tmp_path / "cases")]) == 0
    parts = said()
    assert "agents" not in parts and parts["parts"]["rows"] == 2 and {r.risk_tags is not None for r in spark.read.json(parts["parts"]["folder"]).collect()} == {True}


def test_parted_rows(spark, tmp_path, uncoalesced):
    # one scenario holds nearly all rows: it takes several files
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("zz").alias("scenario_id"), F.format_string("%05d", "id").alias("agent_id"), F.when(F.col("id") == 7, float("nan")).when(F.col("id") == 8, float("inf")).otherwise(F.col("id") / 7).alias("v"), F.lit(None).cast("string").alias("tag"))
    found = parted.write(rows, ("scenario_id", "agent_id"), str(tmp_path / "rows"))
    files = found["files"]
    assert found["rows"] == 3000 and len(files) > 2 and all(tuple(a["last"].values()) < tuple(b["first"].values()) for a, b in zip(files, files[1:]))
    assert sum(f["first"]["scenario_id"] == "hot" for f in files) > 2
    back = parted.read(spark, found, "scenario_id string, agent_id string, v double, tag string")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        parted.write(rows, ("scenario_id", "agent_id"), str(tmp_path / "rows"))
    none = parted.write(rows.where("false"), ("scenario_id", "agent_id"), str(tmp_path / "none"))
    assert (none["rows"], none["files"]) == (0, [])


def test_import_command(spark, shard, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    nested = framed.read_scenarios(spark, shard)
    points = forecast.forecast(json_files.states_of(nested), json_files.timelines(nested), "kinematic_ensemble").withColumn("confidence", F.lit(2.0))
    good = {"model_name": "m", "model_version": "1", "source_repository": "r", "source_revision": "v", "checkpoint_sha256": "0" * 64, "coordinate_frame": "scenario_global", "future_data_used": False}
    submissions.write_external(points, good, str(tmp_path / "x.json"))
    assert cli.main(["import-predictions", str(tmp_path / "x.json"), str(tmp_path / "x.binproto"), shard]) == 0
    assert json.loads(capsys.readouterr().out)["agents"] == 2
    assert {round(r.confidence, 5) for r in submissions.read_submission(spark, str(tmp_path / "x.binproto")).collect()} == {0.33333}


def test_policies():
    moved = {"mean_min_ade_m_delta": 0.2, "mean_min_fde_m_delta": 0.0, "miss_rate_delta": 0.0, "mean_ground_truth_coverage_delta": -0.5}
    strict = compare.policy_of({"max_ade_increase_m": 0.1, "require_significant_ade_improvement": True, "other": 1})
    assert len(compare.violations(moved, {"min_ade_delta_m": {"upper": 0.0}}, strict)) == 3
    with pytest.raises(ValueError):
        compare.policy_of({"max_miss_rate_increase": -1})


def test_json_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)

    def scenario(path, xs):
        path.write_text(json.dumps({"scenario_id": "demo", "tracks": [{"agent_id": "ego", "states": [{"time_s": t, "x_m": x, "y_m": 0} for t, x in enumerate(xs)]}], "unknown": 1}))

    for name, xs in (("b", (0, 10, 20)), ("c", (0, 16, 32))):
        scenario(tmp_path / f"{name}.json", xs)
        (tmp_path / f"{name}-manifest.json").write_text(json.dumps({"scenarios": [f"{name}.json"]}))
    (tmp_path / "r.json").write_text(json.dumps({"requirements": [{"id": "speed", "description": "", "metric": "speed", "operator": "less_than_or_equal", "threshold": 12, "units": "m/s", "subject_agent_id": "ego"}]}))
    given = [str(tmp_path / x) for x in ("b-manifest.json", "c-manifest.json", "r.json")]
    assert cli.main(["compare-runs", *given]) == 1
    assert json.loads(capsys.readouterr().out)["counts"]["new_failures"] == 1
    assert cli.main(["verify", str(tmp_path / "b.json"), given[2], "--svg", str(tmp_path / "b.svg")]) == 0
    (tmp_path / "twice.json").write_text(json.dumps({"scenarios": ["b.json", "b.json"]}))
    with pytest.raises(ValueError):
        json_files.read_manifest(spark, str(tmp_path / "twice.json")).count()


def test_experiment(spark, shard, tmp_path):
    plan = {"experiment_id": "demo", "dataset": {"name": "d", "version": "1", "shards": [shard]}, "candidates": [{"name": "cv", "model": "constant_velocity"}, {"name": "mix", "model": "kinematic_ensemble"}], "evaluation": {"miss_threshold_m": 2.0, "bootstrap_samples": 10}, "comparison": {"baseline": "cv", "candidate": "mix", "bootstrap_samples": 10, "policy": {"max_ade_increase_m": 0.1}}, "outputs": {"directory": "out"}}
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    index = experiment.run(spark, str(tmp_path / "plan.json"))
    assert index["result"]["gate_passed"] and len(index["artifacts"]) == 17 and index["dataset"]["scenario_count"] == 2
    assert all(len(x["sha256"]) == 64 for x in index["artifacts"])
    for key, bad in (("experiment_id", "../x"), ("candidates", plan["candidates"][:1]), ("limit", 0)):
        (tmp_path / "bad.json").write_text(json.dumps(plan | {key: bad}))
        with pytest.raises(ValueError):
            experiment.load(str(tmp_path / "bad.json"))


def test_risk(spark, street):
    lanes, walks, signs, lights = street
    times = [i / 10 for i in range(91)]
    own = track(spark, {"a": [(t, 0, 1) for t in times], "b": [(t, min(t, 3.0), max(0.0, t - 3.0)) for t in times], "p": [(t, 1, 1) for t in times]}, {"p": "pedestrian", "b": "cyclist"})
    rows = [("s", "b", 0, 0, 1.0, i, s / 10, 40.0, 2.0) for i, s in enumerate(forecast.STEPS)]
    points = spark.createDataFrame(rows, "scenario_id string, agent_id string, agent_ord int, mode_index int, confidence double, point_ord int, time_s double, x_m double, y_m double")
    of = scenarios(spark)
    scores = scoring.agent_scores(points, own)
    found = risk.evidence(own, of, forecast.targets(of), points, scores, walks, signs, lights).first()
    assert (found.review_priority, found.motion_class) == ("high", "turning")
    assert found.risk_tags == ["close_interaction", "large_sdc_separation_error", "traffic_control_context", "vulnerable_road_user"]
    assert found.nearby_agents == 2 and found.sdc_separation_error_m > 5
    assert risk.reported(risk.evidence(own, of, forecast.targets(of), points, scores, walks, signs, lights)).first().scene_density_30m == 2
    assert risk.identity(of, points, scores).count() == 0
    assert {r.problem for r in risk.identity(of, points, scores.where("false")).collect()} == {"scenario without scores", "forecast without a score"}
    with pytest.raises(ValueError):
        risk.RiskThresholds(turning_angle_rad=4.0)


def test_map_context_is_made_alone(spark, monkeypatch):
    """near_map_context has what the whole evidence says of the map, and makes none of its other parts; before, it made all."""
    case = queries.Case(spark, "/root/testdata/sf0.001")
    columns = ["scenario_id", "agent_id", "near_crosswalk", "near_control"]
    want = sorted(tuple(r) for r in case.risk.select(*columns).collect())
    for name in ("scene_density", "min_actor_separation", "sdc_interaction", "motion_class"):
        monkeypatch.setattr(risk, name, None)
    found = queries.queries()["near_map_context"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == want and len(want) > 3


def test_drawing():
    one = {"scenario_id": "x", "sdc_agent_id": "a", "tracks": [{"agent_id": "a", "states": [{"x_m": 0.0, "y_m": 0.0}, {"x_m": math.nan, "y_m": 0.0}]}]}
    assert 'stroke-width="4"' in render.svg(one)
    with pytest.raises(ValueError):
        render.svg(one, width=90)
    with pytest.raises(ValueError):
        render.svg(one | {"tracks": []})
