"""Grid joins against all pairs, and what they meet."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from motioncheck.operators import geometry, grid, risk

NAN, INF = math.nan, math.inf


def points_of(spark, n: int, seed: int, span: float = 60.0, odd=True):
    rng = random.Random(seed)
    rows = [(f"s{i % 2}", str(i % 7), i, i / 10, rng.uniform(-span, span), rng.uniform(-span, span)) for i in range(n)]
    # on borders of cells, far away, and nowhere
    rows += [("s0", "7", n + i, 0.0, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (20.0, -20.0), (-40.0, 40.0), (900.0, 3.0), *([(NAN, 1.0), (2.0, INF)] if odd else [])])]
    return spark.createDataFrame(rows, "scenario_id string, agent_id string, state_ord long, time_s double, x_m double, y_m double")


def lanes_of(spark, seed: int, own: bool):
    rng = random.Random(seed)
    rows = [(f"s{i % 2}", i, f"l{i}", [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(rng.randint(1, 5))]) for i in range(30)]
    rows += [("s0", 30, "level", [(-5000.0, 4.0), (5000.0, 4.0)]), ("s0", 31, "upright", [(7.0, -900.0), (7.0, 900.0)]), ("s1", 32, "far", [(0.0, 0.0), (3e6, 2e6)]), ("s0", 33, "still", [(1.0, 1.0), (1.0, 1.0)]), ("s0", 34, "odd", [(NAN, 1.0), (3.0, 1.0)])]
    df = spark.createDataFrame(rows, "scenario_id string, lane_ord long, feature_id string, points array<struct<x_m: double, y_m: double>>")
    return df if own else df.drop("scenario_id")


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("radius", [0.5, 10.0])
def test_lanes_within(spark, own, radius):
    points, lanes = points_of(spark, 80, 1), lanes_of(spark, 2, own)
    segs = geometry.segments(lanes, (*geometry.scope(lanes), "lane_ord", "feature_id"))
    both = points.join(segs, "scenario_id") if own else points.crossJoin(segs)
    want = geometry._projected(both).where(F.col("distance_m") <= radius).groupBy(*geometry.STATE, F.col("feature_id").alias("lane_id")).agg(F.min(F.struct("distance_m", "lane_ord", "seg_ord", "offset_m", "feature_id")).alias("best"))
    found = geometry.lane_distances(points, lanes, radius)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() > 0


def test_states_meet_only_segments_of_their_cells(spark):
    """A map of any size: each state meets the few segments of its cell."""
    lanes = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("feature_id"), F.col("id").alias("lane_ord"), F.array(F.struct((F.col("id") * 50.0).alias("x_m"), F.lit(0.0).alias("y_m")), F.struct((F.col("id") * 50.0 + 40).alias("x_m"), F.lit(9.0).alias("y_m"))).alias("points"))
    points = spark.range(1000).select(F.lit("s").alias("scenario_id"), F.lit("a").alias("agent_id"), F.col("id").alias("state_ord"), F.lit(0.0).alias("time_s"), (F.col("id") * 997.0).alias("x_m"), F.lit(3.0).alias("y_m"))
    met = grid.near_segments(points, geometry.segments(lanes, ("lane_ord", "feature_id")), (), 10.0)
    assert met.count() <= 4 * 1000
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString()


def polygons_of(spark, own: bool):
    rng = random.Random(5)

    def ring(x, y, r, n):
        return [(x + r * math.cos(2 * math.pi * i / n) * (1 if i % 2 else 0.4), y + r * math.sin(2 * math.pi * i / n) * (1 if i % 2 else 0.4)) for i in range(n)]

    rows = [(f"s{i % 2}", i, ring(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(1, 25), rng.choice([3, 4, 8, 11]))) for i in range(14)]
    rows += [("s0", 20, [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)]), ("s0", 21, [(1.0, 1.0)]), ("s1", 22, [(1.0, 1.0), (5.0, 1.0)]), ("s0", 23, [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]), ("s1", 24, [])]
    df = spark.createDataFrame(rows, "scenario_id string, cw_ord long, points array<struct<x_m: double, y_m: double>>")
    return df if own else df.drop("scenario_id")


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("radius", [0.0, 30.0])
def test_polygons_within(spark, own, radius):
    points, polygons = points_of(spark, 80, 3), polygons_of(spark, own)
    want = geometry.polygon_distances(points, geometry.STATE, polygons).where(F.col("distance_m") <= radius)
    found = geometry.polygons_within(points, geometry.STATE, polygons, radius, few=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() > 0


def test_inside_cells_need_no_edges(spark):
    _, edges = geometry._edges(polygons_of(spark, False))
    cells = grid.polygon_cells(edges, ("cw_ord",), 1.0, 2.0, geometry._measured)
    assert cells.where("within").count() > 50 and cells.groupBy("cw_ord").count().agg(F.max("count")).first()[0] <= 19 * 19


@pytest.mark.parametrize("own", [True, False])
def test_nearest_polygon(spark, own):
    points, polygons = points_of(spark, 80, 4), polygons_of(spark, own).where("cw_ord <> 20")
    want = geometry.polygon_distances(points, geometry.STATE, polygons).groupBy(*geometry.STATE).agg(F.min("distance_m").alias("value"))
    found = geometry.nearest_polygon(points, geometry.STATE, polygons, few=0)
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    lone = points.withColumn("scenario_id", F.lit("elsewhere"))
    assert not own or geometry.nearest_polygon(lone, geometry.STATE, polygons, few=0).count() == 0


def test_points_are_measured_where_they_are(spark):
    """Beside a shared map of few edges no row is multiplied, grouped or shuffled by point, which filled a task's memory before."""
    points, polygons = points_of(spark, 80, 9), polygons_of(spark, False)
    points = points.union(points.where("state_ord = 0").selectExpr("scenario_id", "'null'", "state_ord", "time_s", "null", "y_m"))
    joined = geometry._measured(points.crossJoin(geometry._edges(polygons)[1]), (*geometry.STATE, "cw_ord"))
    order = [*geometry.STATE, "cw_ord"]
    close = lambda a, b: (a is None and b is None) or a == pytest.approx(b, rel=1e-14, abs=1e-14, nan_ok=True)

    def same(found, want, on, value):
        found, want = (df.orderBy(*on).collect() for df in (found, want))
        assert len(found) == len(want) > 0 and all(tuple(a[c] for c in on) == tuple(b[c] for c in on) and close(a[value], b[value]) and ("inside" not in a or a.inside == b.inside) for a, b in zip(found, want))

    every, near = geometry.polygon_distances(points, geometry.STATE, polygons, geometry.FEW_EDGES), geometry.nearest_polygon(points, geometry.STATE, polygons)
    same(every, joined, order, "distance_m")
    same(geometry.polygons_within(points, geometry.STATE, polygons, 3.0), joined.where("distance_m <= 3.0"), order, "distance_m")
    same(near, joined.groupBy(*geometry.STATE).agg(F.min("distance_m").alias("value")), list(geometry.STATE), "value")
    for made in (every, near):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Exchange" not in plan and "Join" not in plan
    assert geometry.nearest_polygon(points, geometry.STATE, polygons.where("false")).count() == 0


def crowd(spark, n: int):
    rng = random.Random(6)
    rows = [("s", str(i), 0, 1.0, rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(n)]
    rows += [("s", str(i), 1, 2.0, rng.uniform(0, 50), 0.0) for i in range(0, 12)] + [("s", "0", 2, 3.0, 0.0, 0.0), ("s", "lone", 2, 4.0, 1.0, 1.0), ("s", "odd", 0, 1.0, NAN, 2.0), ("s", "1", 0, 1.0, 5.0, 5.0)]
    return spark.createDataFrame(rows, "scenario_id string, agent_id string, state_ord long, time_s double, x_m double, y_m double")


def test_least_separation(spark):
    states = crowd(spark, 150)
    future = states.withColumn("t", F.round(F.col("time_s") * 1e6).cast("long"))
    plain = risk.min_actor_separation(states, future, few=10**9)
    found = risk.min_actor_separation(states, future, few=20)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and plain.count() >= 150


def test_density_of_a_crowd(spark):
    """Ten thousand agents at an instant meet their neighbours only."""
    n = 10_000
    states = spark.range(n).select(F.lit("s").alias("scenario_id"), F.col("id").cast("string").alias("agent_id"), F.lit(0).alias("state_ord"), F.lit(1.0).alias("time_s"), (F.col("id") % 100 * 12.0).alias("x_m"), (F.floor(F.col("id") / 100) * 12.0).alias("y_m"))
    current = states.withColumnRenamed("time_s", "current_time_s")
    own = current.select("agent_id", F.lit(1).alias("t"), "x_m", "y_m")
    others = states.select(F.lit(1).alias("t"), F.col("x_m").alias("ox"), F.col("y_m").alias("oy"))
    met = grid.around(own, 30.0).count()
    assert met == 9 * n and grid.neighbours(own, others, ("t",), 30.0).count() < 25 * n
    found = {r.agent_id: r.nearby_agents for r in risk.scene_density(states, current, 30.0).collect()}
    assert len(found) == n and found["0"] == 7 and found["5050"] == 20
    apart = risk.min_actor_separation(states, states.withColumn("t", F.round(F.col("time_s") * 1e6).cast("long")))
    assert apart.agg(F.min("min_actor_separation_m"), F.max("min_actor_separation_m"), F.count("*")).first() == (12.0, 12.0, n)


def test_stop_signs_in_order(spark):
    """Forty signs on a track, and one sign of forty lanes: samples are in the order of time, each with a number of its own."""
    states = spark.createDataFrame([("s", "a", i, float(i), 10.0 * i - 5, 0.0) for i in range(45)], "scenario_id string, agent_id string, state_ord long, time_s double, x_m double, y_m double")
    lanes = spark.createDataFrame([("s", i, str(i), [(-10.0, 0.0), (500.0, 0.0)]) for i in range(40)], "scenario_id string, lane_ord long, feature_id string, points array<struct<x_m: double, y_m: double>>")
    signs = [("s", at * (1 << 31), "0", 10.0 * at, 0.0) for at in range(40)] + [("s", 40 * (1 << 31) + k, str(k), 400.0, 0.0) for k in range(40)]
    found = geometry.stop_sign_crossing_speed(states, lanes, spark.createDataFrame(signs, "scenario_id string, sign_ord long, lane_id string, x_m double, y_m double")).orderBy("sample_ord").collect()
    assert [r.sample_ord for r in found] == list(range(80)) and [r.time_s for r in found] == sorted(r.time_s for r in found)
