"""Map-aware signals: lanes, crosswalks, stop signs and signals.

Geometry is exploded into segments, and states meet those of the cells that they are in (grid.py);
a state's nearest segment is a minimum of structs that carry the tie-break, pre-aggregated before
any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncheck.functions.columns import distance
from motioncheck.operators import grid
from motioncheck.sources.stored import stored, with_all

TRACK = ("scenario_id", "agent_id")
STATE = (*TRACK, "state_ord", "time_s")
LANE_RADIUS, STOP_RADIUS, VRU_RADIUS = 10.0, 7.5, 1.0
#: The states of a signal that ask to stop.
STOP_STATES = ("stop", "arrow_stop", "flashing_stop")


def scope(features: DataFrame) -> tuple[str, ...]:
    """The key by which map features belong to scenarios; none if one map is shared by all."""
    return ("scenario_id",) if "scenario_id" in features.columns else ()


def _on_map(points: DataFrame, features: DataFrame) -> DataFrame:
    """points with the features of their scenario, or with all of a shared map."""
    return points.join(features, "scenario_id") if scope(features) else with_all(points, features)


def segments(features: DataFrame, keys: tuple[str, ...], closed: bool = False) -> DataFrame:
    """(keys, seg_ord, ax, ay, bx, by) of a feature's points; closed rings begin with the edge from the last point."""
    p = F.col("points")
    n = F.size(p)
    before = F.when(F.col("seg_ord") == 0, n - 1).otherwise(F.col("seg_ord") - 1) if closed else F.col("seg_ord")
    after = F.col("seg_ord") if closed else F.col("seg_ord") + 1
    steps = F.sequence(F.lit(0), n - (1 if closed else 2))
    found = features.where(n >= (1 if closed else 2)).withColumn("seg_ord", F.explode(steps))
    a, b = F.get("points", before), F.get("points", after)
    return found.select(*keys, "seg_ord", a["x_m"].alias("ax"), a["y_m"].alias("ay"), b["x_m"].alias("bx"), b["y_m"].alias("by"))


def _fraction(x: Column, y: Column) -> Column:
    """Where the nearest point of a segment lies along it; null for a segment with no length."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    squared = dx * dx + dy * dy
    return F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / F.nullif(squared, F.lit(0.0)))))


def _projected(joined: DataFrame) -> DataFrame:
    """points beside segments: distance, signed offset (left of travel is positive), tangent."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    f = _fraction(F.col("x_m"), F.col("y_m"))
    joined = joined.withColumn("f", f).where("f is not null")
    ox, oy = F.col("x_m") - (F.col("ax") + F.col("f") * dx), F.col("y_m") - (F.col("ay") + F.col("f") * dy)
    return joined.withColumn("distance_m", F.hypot(ox, oy)).withColumn("offset_m", (dx * oy - dy * ox) / F.sqrt(dx * dx + dy * dy)).withColumn("tx", dx).withColumn("ty", dy)


def lane_distances(states: DataFrame, lanes: DataFrame, radius: float) -> DataFrame:
    """(state keys, lane_id, best) of the lanes within the radius: distance, lane, segment and offset of each lane's nearest point."""
    own = segments(lanes, (*scope(lanes), "lane_ord", "feature_id"))
    near = _projected(grid.near_segments(states.select(*STATE, "x_m", "y_m"), own, scope(lanes), radius)).where(F.col("distance_m") <= radius)
    return near.groupBy(*STATE, F.col("feature_id").alias("lane_id")).agg(F.min(F.struct("distance_m", "lane_ord", "seg_ord", "offset_m", "feature_id")).alias("best"))


def nearest_lanes(distances: DataFrame) -> DataFrame:
    """Each state's nearest lane of lane_distances(); the first lane and segment win ties."""
    best = distances.groupBy(*STATE).agg(F.min("best").alias("best"))
    return best.select(*TRACK, F.col("state_ord").alias("sample_ord"), "time_s", F.col("best.feature_id").alias("lane_id"), F.col("best.offset_m").alias("lateral_offset_m"), F.col("best.distance_m").alias("distance_m"))


def lane_associations(states: DataFrame, lanes: DataFrame, radius: float = LANE_RADIUS) -> DataFrame:
    """Each state's nearest lane within the radius."""
    return nearest_lanes(lane_distances(states, lanes, radius))


def lane_offset(states: DataFrame, lanes: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """distances: lane_distances() within LANE_RADIUS, where they are known already."""
    near = nearest_lanes(distances) if distances is not None else lane_associations(states, lanes)
    return near.select(*TRACK, "sample_ord", "time_s", F.abs("lateral_offset_m").alias("value"))


def _edges(polygons: DataFrame) -> tuple[tuple[str, ...], DataFrame]:
    """The keys of polygons, and their edges with the number of corners."""
    own = (*scope(polygons), "cw_ord")
    return own, segments(polygons, own, closed=True).withColumn("corners", F.count("*").over(Window.partitionBy(*own)))


def _measured(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, distance_m, inside) of points beside all edges of a polygon."""
    x, y = F.col("x_m"), F.col("y_m")
    f = F.coalesce(_fraction(x, y), F.lit(0.0))
    edge = distance(x, y, F.col("ax") + f * (F.col("bx") - F.col("ax")), F.col("ay") + f * (F.col("by") - F.col("ay")))
    straddles = (F.col("by") > y) != (F.col("ay") > y)
    crossing = (F.col("ax") - F.col("bx")) * (y - F.col("by")) / F.nullif(F.col("ay") - F.col("by"), F.lit(0.0)) + F.col("bx")
    corner = distance(x, y, F.col("bx"), F.col("by"))
    found = joined.groupBy(*keys).agg(F.min(F.when(F.col("corners") < 3, corner).otherwise(edge)).alias("edge_m"), (F.sum(F.when((F.col("corners") >= 3) & straddles & (x < crossing), 1).otherwise(0)) % 2 == 1).alias("inside"))
    return found.select(*keys, F.when(F.col("inside"), 0.0).otherwise(F.col("edge_m")).alias("distance_m"), "inside")


#: Edges of a map that all its points meet; the first ring where there are more, and its growth.
FEW_EDGES, RING, GROWTH = 256, 8.0, 4.0


def polygon_distances(points: DataFrame, keys: tuple[str, ...], polygons: DataFrame, few: int = 0) -> DataFrame:
    """(keys, cw_ord, distance_m, inside) of each point and each polygon of its scenario: even-odd inside is 0, else the least distance to an edge.

    Points are measured where they are if a shared map has no more than `few` edges; keys are of one point each then.
    """
    edges = _edges(polygons)[1]
    rings = _shared_rings(polygons, edges, few)
    if rings is not None:
        return _beside(points, keys, rings)
    return _measured(_on_map(points, edges), (*keys, "cw_ord"))


#: Of a shared map of few edges: each polygon's number, and its edges (ax, ay, bx, by).
Rings = list[tuple[int, np.ndarray]]


def _shared_rings(polygons: DataFrame, edges: DataFrame, few: int) -> Rings | None:
    """The edges of a map that all scenarios share, if they are few and finite."""
    if scope(polygons) or not few:
        return None
    found = edges.select("cw_ord", "ax", "ay", "bx", "by").limit(few + 1).collect()
    if len(found) > few or not all(v is not None and math.isfinite(v) for r in found for v in r):
        return None
    rings: dict[int, list[tuple[float, ...]]] = {}
    for r in found:
        rings.setdefault(r.cw_ord, []).append(r[1:])
    return [(k, np.array(own, dtype=np.float64)) for k, own in rings.items()]


def _ring_distances(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _measured() finds of points beside one polygon: distances and whether they are inside; NaN is larger than numbers."""
    apart, crossings = np.full(len(x), np.nan), np.zeros(len(x), dtype=np.int64)
    for ax, ay, bx, by in ring:
        dx, dy = bx - ax, by - ay
        squared = dx * dx + dy * dy
        if len(ring) < 3:
            f = 1.0
        else:
            f = np.fmax(0.0, np.fmin(1.0, ((x - ax) * dx + (y - ay) * dy) / squared)) if squared > 0 else 0.0
            if ay != by:
                crossings += ((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / (ay - by) + bx)
        ex, ey = (bx, by) if len(ring) < 3 else (ax + f * dx, ay + f * dy)
        apart = np.fmin(apart, np.hypot(x - ex, y - ey))
    inside = crossings % 2 == 1
    return np.where(inside, 0.0, apart), inside


def _beside(points: DataFrame, keys: tuple[str, ...], rings: Rings, nearest: bool = False, radius: float | None = None) -> DataFrame:
    """polygon_distances(), up to the radius if there is one, or (keys, value) of the nearest polygon.

    A point is measured where it is: its row isn't multiplied by edges, and nothing is grouped or shuffled by
    point, so a task holds a batch of points at a time.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, (x, y) = batch.columns[:-2], (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[-2:])
            lacks = np.array(batch.columns[-2].is_null()) | np.array(batch.columns[-1].is_null())
            with np.errstate(invalid="ignore"):
                found = [(k, *_ring_distances(x, y, ring)) for k, ring in rings]
            if nearest:
                yield pa.record_batch([*own, pa.array(np.fmin.reduce([d for _, d, _ in found]), mask=lacks)], names=[*keys, "value"])
                continue
            for k, apart, inside in found:
                at = np.flatnonzero(apart <= radius) if radius is not None else np.arange(len(x))
                at = at[~lacks[at]] if radius is not None else at
                kept = pa.array(at)
                yield pa.record_batch([*[c.take(kept) for c in own], pa.array(np.full(len(at), k, dtype=np.int64)), pa.array(apart[at], mask=lacks[at]), pa.array(inside[at])], names=[*keys, "cw_ord", "distance_m", "inside"])

    schema = points.select(*keys).schema
    if nearest:
        schema = schema.add("value", "double")
        points = points if rings else points.where("false")
    else:
        schema = schema.add("cw_ord", "long").add("distance_m", "double").add("inside", "boolean")
    return points.select(*keys, F.col("x_m").alias("_x"), F.col("y_m").alias("_y")).mapInArrow(measure, schema)


def _few(polygons: DataFrame, edges: DataFrame, few: int) -> bool:
    """Whether no map has more than so many edges."""
    if scope(polygons):
        return not edges.groupBy(*scope(polygons)).agg(F.count("*").alias("n")).where(F.col("n") > few).take(1)
    return edges.limit(few + 1).count() <= few


def polygons_within(points: DataFrame, keys: tuple[str, ...], polygons: DataFrame, radius: float, few: int = FEW_EDGES) -> DataFrame:
    """polygon_distances() of the polygons within the radius, found by cells.

    Cells that no edge comes near answer by themselves; in the others a point is measured against
    its candidate's edges. Points and polygons whose place isn't finite are within no radius. All
    points of a scenario meet its whole map where no map has more than a few edges.
    """
    own, edges = _edges(polygons)
    rings = _shared_rings(polygons, edges, few)
    if rings is not None:
        return _beside(points, keys, rings, radius=radius)
    if _few(polygons, edges, few):
        return polygon_distances(points, keys, polygons).where(F.col("distance_m") <= radius)
    odd = edges.where(~grid.finite("ax", "ay")).select(*own).distinct()
    edges = edges.join(odd, list(own), "left_anti")
    size = max(2 * radius, 1.0)
    met = grid.meet(points, grid.polygon_cells(edges, own, radius, size, _measured), scope(polygons), size)
    sure = met.where("within").select(*keys, "cw_ord", F.lit(0.0).alias("distance_m"), F.lit(True).alias("inside"))
    near = _measured(met.where("not within").join(grid.sized(edges, scope(polygons)), list(own)), (*keys, "cw_ord"))
    return sure.union(near.where(F.col("distance_m") <= radius))


def nearest_polygon(points: DataFrame, keys: tuple[str, ...], polygons: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(keys, value): each point's distance to its scenario's nearest polygon; no row where there is none.

    Polygons are sought in rings: those within a radius are found by cells, and a point that has one is
    done, as all others are further out. The few that have none go on to the next ring.
    """
    own, edges = _edges(polygons)
    least = lambda found: found.groupBy(*keys).agg(F.min("distance_m").alias("value"))
    rings = _shared_rings(polygons, edges, few)
    if rings is not None:
        return _beside(points, keys, rings, nearest=True)
    if _few(polygons, edges, few):
        return least(polygon_distances(points, keys, polygons))
    rest = points.join(polygons.where(F.size("points") > 0).select("scenario_id").distinct(), "scenario_id", "left_semi") if scope(polygons) else points
    reach = lambda df, x, y: df.where(grid.finite(x, y)).agg(F.max(F.abs(x)) + F.max(F.abs(y))).first()[0] or 0.0
    far, radius, parts = reach(points, "x_m", "y_m") + reach(edges, "ax", "ay") + RING, RING, []
    while True:
        parts.append(stored(least(polygons_within(rest, keys, polygons, radius, few))))
        rest = stored(rest.join(parts[-1].select(*keys), list(keys), "left_anti"))
        if radius > far or not rest.take(1):
            break
        radius *= GROWTH
    found = least(polygon_distances(rest, keys, polygons))  # what has no finite place, or only such polygons
    for part in parts:
        found = found.union(part)
    return found


def canvas(points: DataFrame, width: int = 900, height: int = 700, padding: int = 50) -> DataFrame:
    """points (scenario_id, ..., x_m, y_m) with their place px, py on a scenario's drawing: one scale, y upwards; only finite points."""
    if width <= 2 * padding or height <= 2 * padding:
        raise ValueError("the canvas is smaller than its padding")
    inf = float("inf")
    own = points.where(~F.isnan("x_m") & ~F.isnan("y_m") & (F.abs("x_m") < inf) & (F.abs("y_m") < inf))
    span = lambda c: F.greatest(F.lit(1.0), F.max(c) - F.min(c))
    of = own.groupBy("scenario_id").agg(F.min("x_m").alias("x0"), F.min("y_m").alias("y0"), F.least((width - 2 * padding) / span("x_m"), (height - 2 * padding) / span("y_m")).alias("scale"))
    placed = own.join(of, "scenario_id")
    return placed.withColumn("px", padding + (F.col("x_m") - F.col("x0")) * F.col("scale")).withColumn("py", height - padding - (F.col("y_m") - F.col("y0")) * F.col("scale")).drop("x0", "y0", "scale", "x_m", "y_m")


def crosswalk_proximity(states: DataFrame, crosswalks: DataFrame) -> DataFrame:
    return nearest_polygon(states.select(*STATE, "x_m", "y_m"), STATE, crosswalks).withColumnRenamed("state_ord", "sample_ord")


def vru_crosswalk_proximity(states: DataFrame, crosswalks: DataFrame, subjects: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Distance of subjects (scenario_id, agent_id) to road users on foot or bicycle at crosswalks at the same time; a subject counts itself.

    own: the subjects' states, where they are known already.
    """
    on = polygons_within(states.where(F.col("object_type").isin("pedestrian", "cyclist")).select(*STATE, "x_m", "y_m"), (*STATE, "x_m", "y_m"), crosswalks, VRU_RADIUS)
    held = on.select("scenario_id", "time_s", F.col("x_m").alias("vx"), F.col("y_m").alias("vy")).distinct()
    own = (states.join(subjects.select(*TRACK).distinct(), list(TRACK), "left_semi") if own is None else own).select(*STATE, "x_m", "y_m")
    return own.join(held, ["scenario_id", "time_s"]).groupBy(*STATE).agg(F.min(distance(F.col("x_m"), F.col("y_m"), F.col("vx"), F.col("vy"))).alias("value")).withColumnRenamed("state_ord", "sample_ord")


def stop_tangents(stops: DataFrame, lanes: DataFrame, *keys: str) -> DataFrame:
    """stops (keys, lane_id, x_m, y_m) with the tangent of their lane's nearest segment."""
    keys = (*scope(stops), *keys, "lane_id", "x_m", "y_m")
    own = segments(lanes, (*scope(lanes), "feature_id")).withColumnRenamed("feature_id", "lane_id")
    found = _projected(stops.select(*keys).distinct().join(own, [*scope(lanes), "lane_id"]))
    best = found.groupBy(*keys).agg(F.min(F.struct("distance_m", "seg_ord", "tx", "ty")).alias("best"))
    return best.select(*keys[:-2], F.col("x_m").alias("sx"), F.col("y_m").alias("sy"), F.col("best.tx").alias("tx"), F.col("best.ty").alias("ty"))


def _with_previous(states: DataFrame) -> DataFrame:
    w = Window.partitionBy(*TRACK).orderBy("state_ord")
    return states.select(*STATE, "x_m", "y_m", F.lag("x_m").over(w).alias("px"), F.lag("y_m").over(w).alias("py"), F.lag("time_s").over(w).alias("pt"))


def _crossed() -> Column:
    before = (F.col("px") - F.col("sx")) * F.col("tx") + (F.col("py") - F.col("sy")) * F.col("ty")
    after = (F.col("x_m") - F.col("sx")) * F.col("tx") + (F.col("y_m") - F.col("sy")) * F.col("ty")
    return (before <= 0) & (after > 0)


def _near_lanes(states: DataFrame, lanes: DataFrame, stops: DataFrame, distances: DataFrame | None) -> DataFrame:
    """(state keys, lane_id) of states within STOP_RADIUS of a lane with stops."""
    if distances is None:
        own = [*scope(lanes), "lane_id"]
        lanes = lanes.join(stops.select(*own).distinct().withColumnRenamed("lane_id", "feature_id"), [*scope(lanes), "feature_id"], "left_semi")
        distances = lane_distances(states, lanes, STOP_RADIUS)
    return distances.where(F.col("best.distance_m") <= STOP_RADIUS).select(*STATE, "lane_id")


def red_stop_line_violation(states: DataFrame, lanes: DataFrame, signals: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """1 when a state crosses the stop point of a signal that asks to stop at exactly its time, else 0."""
    own = scope(signals)
    red = signals.where(F.col("state").isin(*STOP_STATES)).select(*own, "signal_ord", "time_s", "lane_id", "x_m", "y_m")
    red = red.withColumnsRenamed({"x_m": "sx", "y_m": "sy"}).join(stop_tangents(red, lanes), [*own, "lane_id", "sx", "sy"])
    own = _with_previous(states).where("pt is not null").join(red, [*own, "time_s"])
    near = _near_lanes(states, lanes, signals, distances)
    found = own.join(near, [*STATE, "lane_id"])
    return found.select(*TRACK, (F.col("signal_ord")).alias("sample_ord"), "time_s", F.when(_crossed(), 1.0).otherwise(0.0).alias("value"))


def stop_sign_crossing_speed(states: DataFrame, lanes: DataFrame, signs: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """Speed of the step that crosses a stop sign of a lane nearby; a state may cross several, numbered along the track by state and sign."""
    stops = stop_tangents(signs, lanes, "sign_ord")
    own = _with_previous(states).where("pt is not null").join(_near_lanes(states, lanes, signs, distances), list(STATE)).join(stops, [*scope(signs), "lane_id"])
    pace = distance(F.col("x_m"), F.col("y_m"), F.col("px"), F.col("py")) / (F.col("time_s") - F.col("pt"))
    crossed = own.where(_crossed()).withColumn("nth", F.row_number().over(Window.partitionBy(*TRACK).orderBy("state_ord", "sign_ord")))
    return crossed.select(*TRACK, (F.col("nth") - 1).cast("long").alias("sample_ord"), "time_s", pace.alias("value"))
