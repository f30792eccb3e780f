"""DuckDB SQL with the same rows as the motion queries, built from named subqueries."""

from __future__ import annotations

import re

from motioncheck.operators.compare import POISSON
from motioncheck.operators.forecast import STEPS
from motioncheck.sources.views import REQUIREMENTS

_HOLDS = "CASE WHEN isnan({v}) THEN false WHEN {o} = 'greater_than' THEN {v} > {t} WHEN {o} = 'greater_than_or_equal' THEN {v} >= {t} WHEN {o} = 'less_than' THEN {v} < {t} ELSE {v} <= {t} END"


def _holds(value: str, threshold: str = "threshold") -> str:
    return _HOLDS.format(v=value, o="operator", t=threshold)


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


def _wrap(x: str) -> str:
    return f"CASE WHEN {x} >= -pi() AND {x} <= pi() THEN {x} ELSE {x} - 2 * pi() * floor(({x} + pi()) / (2 * pi())) END"


_VALUES = ", ".join(f"({i}, {_text(r[0])}, {_text(r[1])}, {_text(r[2])}, {r[3]}::DOUBLE, {_text(r[4])}, {_text(r[5])})" for i, r in enumerate(REQUIREMENTS))
_AGENT = "CASE WHEN {s} = '@sdc' THEN sdc WHEN starts_with({s}, '@prediction:') THEN list_extract(preds, CASE WHEN {n} < 0 THEN {n} ELSE {n} + 1 END) WHEN starts_with({s}, '@object_of_interest:') THEN list_extract(oois, CASE WHEN {n} < 0 THEN {n} ELSE {n} + 1 END) ELSE {s} END"


def _agent(s: str) -> str:
    return _AGENT.format(s=s, n=f"try_cast(string_split({s}, ':')[2] AS INT)")


#: Subqueries; a name ends in _c where it is over the candidate run.
PARTS = {
    "states": "SELECT 's' || (user_id // 10)::VARCHAR AS scenario_id, user_id::VARCHAR AS agent_id, CASE user_id % 10 WHEN 8 THEN 'pedestrian' WHEN 9 THEN 'cyclist' ELSE 'vehicle' END AS object_type, (user_id % 10)::BIGINT AS track_ord, rn AS state_ord, event_id, micros, rn / 10e0 AS time_s, rn + floor(value) / 8e0 AS x_m, 4e0 * (user_id % 10) + (event_id % 16) / 8e0 AS y_m FROM (SELECT *, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)",
    "irregular": "SELECT * REPLACE ((micros - (SELECT min(micros) FROM states)) / 1e6 AS time_s) FROM states",
    "moved": "SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN x_m + 40e0 ELSE x_m END AS x_m) FROM states",
    "states_c": "SELECT * FROM moved WHERE scenario_id <> 's1' UNION ALL SELECT * REPLACE ('extra' AS scenario_id) FROM moved WHERE scenario_id = 's0'",
    "scen": "SELECT scenario_id, min(agent_id) FILTER (track_ord = 0) AS sdc, list(DISTINCT {'o': track_ord, 'a': agent_id}) FILTER (track_ord IN (1, 2, 8, 9)) AS p, list(DISTINCT {'o': track_ord, 'a': agent_id}) FILTER (track_ord = 3) AS q FROM states GROUP BY scenario_id",
    "scenarios": "SELECT scenario_id, sdc, coalesce(list_transform(list_sort(p), lambda x: x.a), []) AS preds, coalesce(list_transform(list_sort(q), lambda x: x.a), []) AS oois FROM scen",
    "lanes": "SELECT n_nationkey::BIGINT AS k, n_nationkey::VARCHAR AS feature_id FROM nation",
    "lane_seg": "SELECT k, feature_id, 0 AS seg, 0e0 AS ax, 4e0 * k AS ay, 64e0 AS bx, 4e0 * k + 1 AS by_ FROM lanes UNION ALL SELECT k, feature_id, 1, 64e0, 4e0 * k + 1, 160e0, 4e0 * k FROM lanes",
    "cw_edge": "SELECT r_regionkey::BIGINT AS cw, unnest([{'ax': 10 + 20e0 * r_regionkey, 'ay': 40e0, 'bx': 10 + 20e0 * r_regionkey, 'b': 0e0}, {'ax': 10 + 20e0 * r_regionkey, 'ay': 0e0, 'bx': 12 + 20e0 * r_regionkey, 'b': 0e0}, {'ax': 12 + 20e0 * r_regionkey, 'ay': 0e0, 'bx': 12 + 20e0 * r_regionkey, 'b': 40e0}, {'ax': 12 + 20e0 * r_regionkey, 'ay': 40e0, 'bx': 10 + 20e0 * r_regionkey, 'b': 40e0}], max_depth := 2) FROM region",
    "signs": "SELECT n_nationkey::BIGINT AS sign_ord, n_nationkey::VARCHAR AS lane_id, 30e0 AS sx, 4e0 * n_nationkey + 0.5e0 AS sy FROM nation",
    "lights": "SELECT (s * 25 + n_nationkey)::BIGINT AS signal_ord, s / 10e0 AS time_s, n_nationkey::VARCHAR AS lane_id, CASE WHEN (s // 10 + n_nationkey) % 3 = 0 THEN 'stop' ELSE 'go' END AS state, 48e0 AS sx, 4e0 * n_nationkey + 0.75e0 AS sy FROM nation, range(0, 91) AS t(s)",
    "requirements": f"SELECT * FROM (VALUES {_VALUES}) AS t(req_ord, requirement_id, metric, operator, threshold, subject, other)",
    "resolved": f"SELECT scenario_id, req_ord::BIGINT AS req_ord, requirement_id, metric, operator, threshold, {_agent('subject')} AS agent_id, CASE WHEN other IS NOT NULL THEN {_agent('other')} END AS other_id FROM scenarios, requirements",
    "sdc_pairs": "SELECT scenario_id, sdc AS agent_id, unnest(preds) AS other_id FROM scenarios WHERE sdc IS NOT NULL",
    "pairs": "SELECT DISTINCT scenario_id, agent_id, other_id FROM resolved WHERE metric IN ('separation', 'time_to_collision')",
    "lagged": "SELECT *, lag(x_m) OVER w AS px, lag(y_m) OVER w AS py, lag(time_s) OVER w AS pt FROM states WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY state_ord)",
    "speed": "SELECT scenario_id, agent_id, state_ord AS sample_ord, time_s, sqrt((x_m - px) * (x_m - px) + (y_m - py) * (y_m - py)) / (time_s - pt) AS value FROM lagged WHERE pt IS NOT NULL",
    "acceleration": "SELECT * FROM (SELECT scenario_id, agent_id, sample_ord, time_s, (value - lag(value) OVER w) / (time_s - lag(time_s) OVER w) AS value FROM speed WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY sample_ord)) WHERE value IS NOT NULL",
    "jerk": "SELECT * FROM (SELECT scenario_id, agent_id, sample_ord, time_s, (value - lag(value) OVER w) / (time_s - lag(time_s) OVER w) AS value FROM acceleration WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY sample_ord)) WHERE value IS NOT NULL",
    "seg_state": "SELECT s.scenario_id, s.agent_id, s.state_ord, s.time_s, s.x_m, s.y_m, k, feature_id, seg, ax, ay, bx - ax AS dx, by_ - ay AS dy, greatest(0e0, least(1e0, ((x_m - ax) * (bx - ax) + (y_m - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS f FROM states s, lane_seg",
    "lane_proj": "SELECT *, sqrt(ox * ox + oy * oy) AS dist, (dx * oy - dy * ox) / sqrt(dx * dx + dy * dy) AS off FROM (SELECT *, x_m - (ax + f * dx) AS ox, y_m - (ay + f * dy) AS oy FROM seg_state)",
    "lane_assoc": "SELECT scenario_id, agent_id, state_ord AS sample_ord, time_s, feature_id AS lane_id, off AS lateral_offset_m, dist AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id, state_ord ORDER BY dist, k, seg) AS n FROM lane_proj) WHERE n = 1 AND dist <= 10",
    "lane_near": "SELECT scenario_id, agent_id, state_ord, feature_id AS lane_id FROM lane_proj GROUP BY ALL HAVING min(dist) <= 7.5",
    "cw_state": "SELECT scenario_id, agent_id, object_type, state_ord, time_s, x_m, y_m, cw, CASE WHEN count(*) FILTER ((b > y_m) <> (ay > y_m) AND x_m < (ax - bx) * (y_m - b) / nullif(ay - b, 0) + bx) % 2 = 1 THEN 0e0 ELSE min(sqrt((x_m - qx) * (x_m - qx) + (y_m - qy) * (y_m - qy))) END AS dist FROM (SELECT *, ax + f * (bx - ax) AS qx, ay + f * (b - ay) AS qy FROM (SELECT s.*, e.*, greatest(0e0, least(1e0, ((x_m - ax) * (bx - ax) + (y_m - ay) * (b - ay)) / ((bx - ax) * (bx - ax) + (b - ay) * (b - ay)))) AS f FROM states s, cw_edge e)) GROUP BY ALL",
    "crosswalk": "SELECT scenario_id, agent_id, state_ord AS sample_ord, time_s, min(dist) AS value FROM cw_state GROUP BY ALL",
    "vru": "SELECT DISTINCT scenario_id, time_s, x_m AS vx, y_m AS vy FROM cw_state WHERE object_type IN ('pedestrian', 'cyclist') AND dist <= 1",
    "vru_crosswalk": "SELECT s.scenario_id, s.agent_id, s.state_ord AS sample_ord, s.time_s, min(sqrt((x_m - vx) * (x_m - vx) + (y_m - vy) * (y_m - vy))) AS value FROM states s JOIN vru USING (scenario_id, time_s) GROUP BY ALL",
    "stop_points": "SELECT DISTINCT lane_id, sx, sy FROM lights UNION SELECT DISTINCT lane_id, sx, sy FROM signs",
    "tangents": "SELECT lane_id, sx, sy, dx AS tx, dy AS ty FROM (SELECT *, row_number() OVER (PARTITION BY lane_id, sx, sy ORDER BY sqrt((sx - ax - f * dx) ** 2 + (sy - ay - f * dy) ** 2), seg) AS n FROM (SELECT p.*, seg, ax, ay, bx - ax AS dx, by_ - ay AS dy, greatest(0e0, least(1e0, ((sx - ax) * (bx - ax) + (sy - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS f FROM stop_points p JOIN lane_seg ON feature_id = lane_id)) WHERE n = 1",
    "red": "SELECT l.scenario_id, l.agent_id, signal_ord AS sample_ord, l.time_s, CASE WHEN (px - sx) * tx + (py - sy) * ty <= 0 AND (x_m - sx) * tx + (y_m - sy) * ty > 0 THEN 1e0 ELSE 0e0 END AS value FROM lagged l JOIN lights g ON g.time_s = l.time_s AND state IN ('stop', 'arrow_stop', 'flashing_stop') JOIN tangents USING (lane_id, sx, sy) JOIN lane_near n ON n.scenario_id = l.scenario_id AND n.agent_id = l.agent_id AND n.state_ord = l.state_ord AND n.lane_id = lane_id WHERE pt IS NOT NULL",
    "stop_speed": "SELECT l.scenario_id, l.agent_id, row_number() OVER (PARTITION BY l.scenario_id, l.agent_id ORDER BY l.state_ord, sign_ord) - 1 AS sample_ord, l.time_s, sqrt((x_m - px) ** 2 + (y_m - py) ** 2) / (l.time_s - pt) AS value FROM lagged l JOIN lane_near n ON n.scenario_id = l.scenario_id AND n.agent_id = l.agent_id AND n.state_ord = l.state_ord JOIN signs g ON g.lane_id = n.lane_id JOIN tangents t ON t.lane_id = g.lane_id AND t.sx = g.sx AND t.sy = g.sy WHERE pt IS NOT NULL AND (px - g.sx) * tx + (py - g.sy) * ty <= 0 AND (x_m - g.sx) * tx + (y_m - g.sy) * ty > 0",
    "samples": "SELECT r.scenario_id, req_ord, sample_ord, time_s, value FROM resolved r JOIN (SELECT 'speed' AS m, * FROM speed UNION ALL SELECT 'acceleration', * FROM acceleration UNION ALL SELECT 'jerk', * FROM jerk UNION ALL SELECT 'lane_lateral_offset', scenario_id, agent_id, sample_ord, time_s, abs(lateral_offset_m) FROM lane_assoc UNION ALL SELECT 'crosswalk_proximity', * FROM crosswalk UNION ALL SELECT 'vru_crosswalk_proximity', * FROM vru_crosswalk UNION ALL SELECT 'red_stop_line_violation', * FROM red UNION ALL SELECT 'stop_sign_crossing_speed', * FROM stop_speed) x ON x.m = r.metric AND x.scenario_id = r.scenario_id AND x.agent_id = r.agent_id UNION ALL SELECT r.scenario_id, req_ord, sample_ord, time_s, value FROM resolved r JOIN separation s ON metric = 'separation' AND s.scenario_id = r.scenario_id AND s.agent_id = r.agent_id AND s.other_id = r.other_id UNION ALL SELECT r.scenario_id, req_ord, sample_ord, time_s, value FROM resolved r JOIN ttc s ON metric = 'time_to_collision' AND s.scenario_id = r.scenario_id AND s.agent_id = r.agent_id AND s.other_id = r.other_id",
    "judged": f"SELECT s.*, requirement_id, operator, threshold, {_holds('value')} AS met FROM samples s JOIN resolved r USING (scenario_id, req_ord)",
    "results": "SELECT scenario_id, req_ord, requirement_id, coalesce(n, 0) AS evaluated_samples, coalesce(bad, 0) AS failed_samples, lo AS observed_min, hi AS observed_max, req_ord < 6 OR coalesce(n, 0) > 0 AS applicable, CASE WHEN req_ord < 6 OR coalesce(n, 0) > 0 THEN coalesce(bad, 0) = 0 END AS passed, CASE WHEN req_ord >= 6 AND coalesce(n, 0) = 0 THEN CASE metric WHEN 'lane_lateral_offset' THEN 'subject is never within 10 m of a lane center' WHEN 'vru_crosswalk_proximity' THEN 'no pedestrian or cyclist is observed in a mapped crosswalk context' WHEN 'red_stop_line_violation' THEN 'subject is not aligned with an active stop-state signal' WHEN 'stop_sign_crossing_speed' THEN 'subject does not cross a mapped stop-sign position' END END AS not_applicable_reason FROM resolved LEFT JOIN (SELECT scenario_id, req_ord, count(*) AS n, count(*) FILTER (NOT met) AS bad, min(value) AS lo, max(value) AS hi FROM judged GROUP BY ALL) USING (scenario_id, req_ord)",
    "bad_steps": "SELECT *, min(CASE WHEN step > 0 THEN step END) OVER (PARTITION BY scenario_id, req_ord) AS nominal FROM (SELECT *, time_s - lag(time_s) OVER (PARTITION BY scenario_id, req_ord ORDER BY sample_ord) AS step FROM judged WHERE NOT met)",
    "islands": "SELECT *, sum(CASE WHEN step IS NULL OR step > 1.5 * nominal THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id, req_ord ORDER BY sample_ord ROWS UNBOUNDED PRECEDING) AS island FROM bad_steps",
    "intervals": "SELECT scenario_id, req_ord, requirement_id, min(time_s) AS start_time_s, max(time_s) AS end_time_s, count(*) AS sample_count, CASE WHEN starts_with(any_value(operator), 'greater') THEN min(value) ELSE max(value) END AS worst_value, any_value(threshold) AS threshold FROM islands GROUP BY scenario_id, req_ord, requirement_id, island",
    "tracks_i": "SELECT scenario_id, track_ord, agent_id, count(*) AS n_states, count(step) AS steps, max(step) AS longest, median(step) AS med FROM (SELECT *, time_s - lag(time_s) OVER (PARTITION BY scenario_id, agent_id ORDER BY state_ord) AS step FROM irregular) GROUP BY ALL",
    "quality": "SELECT scenario_id, 'INSUFFICIENT_TRACK_SAMPLES' AS code, 'error' AS severity, list(agent_id ORDER BY track_ord) AS agent_ids FROM tracks_i WHERE n_states < 2 GROUP BY scenario_id UNION ALL SELECT scenario_id, 'IRREGULAR_SAMPLING', 'warning', list(agent_id ORDER BY track_ord) FROM tracks_i WHERE steps >= 2 AND longest > 1.5 * med GROUP BY scenario_id UNION ALL SELECT scenario_id, 'NO_MAP_FEATURES', 'info', [] FROM scenarios UNION ALL SELECT DISTINCT scenario_id, 'PARTIAL_REPORTED_VELOCITY', 'info', [] FROM irregular",
    "swept": "SELECT scenario_id, req_ord, operator, unnest([threshold - d, threshold, threshold + d]) AS swept FROM (SELECT *, CASE WHEN threshold = 0 THEN 0.1e0 ELSE 0.1e0 * abs(threshold) END AS d FROM resolved) JOIN results USING (scenario_id, req_ord) WHERE applicable",
    "swept_wide": "SELECT r.scenario_id, r.req_ord, operator, threshold + o / 8e0 * CASE WHEN threshold = 0 THEN 1e0 ELSE abs(threshold) END AS swept FROM resolved r JOIN results USING (scenario_id, req_ord) CROSS JOIN (SELECT unnest(range(-8, 9)) AS o) WHERE applicable",
    "transitions": "SELECT scenario_id, req_ord, b.requirement_id, b.failed_samples AS baseline_failed_samples, c.failed_samples AS candidate_failed_samples, b.st AS baseline_status, c.st AS candidate_status, CASE WHEN b.st = c.st THEN 'UNCHANGED_' || b.st WHEN c.st = 'FAIL' THEN 'NEW_FAILURE' WHEN b.st = 'FAIL' AND c.st = 'PASS' THEN 'RESOLVED' WHEN c.st = 'NOT_APPLICABLE' THEN 'LOST_APPLICABILITY' ELSE 'NEWLY_APPLICABLE_PASS' END AS classification FROM (SELECT *, CASE WHEN passed IS NULL THEN 'NOT_APPLICABLE' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS st FROM results) b JOIN (SELECT *, CASE WHEN passed IS NULL THEN 'NOT_APPLICABLE' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS st FROM results_c) c USING (scenario_id, req_ord)",
    "changes": "(SELECT scenario_id, 'missing' AS kind FROM states EXCEPT SELECT scenario_id, 'missing' FROM states_c) UNION ALL (SELECT scenario_id, 'added' FROM states_c EXCEPT SELECT scenario_id, 'added' FROM states)",
    "targets": "SELECT scenario_id, unnest(range(0, len(preds))) AS agent_ord, unnest(preds) AS agent_id FROM scenarios",
    "hist": "SELECT scenario_id, agent_id, max(time_s) FILTER (b = 0) AS t0, max(x_m) FILTER (b = 0) AS x0, max(y_m) FILTER (b = 0) AS y0, max(time_s) FILTER (b = 1) AS t1, max(x_m) FILTER (b = 1) AS x1, max(y_m) FILTER (b = 1) AS y1, max(time_s) FILTER (b = 2) AS t2, max(x_m) FILTER (b = 2) AS x2, max(y_m) FILTER (b = 2) AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY state_ord DESC) - 1 AS b FROM states JOIN targets USING (scenario_id, agent_id) WHERE time_s <= 1) GROUP BY ALL",
    "moving": "SELECT *, coalesce(rax * least(1, CASE WHEN sqrt(rax * rax + ray * ray) > 0 THEN 4 / sqrt(rax * rax + ray * ray) ELSE 1 END), 0) AS ax, coalesce(ray * least(1, CASE WHEN sqrt(rax * rax + ray * ray) > 0 THEN 4 / sqrt(rax * rax + ray * ray) ELSE 1 END), 0) AS ay FROM (SELECT *, (vx - (x1 - x2) / (t1 - t2)) / (t0 - t1) AS rax, (vy - (y1 - y2) / (t1 - t2)) / (t0 - t1) AS ray FROM (SELECT *, (x0 - x1) / (t0 - t1) AS vx, (y0 - y1) / (t0 - t1) AS vy FROM hist))",
    "steps": f"SELECT unnest(range(0, 16)) AS point_ord, unnest({list(STEPS)}) / 10e0 AS time_s",
    "cv": "SELECT scenario_id, agent_id, agent_ord, point_ord, time_s, x0 + vx * (time_s - t0) AS x_m, y0 + vy * (time_s - t0) AS y_m FROM moving JOIN targets USING (scenario_id, agent_id), steps",
    "ca": "SELECT scenario_id, agent_id, agent_ord, point_ord, time_s, x0 + vx * (time_s - t0) + 0.5e0 * ax * (time_s - t0) ** 2 AS x_m, y0 + vy * (time_s - t0) + 0.5e0 * ay * (time_s - t0) ** 2 AS y_m FROM moving JOIN targets USING (scenario_id, agent_id), steps",
    "ensemble": "SELECT scenario_id, agent_id, agent_ord, 0 AS mode_index, 1 / 3e0 AS confidence, point_ord, time_s, x_m, y_m FROM cv UNION ALL SELECT scenario_id, agent_id, agent_ord, 1, 1 / 3e0, point_ord, time_s, x_m, y_m FROM ca UNION ALL SELECT scenario_id, agent_id, agent_ord, 2, 1 / 3e0, point_ord, time_s, x_m, y_m FROM cv",
    "cv_points": "SELECT scenario_id, agent_id, agent_ord, 0 AS mode_index, 1e0 AS confidence, point_ord, time_s, x_m, y_m FROM cv",
    "errors": "SELECT p.*, sqrt((p.x_m - s.x_m) ** 2 + (p.y_m - s.y_m) ** 2) AS error_m FROM ensemble p JOIN states s ON s.scenario_id = p.scenario_id AND s.agent_id = p.agent_id AND round(s.time_s * 1e6)::BIGINT = round(p.time_s * 1e6)::BIGINT",
    "modes": "SELECT scenario_id, agent_id, mode_index, avg(error_m) AS ade_m, arg_max(error_m, point_ord) AS fde_m, count(*) AS evaluated_points FROM errors GROUP BY ALL",
    "scores": "SELECT scenario_id, agent_id, object_type, n AS modes, evaluated_points, 16 AS expected_points, ade_m AS min_ade_m, fde AS min_fde_m, fde > 2 AS miss, mode_index AS best_mode_index, evaluated_points / 16e0 AS ground_truth_coverage FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY ade_m, mode_index) AS r, count(*) OVER (PARTITION BY scenario_id, agent_id) AS n, min(fde_m) OVER (PARTITION BY scenario_id, agent_id) AS fde FROM modes) JOIN (SELECT DISTINCT scenario_id, agent_id, object_type FROM states) USING (scenario_id, agent_id) WHERE r = 1",
    "deltas": "SELECT scenario_id, agent_id, c.object_type, b.min_ade_m AS baseline_min_ade_m, c.min_ade_m AS candidate_min_ade_m, c.min_ade_m - b.min_ade_m AS min_ade_delta_m, c.min_fde_m - b.min_fde_m AS min_fde_delta_m, c.miss::INT - b.miss::INT AS miss_delta, c.best_mode_index AS candidate_best_mode_index FROM scores_v b JOIN scores c USING (scenario_id, agent_id)",
    "resampled": "SELECT m.metric, m.metric_ord, scenario_id, agent_id, m.value FROM (SELECT scenario_id, agent_id, unnest([{'metric': 'min_ade_m', 'metric_ord': 0, 'value': min_ade_m}, {'metric': 'min_fde_m', 'metric_ord': 1, 'value': min_fde_m}, {'metric': 'miss', 'metric_ord': 2, 'value': miss::DOUBLE}]) AS m FROM scores)",
    "paired": "SELECT m.metric, m.metric_ord, scenario_id, agent_id, m.value FROM (SELECT scenario_id, agent_id, unnest([{'metric': 'min_ade_delta_m', 'metric_ord': 0, 'value': min_ade_delta_m}, {'metric': 'min_fde_delta_m', 'metric_ord': 1, 'value': min_fde_delta_m}, {'metric': 'miss_delta', 'metric_ord': 2, 'value': miss_delta::DOUBLE}]) AS m FROM deltas)",
    "messages": "SELECT * FROM (VALUES ('INSUFFICIENT_TRACK_SAMPLES', 'Some tracks contain fewer than two valid states and cannot support derived metrics.'), ('IRREGULAR_SAMPLING', 'One or more tracks contain time gaps greater than 1.5 times their median step.'), ('PARTIAL_REPORTED_VELOCITY', 'Reported velocity is incomplete; position-derived kinematics remain available.'), ('NO_MAP_FEATURES', 'No map features are attached; map-aware requirements are not applicable.')) AS t(code, message)",
    "notes": "SELECT r.scenario_id, req_ord, array_to_string(list(code || ': ' || message ORDER BY code), '; ') AS quality_annotations FROM resolved r JOIN quality q ON q.scenario_id = r.scenario_id AND (len(agent_ids) = 0 OR list_contains(agent_ids, agent_id) OR list_contains(agent_ids, other_id)) JOIN messages USING (code) GROUP BY ALL",
    "graded": "SELECT s.scenario_id, s.req_ord, s.requirement_id, CASE WHEN NOT applicable THEN 'not_applicable' WHEN evaluated_samples < 2 OR coalesce(e, false) THEN 'low' WHEN evaluated_samples < 5 OR coalesce(w, false) THEN 'medium' ELSE 'high' END AS evidence_confidence FROM results s LEFT JOIN (SELECT r.scenario_id, req_ord, bool_or(severity = 'error') AS e, bool_or(severity = 'warning') AS w FROM resolved r JOIN quality q ON q.scenario_id = r.scenario_id AND (len(agent_ids) = 0 OR list_contains(agent_ids, agent_id) OR list_contains(agent_ids, other_id)) GROUP BY ALL) m ON m.scenario_id = s.scenario_id AND m.req_ord = s.req_ord",
    "ext": "SELECT 's0' AS scenario_id, vec_id::VARCHAR AS agent_id, p // 32 AS mode_index, (p % 32) // 2 AS point_ord, (2 - p // 32 + vec_id % 3)::DOUBLE AS confidence, max(v::DOUBLE) FILTER (p % 2 = 0) AS x_m, max(v::DOUBLE) FILTER (p % 2 = 1) AS y_m FROM (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding[:64]) AS v FROM embeddings WHERE embedding IS NOT NULL) GROUP BY ALL",
    "best": "SELECT e.scenario_id, e.agent_id, point_ord, round(time_s * 1e6)::BIGINT AS t, x_m AS hx, y_m AS hy FROM ensemble e JOIN scores s ON s.scenario_id = e.scenario_id AND s.agent_id = e.agent_id AND s.best_mode_index = e.mode_index",
    "current_": "SELECT scenario_id, agent_id, arg_max(state_ord, state_ord) AS state_ord, arg_max(x_m, state_ord) AS x_m, arg_max(y_m, state_ord) AS y_m FROM states JOIN targets USING (scenario_id, agent_id) WHERE time_s <= 1 + 1e-6 GROUP BY ALL",
    "keyed": "SELECT *, round(time_s * 1e6)::BIGINT AS t FROM states",
    "future": "SELECT k.* FROM keyed k SEMI JOIN best b ON b.scenario_id = k.scenario_id AND b.agent_id = k.agent_id AND b.t = k.t",
    "density": "SELECT c.scenario_id, c.agent_id, count(*) FILTER (k.agent_id <> c.agent_id AND sqrt((c.x_m - k.x_m) ** 2 + (c.y_m - k.y_m) ** 2) <= 30) AS nearby_agents FROM current_ c LEFT JOIN keyed k ON k.scenario_id = c.scenario_id AND k.t = 1000000 GROUP BY ALL",
    "actor": "SELECT f.scenario_id, f.agent_id, min(sqrt((f.x_m - k.x_m) ** 2 + (f.y_m - k.y_m) ** 2)) AS min_actor_separation_m FROM future f JOIN keyed k ON k.scenario_id = f.scenario_id AND k.t = f.t AND k.agent_id <> f.agent_id GROUP BY ALL",
    "sdc_i": "SELECT b.scenario_id, b.agent_id, min(sqrt((o.x_m - s.x_m) ** 2 + (o.y_m - s.y_m) ** 2)) AS min_sdc_separation_m, max(abs(sqrt((hx - s.x_m) ** 2 + (hy - s.y_m) ** 2) - sqrt((o.x_m - s.x_m) ** 2 + (o.y_m - s.y_m) ** 2))) AS sdc_separation_error_m FROM best b JOIN keyed o ON o.scenario_id = b.scenario_id AND o.agent_id = b.agent_id AND o.t = b.t JOIN scenarios c ON c.scenario_id = b.scenario_id JOIN keyed s ON s.scenario_id = b.scenario_id AND s.agent_id = c.sdc AND s.t = b.t WHERE c.sdc <> b.agent_id GROUP BY ALL",
    "path": "SELECT *, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM (SELECT scenario_id, agent_id, -1 AS ord, x_m, y_m FROM current_ UNION ALL SELECT scenario_id, agent_id, state_ord, x_m, y_m FROM future) WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY ord)",
    "bearings": "SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 0.1 THEN atan2(dy, dx) END AS bearing FROM path",
    "turned": "SELECT scenario_id, agent_id, sqrt((arg_min(x_m, ord) - arg_max(x_m, ord)) ** 2 + (arg_min(y_m, ord) - arg_max(y_m, ord)) ** 2) AS displacement_m, count(bearing) AS n, (arg_max(bearing, ord) FILTER (bearing IS NOT NULL)) - (arg_min(bearing, ord) FILTER (bearing IS NOT NULL)) AS turn FROM bearings GROUP BY ALL",
    "motion": f"SELECT scenario_id, agent_id, displacement_m, CASE WHEN displacement_m <= 2 THEN 'stationary' WHEN n >= 2 AND abs({_wrap('turn')}) >= 0.35 THEN 'turning' ELSE 'straight' END AS motion_class FROM turned",
    "nearmap": "SELECT f.scenario_id, f.agent_id, bool_or(c.dist <= 5) AS near_crosswalk, any_value(g.near_control) AS near_control FROM future f JOIN cw_state c ON c.scenario_id = f.scenario_id AND c.agent_id = f.agent_id AND c.state_ord = f.state_ord JOIN (SELECT scenario_id, agent_id, bool_or(sqrt((x_m - sx) ** 2 + (y_m - sy) ** 2) <= 10) AS near_control FROM future, stop_points GROUP BY ALL) g ON g.scenario_id = f.scenario_id AND g.agent_id = f.agent_id GROUP BY f.scenario_id, f.agent_id",
    "marked": "SELECT s.*, nearby_agents, min_actor_separation_m, min_sdc_separation_m, sdc_separation_error_m, displacement_m, motion_class, coalesce(near_crosswalk, false) AS near_crosswalk, coalesce(near_control, false) AS near_control, coalesce(min_actor_separation_m <= 5, false) AS close, coalesce(sdc_separation_error_m >= 5, false) AS off FROM scores s LEFT JOIN density USING (scenario_id, agent_id) LEFT JOIN actor USING (scenario_id, agent_id) LEFT JOIN sdc_i USING (scenario_id, agent_id) LEFT JOIN motion USING (scenario_id, agent_id) LEFT JOIN nearmap USING (scenario_id, agent_id)",
    "risk": "SELECT *, list_filter([CASE WHEN close THEN 'close_interaction' END, CASE WHEN nearby_agents >= 10 THEN 'dense_scene' END, CASE WHEN off THEN 'large_sdc_separation_error' END, CASE WHEN near_crosswalk THEN 'crosswalk_context' END, CASE WHEN near_control THEN 'traffic_control_context' END, CASE WHEN object_type IN ('pedestrian', 'cyclist') THEN 'vulnerable_road_user' END], lambda x: x IS NOT NULL) AS tags, CASE WHEN miss AND (close OR off OR near_crosswalk OR near_control) THEN 'high' WHEN miss OR close OR off OR near_crosswalk OR near_control THEN 'medium' ELSE 'low' END AS review_priority FROM marked",
}


def _pair_parts(pairs: str, tag: str) -> dict[str, str]:
    """Signals of some pairs."""
    w = "WINDOW w AS (PARTITION BY scenario_id, agent_id, other_id ORDER BY sample_ord)"
    return {
        f"aligned{tag}": f"SELECT a.scenario_id, a.agent_id, p.other_id, a.state_ord AS sample_ord, a.time_s, a.x_m, a.y_m, b.x_m AS other_x_m, b.y_m AS other_y_m FROM {pairs} p JOIN states a USING (scenario_id, agent_id) JOIN states b ON b.scenario_id = a.scenario_id AND b.agent_id = p.other_id AND b.time_s = a.time_s",
        f"separation{tag}": f"SELECT scenario_id, agent_id, other_id, sample_ord, time_s, sqrt((x_m - other_x_m) * (x_m - other_x_m) + (y_m - other_y_m) * (y_m - other_y_m)) AS value FROM aligned{tag}",
        f"closing{tag}": f"SELECT * FROM (SELECT scenario_id, agent_id, other_id, sample_ord, time_s, value AS apart, -(value - lag(value) OVER w) / (time_s - lag(time_s) OVER w) AS value FROM separation{tag} {w}) WHERE value IS NOT NULL",
        f"ttc{tag}": f"SELECT scenario_id, agent_id, other_id, sample_ord, time_s, CASE WHEN value > 0 THEN apart / value ELSE 'inf'::DOUBLE END AS value FROM closing{tag}",
    }


PARTS |= _pair_parts("pairs", "") | _pair_parts("sdc_pairs", "_s")
#: The chain of a candidate run or of another forecast is the same over other names.
_CANDIDATE = ("scen", "scenarios", "resolved", "pairs", "lagged", "speed", "acceleration", "jerk", "seg_state", "lane_proj", "lane_assoc", "lane_near", "cw_state", "crosswalk", "vru", "vru_crosswalk", "red", "stop_speed", "aligned", "separation", "closing", "ttc", "samples", "judged", "results")
_FORECAST = ("errors", "modes", "scores")


def _renamed(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"(?<!')\b(FROM|JOIN|,)(\s+)(\w+)\b", lambda m: m[1] + m[2] + names.get(m[3], m[3]), sql)


PARTS |= {f"{n}_c": _renamed(PARTS[n], {x: f"{x}_c" for x in (*_CANDIDATE, "states")}) for n in _CANDIDATE}
PARTS |= {f"{n}_v": _renamed(PARTS[n], {"errors": "errors_v", "modes": "modes_v", "ensemble": "cv_points"}) for n in _FORECAST}


def _chain(final: str) -> str:
    """final with the subqueries that it needs before it."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)\b", sql):
            if name in PARTS and name not in order:
                need(PARTS[name])
                if name not in order:
                    order.append(name)

    need(final)
    # views of the driver may have a part's name: a subquery hides them
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order) + f"\n{final}" if order else final


def _select(source: str, longs: str = "", doubles: str = "", plain: str = "") -> str:
    """Columns of a subquery: whole numbers as BIGINT, doubles to six decimals, others as they are."""
    own = [f"{c}::BIGINT AS {c}" for c in longs.split()] + [f"round({c}, 6) AS {c}" for c in doubles.split()] + plain.split()
    return f"SELECT {', '.join(own)} FROM {source}"


_A = "scenario_id agent_id"
_MEANS = "count(*)::BIGINT AS agents, round(avg(min_ade_m), 6) AS mean_min_ade_m, round(avg(min_fde_m), 6) AS mean_min_fde_m, round(avg(miss::DOUBLE), 6) AS miss_rate, round(avg(ground_truth_coverage), 6) AS mean_ground_truth_coverage"
_GATE = "max(CASE WHEN k = 'c' THEN {0} END) - max(CASE WHEN k = 'b' THEN {0} END)"

_DRAWN = " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in POISSON)


def _bootstrap(values: str) -> str:
    """Bounds of 200 resamples' means: each value as often as a Poisson variable, by a digest."""
    drawn = f"SELECT metric, b, value, {_DRAWN} AS n FROM (SELECT *, ('0x' || substr(md5('0:' || metric_ord || ':' || b || ':' || scenario_id || ':' || agent_id), 1, 12))::BIGINT / 281474976710656e0 AS u FROM (SELECT *, unnest(range(0, 200)) AS b FROM {values}))"
    means = f"SELECT metric, b, coalesce(sum(n * value) / nullif(sum(n), 0), avg(value)) AS mean FROM ({drawn}) GROUP BY metric, b"
    return f"SELECT metric, round(max(mean) FILTER (r = 4), 6) AS lower, round(max(mean) FILTER (r = 195), 6) AS upper FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(mean, 9), b) - 1 AS r FROM ({means})) GROUP BY metric"


FINALS = {
    "scan_states": _select("states", "track_ord state_ord event_id", "time_s x_m y_m", f"{_A} object_type"),
    "scenario_timeline": "SELECT scenario_id, unnest(range(0, 91))::BIGINT AS step, round(unnest(range(0, 91)) / 10e0, 6) AS time_s FROM scenarios",
    "scenario_summary": "SELECT scenario_id, count(DISTINCT agent_id)::BIGINT AS tracks, count(*)::BIGINT AS n_states, round(min(time_s), 6) AS first_s, round(max(time_s), 6) AS last_s FROM states GROUP BY scenario_id",
    "signal_speed": _select("speed", "sample_ord", "time_s value", _A),
    "signal_acceleration": _select("acceleration", "sample_ord", "time_s value", _A),
    "signal_jerk": _select("jerk", "sample_ord", "time_s value", _A),
    "aligned_pairs": _select("aligned_s", "sample_ord", "time_s x_m y_m other_x_m other_y_m", f"{_A} other_id"),
    "signal_separation": _select("separation_s", "sample_ord", "time_s value", f"{_A} other_id"),
    "signal_closing_speed": _select("closing_s", "sample_ord", "time_s value", f"{_A} other_id"),
    "signal_ttc": _select("ttc_s", "sample_ord", "time_s value", f"{_A} other_id"),
    "wrapped_angle": f"SELECT scenario_id, agent_id, state_ord::BIGINT AS state_ord, round({_wrap('a')}, 6) AS angle FROM (SELECT *, x_m / 8 - 6 AS a FROM states)",
    "asof_current_state": _select("current_", "state_ord", "x_m y_m", _A),
    "resolve_selectors": _select("resolved", "req_ord", "", f"{_A} requirement_id other_id"),
    "unknown_agents": "SELECT scenario_id, agent_id || 'x' AS agent_id FROM resolved WHERE req_ord = 2",
    "metric_samples": _select("samples", "req_ord sample_ord", "time_s value", "scenario_id"),
    "threshold_predicates": "SELECT scenario_id, req_ord::BIGINT AS req_ord, count(*) FILTER (met)::BIGINT AS met, count(*) FILTER (NOT met)::BIGINT AS unmet FROM judged GROUP BY ALL",
    "failed_samples": _select("judged", "req_ord sample_ord", "time_s value", "scenario_id") + " WHERE NOT met",
    "requirement_results": _select("results", "req_ord evaluated_samples failed_samples", "observed_min observed_max", "scenario_id requirement_id applicable passed not_applicable_reason"),
    "result_status": "SELECT scenario_id, req_ord::BIGINT AS req_ord, requirement_id, CASE WHEN passed IS NULL THEN 'NOT_APPLICABLE' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM results",
    "failure_intervals": _select("intervals", "req_ord sample_count", "start_time_s end_time_s worst_value", "scenario_id requirement_id"),
    "explanations": "SELECT scenario_id, req_ord::BIGINT AS req_ord, round(start_time_s, 6) AS start_time_s, round(worst_value, 6) AS worst_value, round(abs(worst_value - threshold), 6) AS threshold_deviation FROM intervals",
    "quality_irregular": "SELECT scenario_id, agent_id, steps::BIGINT AS steps, round(longest, 6) AS longest, round(med, 6) AS median FROM tracks_i WHERE steps >= 2 AND longest > 1.5 * med",
    "quality_annotations": "SELECT scenario_id, code, severity, array_to_string(agent_ids, ',') AS agent_ids, message FROM quality JOIN messages USING (code)",
    "sensitivity_sweep": f"SELECT scenario_id, req_ord::BIGINT AS req_ord, round(swept, 6) AS threshold, count(*) FILTER (NOT met) = 0 AS passed, count(*) FILTER (NOT met)::BIGINT AS failed_samples, round(CASE WHEN count(value) > 0 THEN count(*) FILTER (NOT met) / count(value) ELSE 0e0 END, 6) AS failed_fraction FROM (SELECT w.*, value, {_holds('value', 'swept')} AS met FROM swept w LEFT JOIN samples USING (scenario_id, req_ord)) GROUP BY scenario_id, req_ord, swept",
    "threshold_sweep": f"SELECT scenario_id, req_ord::BIGINT AS req_ord, round(swept, 6) AS threshold, count(*) FILTER (NOT met) = 0 AS passed, count(*) FILTER (NOT met)::BIGINT AS failed_samples, round(CASE WHEN count(value) > 0 THEN count(*) FILTER (NOT met) / count(value) ELSE 0e0 END, 6) AS failed_fraction FROM (SELECT w.*, value, {_holds('value', 'swept')} AS met FROM swept_wide w LEFT JOIN samples USING (scenario_id, req_ord)) GROUP BY scenario_id, req_ord, swept",
    "evidence_confidence": "SELECT s.scenario_id, s.req_ord::BIGINT AS req_ord, s.requirement_id, CASE WHEN NOT applicable THEN 'not_applicable' WHEN evaluated_samples < 2 OR coalesce(e, false) THEN 'low' WHEN evaluated_samples < 5 OR coalesce(w, false) THEN 'medium' ELSE 'high' END AS evidence_confidence FROM results s LEFT JOIN (SELECT r.scenario_id, req_ord, bool_or(severity = 'error') AS e, bool_or(severity = 'warning') AS w FROM resolved r JOIN quality q ON q.scenario_id = r.scenario_id AND (len(agent_ids) = 0 OR list_contains(agent_ids, agent_id) OR list_contains(agent_ids, other_id)) GROUP BY ALL) m ON m.scenario_id = s.scenario_id AND m.req_ord = s.req_ord",
    "validation_rollup": "SELECT scenario_id, CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'FAIL' WHEN count(*) FILTER (applicable) = 0 THEN 'NOT APPLICABLE' ELSE 'PASS' END AS overall_status, count(*) FILTER (passed)::BIGINT AS passed_count, count(*) FILTER (applicable)::BIGINT AS applicable_count, count(*)::BIGINT AS total FROM results GROUP BY scenario_id",
    "regression_transitions": _select("transitions", "req_ord baseline_failed_samples candidate_failed_samples", "", "scenario_id requirement_id baseline_status candidate_status classification"),
    "regression_scenarios": "SELECT scenario_id, CASE WHEN bool_or(classification IN ('NEW_FAILURE', 'LOST_APPLICABILITY')) THEN 'REGRESSED' WHEN bool_or(classification = 'RESOLVED') THEN 'IMPROVED' ELSE 'UNCHANGED' END AS status FROM transitions GROUP BY scenario_id",
    "set_missing_added": "SELECT scenario_id, kind FROM changes",
    "set_common": "SELECT scenario_id FROM states INTERSECT SELECT scenario_id FROM states_c",
    "regression_gate": "SELECT *, NOT (new_failures > 0 OR missing_candidate_scenarios > 0 OR lost_applicability > 0) AS gate_passed FROM (SELECT count(*) FILTER (classification = 'NEW_FAILURE')::BIGINT AS new_failures, count(*) FILTER (classification = 'RESOLVED')::BIGINT AS resolved_failures, count(*) FILTER (classification = 'LOST_APPLICABILITY')::BIGINT AS lost_applicability FROM transitions) a, (SELECT count(*) FILTER (kind = 'missing')::BIGINT AS missing_candidate_scenarios, count(*) FILTER (kind = 'added')::BIGINT AS added_candidate_scenarios FROM changes) b",
    "lane_assoc": _select("lane_assoc", "sample_ord", "time_s lateral_offset_m distance_m", f"{_A} lane_id"),
    "signal_lane_offset": "SELECT scenario_id, agent_id, sample_ord::BIGINT AS sample_ord, round(time_s, 6) AS time_s, round(abs(lateral_offset_m), 6) AS value FROM lane_assoc",
    "polygon_distance": "SELECT scenario_id, agent_id, state_ord::BIGINT AS state_ord, round(time_s, 6) AS time_s, cw::BIGINT AS cw_ord, round(dist, 6) AS distance_m, x_m >= 10 + 20 * cw AND x_m < 12 + 20 * cw AND y_m >= 0 AND y_m < 40 AS inside FROM cw_state",
    "signal_crosswalk": _select("crosswalk", "sample_ord", "time_s value", _A),
    "signal_vru_crosswalk": _select("vru_crosswalk", "sample_ord", "time_s value", _A),
    "signal_red_stop_line": _select("red", "sample_ord", "time_s value", _A),
    "signal_stop_sign_speed": _select("stop_speed", "sample_ord", "time_s value", _A),
    "forecast_cv": _select("cv_points", "agent_ord mode_index point_ord", "confidence time_s x_m y_m", _A),
    "forecast_ca": "SELECT scenario_id, agent_id, agent_ord::BIGINT AS agent_ord, 0::BIGINT AS mode_index, 1e0 AS confidence, point_ord::BIGINT AS point_ord, round(time_s, 6) AS time_s, round(x_m, 6) AS x_m, round(y_m, 6) AS y_m FROM ca",
    "forecast_ctrv": _select("cv_points", "agent_ord mode_index point_ord", "confidence time_s x_m y_m", _A),
    "forecast_ensemble": _select("ensemble", "agent_ord mode_index point_ord", "confidence time_s x_m y_m", _A),
    "mode_errors": _select("modes", "mode_index evaluated_points", "ade_m fde_m", _A),
    "agent_scores": _select("scores", "modes evaluated_points expected_points best_mode_index", "min_ade_m min_fde_m ground_truth_coverage", f"{_A} object_type miss"),
    "scenario_scores": f"SELECT scenario_id, {_MEANS} FROM scores GROUP BY scenario_id",
    "evaluation_summary": f"SELECT {_MEANS} FROM scores",
    "by_object_type": f"SELECT object_type, {_MEANS} FROM scores GROUP BY object_type",
    "best_mode_counts": "SELECT best_mode_index::BIGINT AS best_mode_index, count(*)::BIGINT AS agents FROM scores GROUP BY best_mode_index",
    "worst_agents_topk": "SELECT scenario_id, agent_id, round(m, 6) AS min_ade_m FROM (SELECT *, round(min_ade_m, 9) AS m FROM scores) ORDER BY m DESC, scenario_id, agent_id LIMIT 10",
    "scenario_ranking": "SELECT scenario_id, round(avg(min_ade_m), 6) AS mean_min_ade_m FROM scores GROUP BY scenario_id",
    "paired_agent_deltas": _select("deltas", "miss_delta candidate_best_mode_index", "baseline_min_ade_m candidate_min_ade_m min_ade_delta_m min_fde_delta_m", f"{_A} object_type"),
    "identity_check": "SELECT scenario_id, agent_id, 'baseline' AS only_in FROM scores WHERE agent_id = '1'",
    "change_counts": "SELECT metric, count(*) FILTER (d < -1e-12)::BIGINT AS improved, count(*) FILTER (abs(d) <= 1e-12)::BIGINT AS unchanged, count(*) FILTER (d > 1e-12)::BIGINT AS regressed FROM (SELECT 'min_ade_m' AS metric, round(min_ade_delta_m, 9) AS d FROM deltas UNION ALL SELECT 'min_fde_m', round(min_fde_delta_m, 9) FROM deltas UNION ALL SELECT 'miss', miss_delta FROM deltas) GROUP BY metric",
    "scenario_deltas": "SELECT scenario_id, count(*)::BIGINT AS agents, round(avg(min_ade_delta_m), 6) AS mean_min_ade_delta_m, round(avg(min_fde_delta_m), 6) AS mean_min_fde_delta_m, round(avg(miss_delta), 6) AS miss_rate_delta FROM deltas GROUP BY scenario_id",
    "top_improved_agents": "SELECT scenario_id, agent_id, round(d, 6) AS min_ade_delta_m FROM (SELECT *, round(min_ade_delta_m, 9) AS d FROM deltas) ORDER BY d, scenario_id, agent_id LIMIT 10",
    "top_regressed_agents": "SELECT scenario_id, agent_id, round(d, 6) AS min_ade_delta_m FROM (SELECT *, round(min_ade_delta_m, 9) AS d FROM deltas) ORDER BY d DESC, scenario_id, agent_id LIMIT 10",
    "comparison_gate": "SELECT round(a, 6) AS mean_min_ade_m_delta, round(f, 6) AS mean_min_fde_m_delta, round(m, 6) AS miss_rate_delta, round(c, 6) AS mean_ground_truth_coverage_delta, a <= 1e-12 AND f <= 1e-12 AND m <= 1e-12 AND -c <= 1e-12 AS gate_passed FROM (SELECT " + ", ".join(f"avg({x}) FILTER (k = 'c') - avg({x}) FILTER (k = 'b') AS {n}" for x, n in (("min_ade_m", "a"), ("min_fde_m", "f"), ("miss::DOUBLE", "m"), ("ground_truth_coverage", "c"))) + " FROM (SELECT 'b' AS k, * FROM scores_v UNION ALL SELECT 'c', * FROM scores))",
    "bootstrap_ci": _bootstrap("resampled"),
    "paired_bootstrap_ci": _bootstrap("paired"),
    "evidence": "SELECT r.scenario_id, r.req_ord::BIGINT AS req_ord, r.requirement_id, passed, failed_samples::BIGINT AS failed_samples, not_applicable_reason, evidence_confidence, quality_annotations FROM results r JOIN graded g ON g.scenario_id = r.scenario_id AND g.req_ord = r.req_ord LEFT JOIN notes n ON n.scenario_id = r.scenario_id AND n.req_ord = r.req_ord",
    "point_in_polygon": "SELECT scenario_id, agent_id, cw::BIGINT AS cw_ord, count(*) FILTER (x_m >= 10 + 20 * cw AND x_m < 12 + 20 * cw AND y_m >= 0 AND y_m < 40)::BIGINT AS states_inside FROM cw_state GROUP BY ALL",
    "risk_evidence": "SELECT scenario_id, agent_id, object_type, motion_class, review_priority, array_to_string(tags, ',') AS risk_tags, round(min_ade_m, 6) AS min_ade_m, round(min_fde_m, 6) AS min_fde_m, miss, round(displacement_m, 6) AS future_displacement_m, nearby_agents::BIGINT AS scene_density_30m, round(min_actor_separation_m, 6) AS min_actor_separation_m, round(min_sdc_separation_m, 6) AS min_sdc_separation_m, round(sdc_separation_error_m, 6) AS max_sdc_separation_error_m, near_crosswalk, near_control AS near_traffic_control FROM risk",
    "svg_projection": "SELECT scenario_id, agent_id, state_ord::BIGINT AS state_ord, round(50 + (x_m - x0) * scale, 6) AS px, round(650 - (y_m - y0) * scale, 6) AS py FROM states JOIN (SELECT scenario_id, min(x_m) AS x0, min(y_m) AS y0, least(800 / greatest(1e0, max(x_m) - min(x_m)), 600 / greatest(1e0, max(y_m) - min(y_m))) AS scale FROM states GROUP BY scenario_id) USING (scenario_id)",
    "tfrecord_scan": "SELECT 0::BIGINT AS record_ord, count(DISTINCT scenario_id)::BIGINT AS records, count(DISTINCT scenario_id)::BIGINT AS filled FROM states",
    "shard_scan": "SELECT scenario_id, count(DISTINCT agent_id)::BIGINT AS tracks, count(*)::BIGINT AS n_states FROM states GROUP BY scenario_id",
    "scenario_scan": _select("states", "track_ord", "time_s x_m y_m", f"{_A} object_type"),
    "scenario_json": _select("states", "track_ord state_ord", "time_s x_m y_m", f"{_A} object_type"),
    "normalize_valid_states": "SELECT scenario_id, agent_id, count(*)::BIGINT AS valid_states FROM states GROUP BY ALL",
    "map_normalize": "SELECT scenario_id, (n + w + s)::BIGINT AS map_feature_count, n::BIGINT AS lanes, w::BIGINT AS crosswalks, s::BIGINT AS signs, g::BIGINT AS signals FROM (SELECT DISTINCT scenario_id FROM states), (SELECT count(*) AS n FROM lanes), (SELECT count(DISTINCT cw) AS w FROM cw_edge), (SELECT count(*) AS s FROM signs), (SELECT count(*) AS g FROM lights)",
    "manifest_duplicates": "SELECT DISTINCT scenario_id FROM states WHERE scenario_id = 's1'",
    "external_predictions": _select("ext", "mode_index point_ord", "confidence x_m y_m", _A),
    "external_invalid_modes": "SELECT DISTINCT scenario_id, agent_id, CASE WHEN agent_id::INT % 11 = 0 THEN 'points' ELSE 'coordinates' END AS reason FROM ext WHERE agent_id::INT % 11 = 0 OR agent_id::INT % 7 = 0",
    "external_identity": "SELECT DISTINCT scenario_id, agent_id, 'unexpected' AS problem FROM ext e ANTI JOIN targets t USING (scenario_id, agent_id) UNION ALL SELECT scenario_id, agent_id, 'missing' FROM targets t ANTI JOIN ext e USING (scenario_id, agent_id)",
    "normalized_confidence": "SELECT scenario_id, agent_id, mode_index::BIGINT AS mode_index, round(confidence / sum(confidence) OVER (PARTITION BY scenario_id, agent_id), 6) AS confidence FROM ext WHERE point_ord = 0",
    "submission_attach_times": "SELECT scenario_id, agent_id, mode_index::BIGINT AS mode_index, point_ord::BIGINT AS point_ord, round((15 + 5 * point_ord) / 10e0, 6) AS time_s FROM ext",
    "float32_roundtrip": "SELECT scenario_id, agent_id, mode_index::BIGINT AS mode_index, point_ord::BIGINT AS point_ord, round(confidence::FLOAT::DOUBLE, 6) AS confidence, round(x_m::FLOAT::DOUBLE, 6) AS x_m, round(y_m::FLOAT::DOUBLE, 6) AS y_m FROM ensemble",
    "scene_density": _select("marked", "nearby_agents", "", _A),
    "min_actor_separation": _select("marked", "", "min_actor_separation_m", _A),
    "sdc_interaction": _select("marked", "", "min_sdc_separation_m sdc_separation_error_m", _A),
    "motion_class": _select("marked", "", "displacement_m", f"{_A} motion_class"),
    "near_map_context": _select("marked", "", "", f"{_A} near_crosswalk near_control"),
    "risk_tags": "SELECT scenario_id, agent_id, array_to_string(tags, ',') AS risk_tags FROM risk",
    "review_priority": _select("risk", "", "", f"{_A} review_priority"),
    "risk_counters": "SELECT kind, name, count(*)::BIGINT AS agents FROM (SELECT 'review_priority' AS kind, review_priority AS name FROM risk UNION ALL SELECT 'motion_class', motion_class FROM risk UNION ALL SELECT 'risk_tag', unnest(tags) FROM risk) GROUP BY kind, name",
    "risk_strata": "SELECT kind, name, count(*)::BIGINT AS agents, round(avg(min_ade_m), 6) AS mean_min_ade_m, round(avg(min_fde_m), 6) AS mean_min_fde_m, round(avg(miss::DOUBLE), 6) AS miss_rate FROM (SELECT 'motion_class' AS kind, motion_class AS name, * FROM risk UNION ALL SELECT 'review_priority', review_priority, * FROM risk) GROUP BY kind, name",
    "risk_top_cases": "SELECT scenario_id, agent_id, review_priority, round(min_ade_m, 6) AS min_ade_m FROM risk ORDER BY CASE review_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(coalesce(sdc_separation_error_m, 0), 9) DESC, round(min_ade_m, 9) DESC, scenario_id, agent_id LIMIT 20",
}


def oracle_sql() -> dict[str, str]:
    return {name: _chain(sql) for name, sql in FINALS.items()}
