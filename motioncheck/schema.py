"""Schemas of the motion tables and files."""

from __future__ import annotations

STATE = "time_s double, x_m double, y_m double, heading_rad double, z_m double, velocity_x_mps double, velocity_y_mps double, length_m double, width_m double, height_m double"
POINT = "struct<x_m: double, y_m: double, z_m: double>"

#: A scenario as one nested row: what JSON files hold, and what decoded records become.
SCENARIO = ", ".join(
    [
        "scenario_id string",
        f"tracks array<struct<agent_id: string, object_type: string, states: array<struct<{', '.join(': '.join(f.split(' ')) for f in STATE.split(', '))}>>>>",
        "current_time_index int",
        "sdc_agent_id string",
        "objects_of_interest array<string>",
        "tracks_to_predict array<string>",
        "map_feature_count int",
        "timestamps_s array<double>",
    ]
)
MAP = ", ".join(
    [
        f"lanes array<struct<feature_id: string, points: array<{POINT}>, speed_limit_mph: double, lane_type: string>>",
        f"stop_signs array<struct<feature_id: string, lane_ids: array<string>, position: {POINT}>>",
        f"crosswalks array<struct<feature_id: string, points: array<{POINT}>>>",
        f"signals array<struct<time_s: double, lane_id: string, state: string, stop_point: {POINT}>>",
    ]
)
REQUIREMENTS = "requirements array<struct<id: string, description: string, metric: string, operator: string, threshold: double, units: string, subject_agent_id: string, other_agent_id: string>>"
EXTERNAL = "schema_version int, provenance struct<model_name: string, model_version: string, source_repository: string, source_revision: string, checkpoint_sha256: string, coordinate_frame: string, future_data_used: boolean>, predictions array<struct<scenario_id: string, agents: array<struct<agent_id: string, modes: array<struct<confidence: double, xy_m: array<array<double>>>>>>>>"

#: Enumerations of recorded scenarios.
OBJECT_TYPES = {0: "unset", 1: "vehicle", 2: "pedestrian", 3: "cyclist", 4: "other"}
LANE_TYPES = {0: "undefined", 1: "freeway", 2: "surface_street", 3: "bike_lane"}
SIGNAL_STATES = {0: "unknown", 1: "arrow_stop", 2: "arrow_caution", 3: "arrow_go", 4: "stop", 5: "caution", 6: "go", 7: "flashing_stop", 8: "flashing_caution"}
