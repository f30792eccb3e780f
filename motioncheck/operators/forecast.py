"""Kinematic forecasts of several modes: points (scenario_id, agent_id, mode_index, confidence, point_ord, time_s, x_m, y_m)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncheck.functions.columns import wrapped_angle

#: The steps of a forecast, and the modes of each model in order.
STEPS = tuple(range(15, 91, 5))
MODELS = {"constant_velocity": ("cv",), "constant_acceleration": ("ca",), "constant_turn_rate": ("ctrv",), "kinematic_ensemble": ("cv", "ca", "ctrv")}
MAX_ACCELERATION, MAX_YAW_RATE, STRAIGHT = 4.0, 0.5, 1e-6

AGENT = ("scenario_id", "agent_id")


def targets(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, agent_ord, current_time_s, times) of the agents to predict."""
    own = scenarios.select("scenario_id", F.get("timestamps_s", "current_time_index").alias("current_time_s"), F.array(*[F.get("timestamps_s", F.lit(s)) for s in STEPS]).alias("times"), F.posexplode("tracks_to_predict").alias("agent_ord", "agent_id"))
    return own


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def history(states: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target: its last three states at or before the current time, latest first (t0, x0, ...; t1, ...; t2, ...)."""
    names = {"t": F.col("time_s"), "x": F.col("x_m"), "y": F.col("y_m"), "vx": _optional(states, "velocity_x_mps"), "vy": _optional(states, "velocity_y_mps"), "h": _optional(states, "heading_rad")}
    own = states.select(*AGENT, "state_ord", *[c.alias(n) for n, c in names.items()]).join(targets.select(*AGENT, "current_time_s"), list(AGENT)).where(F.col("t") <= F.col("current_time_s"))
    back = F.row_number().over(Window.partitionBy(*AGENT).orderBy(F.desc("state_ord"))) - 1
    own = own.withColumn("back", back).where("back < 3")
    return own.groupBy(*AGENT).agg(*[F.max(F.when(F.col("back") == i, F.col(n))).alias(f"{n}{i}") for i in range(3) for n in names])


def _velocity(axis: str, i: int) -> Column:
    """Reported if both parts are, else the last difference."""
    reported = F.col(f"vx{i}").isNotNull() & F.col(f"vy{i}").isNotNull()
    dt = F.col(f"t{i}") - F.col(f"t{i + 1}") if i < 2 else F.lit(None).cast("double")
    moved = F.col(f"{axis}{i}") - F.col(f"{axis}{i + 1}") if i < 2 else F.lit(None).cast("double")
    return F.when(reported, F.col(f"v{axis}{i}")).when(dt > 0, moved / dt)


def motion(history: DataFrame) -> DataFrame:
    """history with velocity, capped acceleration, heading and clamped yaw rate of each target."""
    found = history.withColumn("vx", _velocity("x", 0)).withColumn("vy", _velocity("y", 0)).withColumn("px", _velocity("x", 1)).withColumn("py", _velocity("y", 1))
    dt = F.col("t0") - F.col("t1")
    found = found.withColumn("ax", F.when(dt > 0, (F.col("vx") - F.col("px")) / dt)).withColumn("ay", F.when(dt > 0, (F.col("vy") - F.col("py")) / dt))
    size = F.hypot("ax", "ay")
    cap = F.when(size > MAX_ACCELERATION, MAX_ACCELERATION / size).otherwise(1.0)
    found = found.withColumn("cap", cap)
    found = found.withColumn("ax", F.coalesce(F.col("ax") * F.col("cap"), F.lit(0.0))).withColumn("ay", F.coalesce(F.col("ay") * F.col("cap"), F.lit(0.0)))
    heading = F.coalesce(F.col("h0"), F.atan2("vy", "vx"))
    yaw = F.when(F.col("h0").isNotNull() & F.col("h1").isNotNull() & (dt > 0), wrapped_angle(F.col("h0") - F.col("h1")) / dt).otherwise(0.0)
    return found.withColumn("heading", heading).withColumn("yaw", F.greatest(F.lit(-MAX_YAW_RATE), F.least(F.lit(MAX_YAW_RATE), yaw)))


def _position(mode: str) -> tuple[Column, Column]:
    e = F.col("time_s") - F.col("t0")
    x, y = F.col("x0") + F.col("vx") * e, F.col("y0") + F.col("vy") * e
    if mode == "ca":
        return x + 0.5 * F.col("ax") * e * e, y + 0.5 * F.col("ay") * e * e
    if mode == "ctrv":
        w, h = F.col("yaw"), F.col("heading")
        v = F.hypot("vx", "vy")
        bent = F.abs(w) >= STRAIGHT
        arc = v / F.when(bent, w)
        return F.when(bent, F.col("x0") + arc * (F.sin(h + w * e) - F.sin(h))).otherwise(x), F.when(bent, F.col("y0") + arc * (F.cos(h) - F.cos(h + w * e))).otherwise(y)
    return x, y


def forecast(states: DataFrame, scenarios: DataFrame, model: str) -> DataFrame:
    """Forecasts of each agent to predict; modes have equal weights, elapsed time counts from the last state."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    own = targets(scenarios)
    moving = motion(history(states, own)).join(own, list(AGENT))
    steps = moving.select("*", F.posexplode("times").alias("point_ord", "time_s")).where("time_s is not null")
    modes = F.array(*[F.struct(F.lit(i).alias("mode_index"), *(c.alias(n) for n, c in zip(("x_m", "y_m"), _position(m)))) for i, m in enumerate(MODELS[model])])
    return steps.withColumn("m", F.explode(modes)).select(*AGENT, "agent_ord", "m.mode_index", F.lit(1.0 / len(MODELS[model])).alias("confidence"), "point_ord", "time_s", "m.x_m", "m.y_m")
