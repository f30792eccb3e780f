"""Submissions and external prediction files, encoded and written by tasks.

A submission is a message whose scenarios are a repeated field, so messages may stand one after
another: each task writes those of its scenarios as a fragment. A folder of fragments is a submission
that many tasks read again; a single file is the fragments joined, in the order of scenarios, by
the file system's streams. Neither brings rows to the driver, and a failed job leaves no file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.sources import framed, shards
from motioncheck.sources.stored import workspace

#: A submission's kind, motion prediction: the message's second field.
KIND = framed.encode((2, 1))


def nested(points: DataFrame) -> DataFrame:
    """(scenario_id, agents) of points (with agent_ord): a scenario's agents, their modes, and their points, in order.

    A point that a mode has twice ends the job with a message: its scenario is there twice.
    """
    spots = F.sort_array(F.collect_list(F.struct("point_ord", "x_m", "y_m")))
    modes = points.groupBy("scenario_id", "agent_ord", "agent_id", "mode_index").agg(F.first("confidence").alias("confidence"), spots.alias("points"))
    places = F.transform("points", lambda p: p["point_ord"])
    twice = F.raise_error(F.concat(F.lit("scenario "), "scenario_id", F.lit(" appears more than once"))).cast(modes.schema["points"].dataType)
    modes = modes.withColumn("points", F.when(F.size(F.array_distinct(places)) < F.size(places), twice).otherwise(F.col("points")))
    agents = modes.groupBy("scenario_id", "agent_ord", "agent_id").agg(F.sort_array(F.collect_list(F.struct("mode_index", "confidence", "points"))).alias("modes"))
    return agents.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("agent_ord", "agent_id", "modes"))).alias("agents"))


def _message(scenario_id: str, agents: list[dict]) -> bytes:
    own = []
    for agent in agents:
        trajectories = []
        for mode in agent["modes"]:
            axes = [struct.pack(f"<{len(mode['points'])}f", *(p[c] for p in mode["points"])) for c in ("x_m", "y_m")]
            trajectories.append((2, framed.encode((1, framed.encode((2, axes[0]), (3, axes[1]))), (2, float(mode["confidence"])))))
        own.append((1, framed.encode((1, int(agent["agent_id"])), *trajectories)))
    return framed.encode((1, framed.encode((1, scenario_id), (2, framed.encode(*own)))))


def encoded(points: DataFrame) -> DataFrame:
    """(scenario_id, payload): a scenario's part of a submission, in the order of scenarios over all tasks. Agent ids must be numbers; six modes of an agent are taken."""
    whole = nested(points.where("mode_index < 6")).repartitionByRange("scenario_id").sortWithinPartitions("scenario_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scenario, agents = (c[row].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([scenario]), pa.array([_message(scenario, agents)])], ["scenario_id", "payload"])

    return whole.mapInArrow(run, "scenario_id string, payload binary")


def write_parts(points: DataFrame, folder: str) -> None:
    """A folder of fragments, each a whole submission of its scenarios; read_submission() reads it."""
    shards.write_fragments(encoded(points), folder, KIND)


def write_submission(points: DataFrame, path: str, fragments: str | None = None) -> None:
    """One submission file: the fragments that tasks wrote to the shared folder, joined. `fragments` names a folder that keeps them, for read_submission()."""
    _joined(encoded(points), path, tail=KIND, folder=fragments)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Points of a submission's file, or of a folder of fragments, a task for each."""
    return framed.read_submission(spark, path)


def write_external(points: DataFrame, provenance: dict, path: str) -> None:
    """points (with agent_ord) as an external prediction file, in the order of scenarios, agents, modes and points; a scenario a line."""
    mode = lambda m: F.struct(m["confidence"].alias("confidence"), F.transform(m["points"], lambda p: F.array(p["x_m"], p["y_m"])).alias("xy_m"))
    agents = F.transform("agents", lambda a: F.struct(a["agent_id"].alias("agent_id"), F.transform(a["modes"], mode).alias("modes")))
    whole = nested(points).repartitionByRange("scenario_id").sortWithinPartitions("scenario_id")
    lines = whole.select(F.concat(F.lit(",\n"), F.to_json(F.struct("scenario_id", agents.alias("agents")))).cast("binary").alias("payload"))
    head = f'{{"schema_version": 1, "provenance": {json.dumps(provenance)}, "predictions": ['
    _joined(lines, path, head.encode(), b"\n]}\n", skip=1)


def _joined(payloads: DataFrame, path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0, folder: str | None = None) -> None:
    held = folder or workspace(payloads.sparkSession)
    shards.write_fragments(payloads, held)
    try:
        shards.join_fragments(held, path, head, tail, skip)
    finally:
        if not folder:
            store, own = shards.located(held)
            store.delete_dir(own)
