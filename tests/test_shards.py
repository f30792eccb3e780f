"""Framed shards: ranges, errors, commit and abort; checks of scenarios by the commands."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from motioncheck import cli
from motioncheck.sources import framed, shards


def test_ranges_and_records(spark, tmp_path):
    payloads = [bytes([i % 251]) * (i * 37 % 900) for i in range(400)]
    for name, own in (("a", payloads[:300]), ("b", payloads[300:]), ("empty", [])):
        (tmp_path / name).write_bytes(b"".join(map(framed.frame, own)))
    (tmp_path / "_hidden").write_bytes(b"x")
    cut = list(shards.ranges(str(tmp_path / "a"), 10_000))
    assert len(cut) > 10 and cut[0][1] == 0 and all(x[2] == y[1] for x, y in zip(cut, cut[1:])) and cut[-1][2] == os.path.getsize(tmp_path / "a")
    found = shards.read_shards(spark, str(tmp_path), range_bytes=10_000)
    rows = sorted((os.path.basename(r.path), r.record_ord, bytes(r.payload)) for r in found.collect())
    assert rows == sorted([("a", i, p) for i, p in enumerate(payloads[:300])] + [("b", i, p) for i, p in enumerate(payloads[300:])])
    assert found.select(F.spark_partition_id()).distinct().count() > 10  # one shard is many tasks
    whole = framed.read_records(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((os.path.basename(r.path), r.record_ord, bytes(r.payload)) for r in whole.collect()) == rows


@pytest.mark.parametrize("cut,what", [(3, "record 2: truncated length"), (9, "record 2: truncated length checksum"), (13, "record 2: truncated payload"), (18, "record 2: truncated payload checksum")])
def test_truncated(tmp_path, cut, what):
    data = framed.frame(b"abc") + framed.frame(b"")
    (tmp_path / "s").write_bytes(data + framed.frame(b"xyz")[:cut])
    with pytest.raises(framed.RecordFormatError, match=f"^{what}$"):
        list(shards.ranges(str(tmp_path / "s"), 100))


def test_write_commits_or_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("payload"), F.lit("other").alias("path"))
    shards.write_shards(rows.repartition(4), out)
    back = shards.read_shards(spark, out)
    assert sorted(int(bytes(r.payload)) for r in back.collect()) == list(range(1000)) and len(os.listdir(out)) == 4
    before = sorted(os.listdir(out))
    with pytest.raises(Exception, match="boom"):
        shards.write_shards(rows.withColumn("payload", F.when(F.col("payload") == b"777", F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.col("payload"))), out)
    assert sorted(os.listdir(out)) == before
    shards.write_shards(rows.limit(1), out, mode="append")
    assert shards.read_shards(spark, out).count() == 1001
    shards.write_shards(rows.where("false"), out)
    assert shards.read_shards(spark, out).count() == 0


def test_injected_decoder(spark, tmp_path):
    shards.write_shards(spark.createDataFrame([(b"s1",), (b"s2",)], "payload binary"), str(tmp_path / "x"))
    found = shards.decoded(shards.read_shards(spark, str(tmp_path / "x")), decode=lambda p: {"scenario_id": p.decode(), "current_time_index": 3, "tracks": []})
    assert sorted((r.scenario_id, r.current_time_index) for r in found.collect()) == [("s1", 3), ("s2", 3)]
    with pytest.raises(ValueError):
        shards.decoded(shards.read_shards(spark, str(tmp_path / "x")), min_valid_states=0)


@pytest.mark.parametrize("tracks,problem", [([("a", [0, 0])], "state times do not increase"), ([("a", [0]), ("a", [0])], "repeated agent id"), ([("", [0])], "empty agent id"), ([("a", [])], "track without states")])
def test_commands_reject_faults(spark, tmp_path, monkeypatch, tracks, problem):
    made = {"scenario_id": "s", "timestamps_s": [], "tracks": [{"agent_id": a, "states": [{"time_s": t, "x_m": 0.0, "y_m": 0.0} for t in times]} for a, times in tracks]}
    (tmp_path / "s.json").write_text(json.dumps(made))
    (tmp_path / "r.json").write_text(json.dumps({"requirements": [{"id": "r", "metric": "speed", "operator": "less_than", "threshold": 1, "subject_agent_id": "a"}]}))
    monkeypatch.setattr(cli, "session", lambda: spark)
    with pytest.raises(SystemExit, match=f"scenario s: {problem}"):
        cli.main(["verify", str(tmp_path / "s.json"), str(tmp_path / "r.json")])
