"""Experiments: candidates' forecasts of the same shards, scored, compared and indexed."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.operators import compare, external, forecast, risk, scoring
from motioncheck.plans import assemble, render
from motioncheck.sources import framed, json_files, submissions
from motioncheck.sources.stored import workspace

REVISION = "MOTIONCHECK_SOURCE_REVISION"


@dataclass(frozen=True)
class Experiment:
    name: str
    dataset: dict
    shards: tuple[str, ...]
    candidates: tuple[tuple[str, str], ...]
    miss_threshold_m: float
    samples: int
    seed: int
    baseline: str
    candidate: str
    paired_samples: int
    paired_seed: int
    policy: compare.ComparisonPolicy
    folder: Path
    limit: int | None


def load(manifest: str) -> Experiment:
    """The manifest, checked; paths are relative to it."""
    at, raw = Path(manifest).parent, json.loads(Path(manifest).read_text())

    def part(of: dict, key: str, kind: type) -> object:
        if not isinstance(of.get(key), kind):
            raise ValueError(f"the manifest needs {key} as {kind.__name__}")
        return of[key]

    def name(value: object) -> str:
        if not isinstance(value, str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", value):
            raise ValueError(f"{value!r} is no identifier")
        return value

    dataset, scored, compared, outputs = (part(raw, k, dict) for k in ("dataset", "evaluation", "comparison", "outputs"))
    shards = tuple(str(at / s) for s in part(dataset, "shards", list))
    candidates = tuple((name(c["name"]), c["model"]) for c in part(raw, "candidates", list))
    names = [n for n, _ in candidates]
    if not shards:
        raise ValueError("the manifest needs shards")
    if len(candidates) < 2 or len(set(names)) < len(names):
        raise ValueError("the manifest needs two candidates or more, each with a name of its own")
    if odd := [m for _, m in candidates if m not in forecast.MODELS]:
        raise ValueError(f"unknown model {odd[0]}")
    if compared["baseline"] not in names or compared["candidate"] not in names or compared["baseline"] == compared["candidate"]:
        raise ValueError("baseline and candidate must be two of the candidates")
    limit = raw.get("limit")
    if limit is not None and (not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be positive")
    miss, samples, paired = float(scored.get("miss_threshold_m", 2.0)), int(scored.get("bootstrap_samples", 1000)), int(compared.get("bootstrap_samples", 2000))
    if miss <= 0 or samples < 0 or paired < 0:
        raise ValueError("miss_threshold_m must be positive, and bootstrap_samples nonnegative")
    return Experiment(name(raw["experiment_id"]), {k: dataset.get(k) for k in ("name", "version")}, shards, candidates, miss, samples, int(scored.get("bootstrap_seed", 0)), compared["baseline"], compared["candidate"], paired, int(compared.get("bootstrap_seed", 0)), compare.policy_of(compared.get("policy", {})), at / outputs["directory"], limit)


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def revision() -> dict:
    """The source's revision: from the environment, else from git, else unavailable."""
    if given := os.environ.get(REVISION):
        return {"commit": given, "dirty": None, "source": "environment"}
    git = lambda *a: subprocess.run(["git", *a], cwd=Path(__file__).parent, capture_output=True, text=True, check=True).stdout.strip()
    try:
        return {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain")), "source": "git"}
    except (OSError, subprocess.CalledProcessError):
        return {"commit": None, "dirty": None, "source": "unavailable"}


def scores_of(points: DataFrame, states: DataFrame, miss_threshold_m: float) -> DataFrame:
    return scoring.agent_scores(points, states, miss_threshold_m)


def run(spark: SparkSession, manifest: str) -> dict:
    """Runs the experiment and returns its index: forecasts are written, and read back as written, before they are scored."""
    own = load(manifest)
    if lost := [s for s in own.shards if not Path(s).is_file()]:
        raise FileNotFoundError(lost[0])
    nested = framed.read_scenarios(spark, list(own.shards))
    if own.limit:
        nested = framed.in_file_order(nested, list(own.shards)).limit(own.limit)
    nested = nested.cache()
    if repeated := json_files.duplicates(nested).limit(1).collect():
        raise ValueError(f"scenario {repeated[0].scenario_id} appears more than once")
    n = nested.count()
    if not n:
        raise ValueError("the shards hold no scenarios")
    scenarios = json_files.timelines(nested)
    states, maps = json_files.states_of(nested).cache(), json_files.map_tables(nested)
    thresholds, made, found, contexts = risk.RiskThresholds(), [], {}, {}
    own.folder.mkdir(parents=True, exist_ok=True)

    def put(name: str, text: str) -> None:
        render.write(str(own.folder / name), text)
        made.append(own.folder / name)

    for name, model in own.candidates:
        path = own.folder / f"{name}.binproto"
        # the artifact is on the driver's disk, which executors may not see: they read the same fragments in the shared folder
        parts = workspace(spark)
        submissions.write_submission(assemble.forecasts(spark, states, scenarios, model), str(path), parts)
        made.append(path)
        points = external.with_times(submissions.read_submission(spark, parts), scenarios, forecast.STEPS).cache()
        found[name] = scores_of(points, states, own.miss_threshold_m).cache()
        report = assemble.evaluation(found[name], own.miss_threshold_m, own.samples, own.seed)
        context = assemble.risks(risk.evidence(states, scenarios, forecast.targets(scenarios), points, found[name], maps["crosswalks"], maps["signs"], maps["signals"], thresholds), thresholds)
        contexts[name] = context["summary"]
        for kind, payload, text in (("evaluation", report, render.evaluation(report)), ("risk", context, render.risks(context))):
            put(f"{name}-{kind}.json", render.as_json(payload))
            put(f"{name}-{kind}.md", text)
            put(f"{name}-{kind}.html", render.html(text, f"{name} {kind}"))
    compared = assemble.comparison(found[own.baseline], found[own.candidate], own.policy, own.paired_samples, own.paired_seed)
    text = render.comparison(compared)
    put("comparison.json", render.as_json(compared))
    put("comparison.md", text)
    put("comparison.html", render.html(text, "comparison"))
    index = {
        "schema_version": 1,
        "experiment_id": own.name,
        "source_revision": revision(),
        "dataset": own.dataset | {"scenario_count": n, "shards": [{"path": Path(s).name, "bytes": Path(s).stat().st_size, "sha256": digest(Path(s))} for s in own.shards]},
        "configuration": {"candidates": [{"name": a, "model": b} for a, b in own.candidates], "miss_threshold_m": own.miss_threshold_m, "bootstrap_samples": own.samples, "bootstrap_seed": own.seed, "policy": vars(own.policy), "limit": own.limit},
        "result": {"gate_passed": compared["gate_passed"], "deltas": compared["deltas"], "violations": compared["violations"], "risk_context": contexts},
        "artifacts": [{"path": p.name, "bytes": p.stat().st_size, "sha256": digest(p)} for p in made],
    }
    render.write(str(own.folder / "experiment-index.json"), render.as_json(index))
    return index
