"""Commands: verify, verify-scenes, inspect, compare-runs, evaluate, forecast, compare-evaluations, experiment, risk, import-predictions."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.operators import compare, external, forecast, regression, requirements, risk
from motioncheck.plans import assemble, experiment, render
from motioncheck.sources import framed, json_files, submissions


def session() -> SparkSession:
    found = SparkSession.builder.appName("motioncheck").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    found.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return found


def recording(nested: DataFrame) -> requirements.Recording:
    maps = json_files.map_tables(nested) if "lanes" in nested.columns else {}
    return requirements.Recording(json_files.states_of(nested), json_files.timelines(nested).drop("tracks"), maps.get("lanes"), maps.get("crosswalks"), maps.get("signs"), maps.get("signals"))


def unique(nested: DataFrame) -> DataFrame:
    nested = nested.cache()
    if repeated := json_files.duplicates(nested).limit(1).collect():
        raise SystemExit(f"scenario {repeated[0].scenario_id} appears more than once")
    if nested.isEmpty():
        raise SystemExit("there are no scenarios")
    return sound(nested)


def sound(nested: DataFrame) -> DataFrame:
    """nested, if it breaks no rule of the model."""
    if bad := json_files.faults(nested).limit(1).collect():
        raise SystemExit(f"scenario {bad[0].scenario_id}: {bad[0].problem}")
    return nested


def limited(nested: DataFrame, n: int | None, paths: str | list[str]) -> DataFrame:
    """The first n scenarios as the files have them."""
    if n is not None and n < 1:
        raise SystemExit("--limit must be positive")
    found = framed.in_file_order(nested, paths)
    return found.limit(n) if n else found


def say(payload: object) -> None:
    sys.stdout.write(render.as_json(payload))


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    nested = sound(json_files.read_scenarios(spark, [a.scenario]))
    report = assemble.validation(recording(nested), json_files.read_requirements(spark, a.requirements))[0]
    text = render.validation(report)
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, report["scenario_id"]))
    if a.svg:
        render.write(a.svg, render.svg(nested.first().asDict(recursive=True)))
    say({"scenario_id": report["scenario_id"], "evidence": report["requirement_evidence"]})
    return 0 if report["passed"] else 1


def verify_scenes(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.index < 0:
        raise SystemExit("--index must be nonnegative")
    one = framed.in_file_order(framed.read_scenarios(spark, a.records), a.records).offset(a.index).limit(1).cache()
    if one.isEmpty():
        raise SystemExit("there is no scenario of that index")
    sound(one)
    report = assemble.validation(recording(one), json_files.read_requirements(spark, a.requirements))[0]
    text = render.validation(report)
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, report["scenario_id"]))
    counts = one.select(F.size("lanes").alias("lanes"), F.size("crosswalks").alias("crosswalks"), F.size("stop_signs").alias("stop_signs"), F.size("signals").alias("traffic_signal_states")).first().asDict()
    say({"scenario_id": report["scenario_id"], "overall_status": report["overall_status"], "passed": report["passed"], "requirements_passed": report["passed_count"], "requirements_applicable": report["applicable_count"], "requirements_not_applicable": report["total"] - report["applicable_count"], "requirements_total": report["total"], "map_context": counts, "quality_annotations": report["quality_annotations"], "results": [e["result"] for e in report["requirement_evidence"]]})
    return 0 if report["passed"] else 1


def inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    nested = limited(framed.read_scenarios(spark, a.records), a.limit, a.records).cache()
    if a.svg:
        render.write(a.svg, render.svg(nested.first().asDict(recursive=True)))
    rows = nested.select("scenario_id", F.size("tracks").alias("track_count"), "sdc_agent_id", "current_time_index", "objects_of_interest", "tracks_to_predict", "map_feature_count")
    say({"scenarios": [r.asDict(recursive=True) for r in rows.collect()]})
    return 0


def compare_runs(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = json.loads(Path(a.policy).read_text()) if a.policy else {}
    policy = regression.RegressionPolicy(int(raw.get("max_new_failures", 0)), bool(raw.get("fail_on_missing_candidate_scenarios", True)), bool(raw.get("fail_on_lost_applicability", True)))
    sides = [recording(sound(json_files.read_manifest(spark, m))) for m in (a.baseline, a.candidate)]
    found = assemble.regressions(*sides, json_files.read_requirements(spark, a.requirements), policy)
    text = render.regression(found)
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, "regression"))
    say(found)
    return 0 if found["gate_passed"] else 1


def _scored(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict]:
    nested = unique(framed.read_scenarios(spark, a.records))
    scenarios, states = json_files.timelines(nested), json_files.states_of(nested)
    points = external.with_times(submissions.read_submission(spark, a.submission), scenarios, forecast.STEPS)
    own = forecast.targets(scenarios).join(points.select("scenario_id").distinct(), "scenario_id", "left_semi")
    if odd := external.population_differences(points, own).limit(1).collect():
        raise SystemExit(f"agent {odd[0].agent_id} of {odd[0].scenario_id} is {odd[0].problem}")
    return states, scenarios, points, experiment.scores_of(points, states, a.miss_threshold), json_files.map_tables(nested)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.bootstrap_samples < 0:
        raise SystemExit("--bootstrap-samples must be nonnegative")
    found = assemble.evaluation(_scored(spark, a)[3], a.miss_threshold, a.bootstrap_samples, a.bootstrap_seed, a.parts)
    text = render.evaluation(found)
    render.write(a.json, render.as_json(found))
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, "evaluation"))
    say({k: found[k] for k in ("assumptions", "summary", "confidence_intervals", "by_object_type", "best_mode_counts")} if a.summary_only else found)
    return 0


def make_forecast(spark: SparkSession, a: argparse.Namespace) -> int:
    nested = unique(limited(framed.read_scenarios(spark, a.records), a.limit, a.records))
    points = assemble.forecasts(spark, json_files.states_of(nested), json_files.timelines(nested), a.model)
    submissions.write_submission(points, a.output)
    say({"model": a.model, "scenarios": nested.count(), "output": a.output})
    return 0


def compare_evaluations(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = json.loads(Path(a.policy).read_text()) if a.policy else {}
    summaries, scores = zip(*(json_files.read_report(spark, p) for p in (a.baseline, a.candidate)))
    found = assemble.comparison(*scores, compare.policy_of(raw), a.bootstrap_samples, a.bootstrap_seed, summaries)
    text = render.comparison(found)
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, "comparison"))
    say({k: v for k, v in found.items() if not (a.summary_only and (k in ("baseline", "candidate") or k.startswith("most_")))})
    return 0 if found["gate_passed"] else 1


def run_experiment(spark: SparkSession, a: argparse.Namespace) -> int:
    index = experiment.run(spark, a.manifest)
    say({k: index[k] for k in ("experiment_id", "source_revision", "dataset", "result")} | {"artifact_count": len(index["artifacts"])})
    return 0 if index["result"]["gate_passed"] else 1


def analyze_risk(spark: SparkSession, a: argparse.Namespace) -> int:
    states, scenarios, points, scores, maps = _scored(spark, a)
    if odd := risk.identity(scenarios, points, scores).limit(1).collect():
        raise SystemExit(f"scenario {odd[0].scenario_id}, agent {odd[0].agent_id}: {odd[0].problem}")
    thresholds = risk.RiskThresholds()
    found = assemble.risks(risk.evidence(states, scenarios, forecast.targets(scenarios), points, scores, maps["crosswalks"], maps["signs"], maps["signals"], thresholds), thresholds, a.parts)
    text = render.risks(found)
    render.write(a.json, render.as_json(found))
    render.write(a.markdown, text)
    render.write(a.html, render.html(text, "risk"))
    say({k: v for k, v in found.items() if k != "agents"} | {"highest_priority_cases": found["highest_priority_cases"][:5]} if a.summary_only else found)
    return 0


def import_predictions(spark: SparkSession, a: argparse.Namespace) -> int:
    nested = unique(framed.read_scenarios(spark, a.records))
    provenance, points = json_files.read_external(spark, a.predictions)
    provenance = external.check_provenance(provenance)
    own = forecast.targets(json_files.timelines(nested))
    if odd := external.population_differences(points, own).limit(1).collect():
        raise SystemExit(f"agent {odd[0].agent_id} of {odd[0].scenario_id} is {odd[0].problem}")
    if bad := external.invalid_modes(points).limit(1).collect():
        raise SystemExit(f"agent {bad[0].agent_id} of {bad[0].scenario_id} has invalid {bad[0].reason}")
    modes = external.normalized_confidence(points.where("point_ord = 0").select("scenario_id", "agent_id", "mode_index", "confidence"))
    named = points.drop("confidence").join(modes, ["scenario_id", "agent_id", "mode_index"]).join(own.select("scenario_id", "agent_id", "agent_ord"), ["scenario_id", "agent_id"])
    submissions.write_submission(named, a.output)
    say({"model": provenance["model_name"], "scenarios": own.select("scenario_id").distinct().count(), "agents": own.count(), "output": a.output})
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motioncheck", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str, reports: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for p in positional:
            own.add_argument(p, nargs="+") if p == "records" else own.add_argument(p)
        for r in reports:
            own.add_argument(f"--{r}")
        return own

    both = ("markdown", "html")
    command("verify", verify, "scenario", "requirements", reports=(*both, "svg"))
    command("verify-scenes", verify_scenes, "requirements", "records", reports=both).add_argument("--index", type=int, default=0)
    command("inspect", inspect, "records", reports=("svg",)).add_argument("--limit", type=int)
    command("compare-runs", compare_runs, "baseline", "candidate", "requirements", reports=(*both, "policy"))
    for name, run in (("evaluate", evaluate), ("risk", analyze_risk)):
        own = command(name, run, "submission", "records", reports=(*both, "json"))
        own.add_argument("--miss-threshold", type=float, default=2.0)
        own.add_argument("--summary-only", action="store_true")
        own.add_argument("--parts", help="a new folder for the rows of all agents, instead of the report")
        own.add_argument("--bootstrap-samples", type=int, default=1000)
        own.add_argument("--bootstrap-seed", type=int, default=0)
    own = command("forecast", make_forecast, "output", "records")
    own.add_argument("--model", choices=sorted(forecast.MODELS), default="kinematic_ensemble")
    own.add_argument("--limit", type=int)
    own = command("compare-evaluations", compare_evaluations, "baseline", "candidate", reports=(*both, "policy"))
    own.add_argument("--bootstrap-samples", type=int, default=2000)
    own.add_argument("--bootstrap-seed", type=int, default=0)
    own.add_argument("--summary-only", action="store_true")
    command("experiment", run_experiment, "manifest")
    command("import-predictions", import_predictions, "predictions", "output", "records")
    return top


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    return given.run(session(), given)


if __name__ == "__main__":
    sys.exit(main())
