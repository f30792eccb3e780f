"""Payloads: small results of the operators, as plain dictionaries on the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.operators import compare, evidence, forecast, regression, requirements, risk, scoring, signals
from motioncheck.sources import parted

#: What each grade of confidence rests on.
RATIONALES = {"not_applicable": "the requirement does not apply", "low": "too few samples, or data errors", "medium": "few samples, or data warnings", "high": "enough samples and no data warnings"}


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _by(rows: list[dict], *keys: str) -> dict[tuple, list[dict]]:
    out: dict[tuple, list[dict]] = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def validation(recording: requirements.Recording, wanted: DataFrame) -> list[dict]:
    """A report per scenario: status, and for each requirement its result, intervals, sensitivity, quality and confidence."""
    if odd := requirements.unsupported(wanted).limit(5).collect():
        raise ValueError(f"unsupported metric or operator: {', '.join(r.requirement_id for r in odd)}")
    resolved = requirements.resolve(wanted, recording.scenarios).cache()
    if bad := requirements.unresolved(resolved).limit(5).collect():
        raise ValueError(f"no agent for {', '.join(f'{r.requirement_id} in {r.scenario_id}' for r in bad)}")
    if lost := requirements.unknown_agents(resolved, recording.states).limit(5).collect():
        raise KeyError(f"unknown agents {', '.join(f'{r.agent_id} in {r.scenario_id}' for r in lost)}")
    pairs = resolved.where(F.col("metric").isin(*requirements.PAIRED)).select("scenario_id", "agent_id", "other_id")
    if few := signals.misaligned(recording.states, pairs).limit(5).collect():
        raise ValueError(f"fewer than two common times: {', '.join(f'{r.agent_id} and {r.other_id} in {r.scenario_id}' for r in few)}")
    judged = requirements.judged(requirements.samples(resolved, recording), resolved).cache()
    results = requirements.with_reasons(requirements.results(judged, resolved), resolved, recording).cache()
    quality = evidence.quality(recording.states, recording.scenarios).cache()
    keys = ("scenario_id", "req_ord")
    intervals = _by(_rows(evidence.explanations(requirements.failure_intervals(judged)).orderBy("start_time_s")), *keys)
    swept = _by(_rows(evidence.sensitivity(judged, resolved, results).orderBy("threshold")), *keys)
    grades = {(r["scenario_id"], r["req_ord"]): r["evidence_confidence"] for r in _rows(evidence.confidence(results, resolved, quality))}
    notes = _by(_rows(quality.orderBy("code")), "scenario_id")
    own_notes = _by(_rows(evidence.relevant(resolved, quality).orderBy("code")), *keys)
    units = {r["req_ord"]: r["units"] for r in _rows(wanted.select("req_ord", "units"))} if "units" in wanted.columns else {}
    stated = {(r["scenario_id"], r["req_ord"]): r for r in _rows(resolved)}
    of = _by(_rows(results.orderBy(*keys)), "scenario_id")
    reports = []
    for roll in _rows(evidence.rollup(results).orderBy("scenario_id")):
        own = []
        for r in of[(roll["scenario_id"],)]:
            key = (r["scenario_id"], r["req_ord"])
            unit = units.get(r["req_ord"]) or ""
            words = [narrative(stated[key], i, unit) for i in intervals.get(key, [])]
            reason = r["not_applicable_reason"]
            own.append({"requirement": stated[key] | {"units": unit}, "result": r | {"units": unit}, "explanations": [i | {"narrative": w} for i, w in zip(intervals.get(key, []), words)], "sensitivity": swept.get(key, []), "quality_annotations": [{k: n[k] for k in ("code", "severity", "message", "agent_ids")} for n in own_notes.get(key, [])], "evidence_confidence": grades[key], "confidence_rationale": reason or RATIONALES[grades[key]]})
        reports.append(roll | {"passed": roll["overall_status"] == "PASS", "quality_annotations": notes.get((roll["scenario_id"],), []), "requirement_evidence": own})
    for df in (resolved, judged, results, quality):
        df.unpersist()
    return reports


def narrative(requirement: dict, interval: dict, units: str = "") -> str:
    side, of = "below" if requirement["operator"].startswith("greater") else "above", f" {units}" if units else ""
    return f"{requirement['metric']} was {side} {requirement['threshold']:g}{of} from {interval['start_time_s']:g} s to {interval['end_time_s']:g} s; the worst value was {interval['worst_value']:g}{of}, {interval['threshold_deviation']:g}{of} off"


def regressions(baseline: requirements.Recording, candidate: requirements.Recording, wanted: DataFrame, policy: regression.RegressionPolicy) -> dict:
    """Gate, counts, missing and added scenarios, transitions per scenario."""
    sides = []
    for of in (baseline, candidate):
        resolved = requirements.resolve(wanted, of.scenarios)
        sides.append(requirements.results(requirements.judged(requirements.samples(resolved, of), resolved), resolved))
    moved = regression.transitions(*sides).cache()
    changes = regression.missing_added(baseline.scenarios, candidate.scenarios).cache()
    gate = _rows(regression.gate(moved, changes, policy))[0]
    of = _by(_rows(moved.orderBy("scenario_id", "req_ord")), "scenario_id")
    violations = []
    if gate["new_failures"] > policy.max_new_failures:
        violations.append(f"{gate['new_failures']} new failures; {policy.max_new_failures} are allowed")
    if gate["missing_candidate_scenarios"] and policy.fail_on_missing_candidate_scenarios:
        violations.append(f"{gate['missing_candidate_scenarios']} scenarios are missing")
    if gate["lost_applicability"] and policy.fail_on_lost_applicability:
        violations.append(f"{gate['lost_applicability']} requirements no longer apply")
    sets = _by(_rows(changes.orderBy("scenario_id")), "kind")
    return {
        "gate_passed": gate.pop("gate_passed"),
        "counts": gate,
        "missing_candidate_scenarios": [r["scenario_id"] for r in sets.get(("missing",), [])],
        "added_candidate_scenarios": [r["scenario_id"] for r in sets.get(("added",), [])],
        "violations": violations,
        "scenarios": [r | {"transitions": of[(r["scenario_id"],)]} for r in _rows(regression.scenario_regressions(moved).orderBy("scenario_id"))],
    }


def _intervals(df: DataFrame, columns: tuple[str, ...], samples: int, seed: int) -> dict:
    if samples < 1:
        return {}
    resample = compare.bootstrap_exact if df.count() <= compare.EXACT_MOST else compare.bootstrap_split
    return {r.metric: {"lower": r.lower, "upper": r.upper, "confidence": 0.95} for r in resample(compare.metric_values(df, columns), samples, seed).collect()}


#: Scenarios that a report ranks where its scores are in a folder.
RANKED = 100


def evaluation(scores: DataFrame, miss_threshold_m: float = 2.0, samples: int = 1000, seed: int = 0, folder: str | None = None) -> dict:
    """Summary, intervals, strata, histogram, worst agents and all scores of forecasts.

    folder: a new folder that tasks write the scores to; the report then names it, and ranks the
    RANKED worst scenarios, so that what the driver holds doesn't grow with the agents.
    """
    scores = scores.cache()
    if scores.isEmpty():
        raise ValueError("there are no scores")
    order = ("scenario_id", "agent_id")
    summary = _rows(scoring.means(scores))[0]
    out = {
        "assumptions": {"miss_threshold_m": miss_threshold_m, "bootstrap_samples": samples, "bootstrap_seed": seed},
        "summary": {"scenarios": scores.select("scenario_id").distinct().count()} | summary,
        "confidence_intervals": _intervals(scores, ("min_ade_m", "min_fde_m", "miss"), samples, seed),
        "by_object_type": {r["object_type"]: r for r in _rows(scoring.means(scores, "object_type").orderBy("object_type"))},
        "best_mode_counts": {str(r["best_mode_index"]): r["agents"] for r in _rows(scoring.best_mode_counts(scores).orderBy("best_mode_index"))},
        "worst_agents_by_min_ade": _rows(scoring.worst_agents(scores)),
    }
    if folder:
        ranked = scoring.means(scores, "scenario_id").orderBy(F.desc("mean_min_ade_m"), "scenario_id").limit(RANKED)
        out |= {"worst_scenarios_by_min_ade": _rows(ranked), "parts": parted.write(scores, order, folder)}
    else:
        out["scenarios"] = [{"scenario_id": k, "agents": v} for (k,), v in _by(_rows(scores.orderBy(*order)), "scenario_id").items()]
    scores.unpersist()
    return out


def comparison(baseline: DataFrame, candidate: DataFrame, policy: compare.ComparisonPolicy, samples: int = 2000, seed: int = 0, summaries: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """Gate, deltas, violations, paired intervals, change counts and rankings of two sets of scores of the same agents.

    summaries: a row of means for each side as its report states them; else they are taken from the scores.
    """
    if samples < 0:
        raise ValueError("samples must be nonnegative")
    if not samples and (policy.require_significant_ade_improvement or policy.require_significant_fde_improvement):
        raise ValueError("significance needs samples")
    if not compare.same_agents(baseline, candidate):
        if odd := compare.identity(baseline, candidate).limit(1).collect():
            raise ValueError(f"agent {odd[0].agent_id} of {odd[0].scenario_id} is only in the {odd[0].only_in}")
        raise ValueError("an agent is repeated")
    deltas = compare.agent_deltas(baseline, candidate).cache()
    means = summaries or tuple(scoring.means(df) for df in (baseline, candidate))
    moved = _rows(compare.gate(*means, policy))[0]
    moved.pop("gate_passed")
    intervals = _intervals(deltas, ("min_ade_delta_m", "min_fde_delta_m", "miss_delta"), samples, seed)
    found = compare.violations(moved, intervals, policy)
    out = {
        "gate_passed": not found,
        "scenario_count": deltas.select("scenario_id").distinct().count(),
        "agent_count": deltas.count(),
        "baseline": _rows(means[0])[0],
        "candidate": _rows(means[1])[0],
        "deltas": moved,
        "violations": found,
        "paired_confidence_intervals": intervals,
        "agent_change_counts": {r["metric"]: r for r in _rows(compare.change_counts(deltas))},
    }
    by_scenario = compare.scenario_deltas(deltas)
    for kind, down in (("improved", False), ("regressed", True)):
        out[f"most_{kind}_agents"] = _rows(compare.most_changed(deltas, down))
        order = F.desc("mean_min_ade_delta_m") if down else F.asc("mean_min_ade_delta_m")
        out[f"most_{kind}_scenarios"] = _rows(by_scenario.orderBy(order, "scenario_id").limit(10))
    deltas.unpersist()
    return out


def risks(found: DataFrame, thresholds: risk.RiskThresholds, folder: str | None = None) -> dict:
    """Counters, strata, the cases to review first, and all agents; folder: as of evaluation()."""
    found = found.cache()
    counters = _by(_rows(risk.counters(found).orderBy("kind", "name")), "kind")
    strata = _by(_rows(risk.strata(found).orderBy("kind", "name")), "kind")
    out = {
        "interpretation": "context of forecast errors for review; not a measure of safety",
        "thresholds": vars(thresholds),
        "summary": {"agents": found.count()} | {k: {r["name"]: r["agents"] for r in counters.get((n,), [])} for k, n in (("review_priority", "review_priority"), ("motion_class", "motion_class"), ("risk_tags", "risk_tag"))},
        "by_motion_class": {r.pop("name"): {k: v for k, v in r.items() if k != "kind"} for r in strata.get(("motion_class",), [])},
        "by_review_priority": {r.pop("name"): {k: v for k, v in r.items() if k != "kind"} for r in strata.get(("review_priority",), [])},
        "highest_priority_cases": _rows(risk.reported(risk.top_cases(found))),
    }
    every, order = risk.reported(found), ("scenario_id", "agent_id")
    out |= {"parts": parted.write(every, order, folder)} if folder else {"agents": _rows(every.orderBy(*order))}
    found.unpersist()
    return out


def forecasts(spark: SparkSession, states: DataFrame, scenarios: DataFrame, model: str) -> DataFrame:
    """Forecast points; ValueError where a scenario has no current time, too short a timeline, or nobody to predict."""
    bad = scenarios.where(F.col("current_time_index").isNull() | (F.size("timestamps_s") <= forecast.STEPS[-1]) | (F.size("tracks_to_predict") == 0))
    if rows := bad.select("scenario_id").limit(5).collect():
        raise ValueError(f"scenarios that can't be forecast: {', '.join(r.scenario_id for r in rows)}")
    return forecast.forecast(states, scenarios, model)
