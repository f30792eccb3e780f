"""Markdown, HTML and SVG of payloads: deterministic text, made on the driver from small results."""

from __future__ import annotations

import json
import math
from html import escape
from pathlib import Path


def figure(x: object) -> str:
    if x is None:
        return "n/a"
    if isinstance(x, bool):
        return "yes" if x else "no"
    return f"{x:.3f}" if isinstance(x, float) else ", ".join(map(figure, x)) if isinstance(x, (list, tuple)) else str(x)


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "none\n"
    columns = columns or [c for c in rows[0] if not isinstance(rows[0][c], (dict, list))]
    lines = [" | ".join(columns), " | ".join("---" for _ in columns)]
    lines += [" | ".join(figure(r.get(c)).replace("|", "\\|") for c in columns) for r in rows]
    return "\n".join(f"| {line} |" for line in lines) + "\n"


#: What a report's figures can and can't show.
BOUNDARIES = {
    "validation": "A failed requirement says that this recording went beyond a threshold that the project chose. By itself it proves no unsafe operation and makes no claim about any system in service.",
    "evaluation": "The scores are a diagnostic that the project defines, not those of an official challenge. Displacements are minimised for each metric by itself, over all modes.",
    "comparison": "The gate applies the project's tolerances to the same agents of two sets of forecasts. It is no measure of safety.",
}


def bounded(kind: str) -> list[str]:
    return ["## Interpretation boundary", "", BOUNDARIES[kind], ""]


def signed(x: float | None) -> str:
    return figure(x) if x is None else f"{x:+.6g}"


def _status(result: dict) -> str:
    return "NOT APPLICABLE" if not result["applicable"] else "PASS" if result["passed"] else "FAIL"


def _range(result: dict) -> str:
    units = f" {result['units']}" if result.get("units") else ""
    return "not evaluated" if result["observed_min"] is None else f"{figure(result['observed_min'])} to {figure(result['observed_max'])}{units}"


def validation(report: dict) -> str:
    every = report["requirement_evidence"]
    out = [f"# Scenario {report['scenario_id']}: {report['overall_status']}", "", f"{report['passed_count']} of {report['applicable_count']} applicable requirements passed, of {report['total']}.", ""]
    out += ["## Requirements", "", table([{"requirement": e["result"]["requirement_id"], "result": _status(e["result"]), "confidence": e["evidence_confidence"], "evaluated": e["result"]["evaluated_samples"], "failed": e["result"]["failed_samples"], "observed": _range(e["result"])} for e in every])]
    for e in every:
        r, asked = e["result"], e["requirement"]
        units, other = f" {r['units']}" if r.get("units") else "", f" and {asked['other_id']}" if asked["other_id"] else ""
        out += [f"## {r['requirement_id']}: {_status(r)}", "", f"{asked['metric']} {asked['operator'].replace('_', ' ')} {asked['threshold']:g}{units}, of {asked['agent_id']}{other}.", ""]
        out += [f"Observed {_range(r)}; {r['failed_samples']} of {r['evaluated_samples']} samples failed. Confidence {e['evidence_confidence']}: {e['confidence_rationale']}.", ""]
        if not r["applicable"]:
            out += [f"Not applicable: {r['not_applicable_reason']}.", ""]
        out += [f"- {x['narrative']}" for x in e["explanations"]] or (["No sample failed.", ""] if r["applicable"] else [])
        if e["sensitivity"]:
            out += ["", table(e["sensitivity"], ["threshold", "passed", "failed_samples", "failed_fraction"])]
    out += ["## Data quality", "", table([q | {"agent_ids": ", ".join(q["agent_ids"])} for q in report["quality_annotations"]], ["code", "severity", "agent_ids", "message"])]
    return "\n".join([*out, *bounded("validation")])


def regression(found: dict) -> str:
    moves = [t for s in found["scenarios"] for t in s["transitions"]]
    out = [f"# Regression: {'PASS' if found['gate_passed'] else 'FAIL'}", "", table([found["counts"]]), *[f"- {v}" for v in found["violations"]], "", table(moves, ["scenario_id", "requirement_id", "baseline_status", "candidate_status", "classification"])]
    for kind in ("missing", "added"):
        if names := found[f"{kind}_candidate_scenarios"]:
            out += [f"{kind.capitalize()}: " + ", ".join(names), ""]
    return "\n".join(out) + "\n"


#: Which column of the summary an interval is of.
ESTIMATES = {"min_ade_m": "mean_min_ade_m", "min_fde_m": "mean_min_fde_m", "miss": "miss_rate"}


RANKING = ["scenario_id", "agents", "mean_min_ade_m", "mean_min_fde_m", "miss_rate", "mean_ground_truth_coverage"]


def evaluation(found: dict) -> str:
    mean = lambda own, name: math.fsum(float(a[name]) for a in own) / len(own)
    ranking = [{"scenario_id": s["scenario_id"], "agents": len(s["agents"]), "mean_min_ade_m": mean(s["agents"], "min_ade_m"), "mean_min_fde_m": mean(s["agents"], "min_fde_m"), "miss_rate": mean(s["agents"], "miss"), "mean_ground_truth_coverage": mean(s["agents"], "ground_truth_coverage")} for s in found.get("scenarios", [])]
    ranking.sort(key=lambda r: (-r["mean_min_ade_m"], r["scenario_id"]))
    ranking = ranking or found["worst_scenarios_by_min_ade"]
    intervals = [{"metric": ESTIMATES[k], "estimate": found["summary"][ESTIMATES[k]]} | v for k, v in found["confidence_intervals"].items()]
    modes = [{"best_mode": k, "agents": n} for k, n in found["best_mode_counts"].items()]
    parts = ["# Forecast evaluation", "", f"A miss is beyond {found['assumptions']['miss_threshold_m']:g} m.", "", table([found["summary"]]), "## Confidence intervals", "", table(intervals), "## Object types", "", table(list(found["by_object_type"].values())), "## Best modes", "", table(modes), "## Scenarios", "", table(ranking, RANKING)]
    return "\n".join([*parts, *bounded("evaluation")])


#: Which metric of the change counts an interval is of.
CHANGES = {"min_ade_delta_m": "min_ade_m", "min_fde_delta_m": "min_fde_m", "miss_delta": "miss"}


def comparison(found: dict) -> str:
    parts = ["# Comparison: " + ("PASS" if found["gate_passed"] else "FAIL"), "", f"{found['agent_count']} agents of {found['scenario_count']} scenarios.", ""]
    if found["violations"]:
        parts += ["## Policy violations", "", *[f"- {v}" for v in found["violations"]], ""]
    names = [n.removesuffix("_delta") for n in found["deltas"]]
    parts += ["## Means", "", table([{"metric": n, "baseline": found["baseline"].get(n), "candidate": found["candidate"].get(n), "delta": signed(found["deltas"][f"{n}_delta"])} for n in names])]
    changes = []
    for name, metric in CHANGES.items():
        counts, interval = found["agent_change_counts"].get(metric, {}), found["paired_confidence_intervals"].get(name, {})
        changes.append({"metric": name, "lower": signed(interval.get("lower")), "upper": signed(interval.get("upper"))} | {k: counts.get(k, 0) for k in ("improved", "unchanged", "regressed")})
    parts += ["## Changes of agents, with paired intervals", "", table(changes)]
    for name in ("most_improved_scenarios", "most_regressed_scenarios", "most_improved_agents", "most_regressed_agents"):
        parts += [f"## {name.replace('_', ' ').capitalize()}", "", table(found[name])]
    return "\n".join([*parts, *bounded("comparison")])


def risks(found: dict) -> str:
    return "\n".join(["# Risk context", "", found["interpretation"], "", "## By motion class", "", table([{"motion_class": k} | v for k, v in found["by_motion_class"].items()]), "## By priority", "", table([{"review_priority": k} | v for k, v in found["by_review_priority"].items()]), "## First cases", "", table(found["highest_priority_cases"], ["scenario_id", "agent_id", "review_priority", "motion_class", "min_ade_m", "risk_tags"]), "## Thresholds", "", table([found["thresholds"]])])


def html(markdown: str, title: str) -> str:
    """A page of the Markdown that this module writes: headings, lists, tables and paragraphs."""
    body: list[str] = []
    rows: list[str] = []
    for line in [*markdown.split("\n"), ""]:
        if line.startswith("|"):
            rows.append(line)
            continue
        if rows:
            cells = [[escape(c.strip().replace("\\|", "|")) for c in r.strip("| ").split(" | ")] for r in rows]
            body.append("<table><tr>" + "".join(f"<th>{c}</th>" for c in cells[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells[2:]) + "</table>")
            rows = []
        level = len(line) - len(line.lstrip("#"))
        if level:
            body.append(f"<h{level}>{escape(line[level:].strip())}</h{level}>")
        elif line.startswith("- "):
            body.append(f"<li>{escape(line[2:])}</li>")
        elif line:
            body.append(f"<p>{escape(line)}</p>")
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body>{''.join(body)}</body></html>\n"


def write(path: str | None, text: str) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")


def as_json(payload: object) -> str:
    return json.dumps(payload, indent=2, sort_keys=False, default=str) + "\n"


#: The colours of a drawing.
COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f")


def svg(scenario: dict, width: int = 900, height: int = 700, padding: int = 50) -> str:
    """A drawing of a nested scenario: tracks, lanes, crosswalks and stop signs, to one scale with y upwards."""
    if width <= 2 * padding or height <= 2 * padding:
        raise ValueError("the canvas is smaller than its padding")
    lines = {k: [[(p["x_m"], p["y_m"]) for p in f["points"]] for f in scenario.get(k) or []] for k in ("lanes", "crosswalks")}
    signs = [(s["position"]["x_m"], s["position"]["y_m"]) for s in scenario.get("stop_signs") or []]
    tracks = {t["agent_id"]: [(s["x_m"], s["y_m"]) for s in t["states"]] for t in scenario["tracks"]}
    finite = lambda points: [p for p in points if all(map(math.isfinite, p))]
    every = finite([p for own in [*lines["lanes"], *lines["crosswalks"], signs, *tracks.values()] for p in own])
    if not every:
        raise ValueError("there are no finite points to draw")
    low = [min(p[i] for p in every) for i in (0, 1)]
    span = [max(1.0, max(p[i] for p in every) - low[i]) for i in (0, 1)]
    scale = min((width - 2 * padding) / span[0], (height - 2 * padding) / span[1])
    at = lambda p: f"{padding + (p[0] - low[0]) * scale:.2f},{height - padding - (p[1] - low[1]) * scale:.2f}"
    path = lambda points: " ".join(map(at, finite(points)))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f"<title>{escape(scenario['scenario_id'])}</title>"]
    out += [f'<polyline class="lane" points="{path(x)}" fill="none" stroke="#bbb" stroke-dasharray="6 4"/>' for x in lines["lanes"]]
    out += [f'<polygon class="crosswalk" points="{path(x)}" fill="#eee" stroke="#999"/>' for x in lines["crosswalks"]]
    for p in finite(signs):
        x, y = at(p).split(",")
        out.append(f'<rect class="stop" x="{x}" y="{y}" width="8" height="8" fill="#c00" transform="rotate(45 {x} {y})"/>')
    for i, (agent, points) in enumerate(tracks.items()):
        own = 4 if agent == scenario.get("sdc_agent_id") else 2
        out.append(f'<polyline class="track" points="{path(points)}" fill="none" stroke="{COLOURS[i % len(COLOURS)]}" stroke-width="{own}"><title>{escape(agent)}</title></polyline>')
    return "\n".join([*out, "</svg>"]) + "\n"
