"""JSON and SARIF."""

from __future__ import annotations

import json

from textloom import __version__
from textloom.models import Finding, Location, Report
from textloom.rules import Rule, all_rules, get_rule

#: Where reports say that the tool is at home.
HOME = "https://textloom.example/"
_LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def finding_to_dict(f: Finding) -> dict:
    rule = get_rule(f.rule_id)
    places = [{"file": x.file, "chunk_id": x.chunk_id, "line": x.line, "detail": x.detail} for x in f.locations]
    return {"rule": f.rule_id, "name": rule.name, "category": rule.category, "severity": f.severity.value, "message": f.message, "recommendation": f.recommendation, "experimental": f.experimental, "locations": places, "data": f.data}


def report_to_dict(report: Report) -> dict:
    return {
        "tool": "textloom",
        "version": __version__,
        "root": report.root,
        "generated_at": report.generated_at,
        "health": {"score": report.health_score, "grade": report.health_grade, "label": report.health_label},
        "summary": {"files_analyzed": report.files_analyzed, "total_chunks": report.total_chunks, "findings": len(report.findings), "by_severity": report.counts_by_severity(), "baseline_suppressed": report.baseline_suppressed},
        "metrics": report.metrics,
        "findings": [finding_to_dict(f) for f in report.findings],
        "config": report.config,
    }


def render_json(report: Report) -> str:
    return json.dumps(report_to_dict(report), indent=2, ensure_ascii=False)


def _sarif_rule(rule: Rule) -> dict:
    return {
        "id": rule.id, "name": rule.name, "shortDescription": {"text": rule.description}, "fullDescription": {"text": rule.recommendation}, "helpUri": f"{HOME}#rules",
        "properties": {"category": rule.category, "experimental": rule.experimental}, "defaultConfiguration": {"level": _LEVELS[rule.default_severity.value]},
    }


def _sarif_place(x: Location) -> dict:
    region = {} if x.line is None else {"region": {"startLine": max(1, x.line)}}
    return {"physicalLocation": {"artifactLocation": {"uri": x.file}, **region}}


def _sarif_result(f: Finding) -> dict:
    places = {"locations": [*map(_sarif_place, f.locations)]} if f.locations else {}
    return {"ruleId": f.rule_id, "level": _LEVELS[f.severity.value], "message": {"text": f"{f.message} {f.recommendation}"}, **places}


def render_sarif(report: Report) -> str:
    driver = {"name": "textloom", "informationUri": HOME, "version": __version__, "rules": [*map(_sarif_rule, all_rules())]}
    run = {"tool": {"driver": driver}, "results": [*map(_sarif_result, report.findings)], "properties": {"healthScore": report.health_score, "healthGrade": report.health_grade}}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)
