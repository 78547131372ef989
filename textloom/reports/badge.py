"""A score badge, as the JSON of a badge endpoint."""

from __future__ import annotations

import json

from textloom.models import Report

_COLOURS = ((90, "brightgreen"), (80, "green"), (70, "yellowgreen"), (60, "yellow"), (40, "orange"), (0, "red"))


def colour(score: int) -> str:
    return next(c for least, c in _COLOURS if score >= least)


def render_badge(report: Report) -> str:
    return json.dumps({"schemaVersion": 1, "label": "corpus health", "message": f"{report.health_score}/100 ({report.health_grade})", "color": colour(report.health_score)})


def badge_markdown(report: Report) -> str:
    grade = report.health_grade.replace("+", "%2B")
    return f"![corpus health](https://img.shields.io/badge/corpus%20health-{report.health_score}%2F100%20{grade}-{colour(report.health_score)})"
