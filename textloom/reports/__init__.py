"""Renderers of a report."""

from __future__ import annotations

from textloom.models import Report
from textloom.reports.badge import badge_markdown, render_badge
from textloom.reports.html import render_html
from textloom.reports.structured import render_json, render_sarif, report_to_dict
from textloom.reports.texts import render_compare, render_markdown, render_terminal

FORMATS = ("terminal", "json", "markdown", "html", "sarif", "badge")


def render(report: Report, fmt: str = "terminal", *, color: bool = False) -> str:
    if fmt == "terminal":
        return render_terminal(report, color=color)
    table = {"json": render_json, "markdown": render_markdown, "html": render_html, "sarif": render_sarif, "badge": render_badge}
    if fmt not in table:
        raise ValueError(f"Unknown report format: {fmt!r}; there are {', '.join(FORMATS)}")
    return table[fmt](report)


__all__ = ["FORMATS", "badge_markdown", "render", "render_compare", "report_to_dict"]
