"""Reports for people: terminal and Markdown."""

from __future__ import annotations

import os
import sys
from typing import TextIO

from textloom.models import Report
from textloom.rules import get_rule

_CODES = {"bold": 1, "dim": 2, "red": 31, "green": 32, "yellow": 33, "blue": 34, "cyan": 36}
_OF_SEVERITY = {"error": "red", "warning": "yellow", "info": "blue"}
SHOWN, SHOWN_ENTITIES = 6, 4


def supports_color(stream: TextIO | None = None) -> bool:
    """NO_COLOR turns colours off, FORCE_COLOR on; else a terminal has them."""
    if os.environ.get("NO_COLOR"):
        return False
    if os.environ.get("FORCE_COLOR"):
        return True
    return bool(getattr(stream or sys.stdout, "isatty", lambda: False)())


class Style:
    def __init__(self, enabled: bool):
        self.enabled = enabled

    def __call__(self, text: str, *names: str) -> str:
        if not self.enabled or not names:
            return text
        return f"\x1b[{';'.join(str(_CODES[n]) for n in names)}m{text}\x1b[0m"


def _fits_unicode() -> bool:
    return "utf" in (getattr(sys.stdout, "encoding", "") or "").lower()


def _sizes(report: Report) -> list[tuple[str, dict]]:
    m = report.metrics.get("chunk_stats", {})
    return [(k, m[k]) for k in ("char", "token") if k in m]


def render_terminal(report: Report, *, color: bool = False, unicode: bool | None = None) -> str:
    style, rich = Style(color), _fits_unicode() if unicode is None else unicode
    full, empty, dot = ("█", "░", "•") if rich else ("#", "-", "*")
    filled = round(report.health_score / 5)
    tone = "green" if report.health_score >= 80 else "yellow" if report.health_score >= 60 else "red"
    counts = report.counts_by_severity()
    out = [
        style(f"textloom: {report.root}", "bold"),
        f"{report.files_analyzed} file(s), {report.total_chunks} chunk(s)",
        "",
        "Health " + style(full * filled + empty * (20 - filled), tone) + f" {report.health_score}/100 {report.health_grade} ({report.health_label})",
        "Issues " + ", ".join(style(f"{counts[s]} {s}", _OF_SEVERITY[s]) for s in ("error", "warning", "info")),
    ]
    if report.baseline_suppressed:
        out.append(style(f"{report.baseline_suppressed} known finding(s) left out", "dim"))
    if sizes := _sizes(report):
        out += ["", f"{'':8}{'min':>9}{'median':>9}{'mean':>9}{'p95':>9}{'max':>9}"]
        out += [f"{k:8}" + "".join(f"{d[x]:>9}" for x in ("min", "median", "mean", "p95", "max")) for k, d in sizes]
        out.append(f"overlap {report.metrics['chunk_stats']['overlap_pct']} %, duplicated {report.metrics.get('duplicates', {}).get('duplicate_pct', 0.0)} %")
    if frag := report.metrics.get("fragmentation"):
        out += ["", f"Fragmentation (experimental) {frag['cfi']:.3f}"]
        out += [f"  {e['entity']}: {e['fragmentation']} in {e['chunks']} chunks" for e in frag["top_fragmented"][:SHOWN_ENTITIES]]
    for f in report.findings:
        out += ["", style(f"{f.severity.value.upper()} {f.rule_id}", "bold", _OF_SEVERITY[f.severity.value]) + f" {get_rule(f.rule_id).name}" + (" (experimental)" if f.experimental else ""), f"  {f.message}"]
        out += [f"  {dot} {x.render()}" for x in f.locations[:SHOWN]]
        if len(f.locations) > SHOWN:
            out.append(style(f"  and {len(f.locations) - SHOWN} more", "dim"))
        if f.recommendation:
            out.append(style(f"  {f.recommendation}", "cyan"))
    if not report.findings:
        out += ["", style("No findings.", "green")]
    return "\n".join(out) + "\n"


def _cell(value: object) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def render_markdown(report: Report) -> str:
    counts = report.counts_by_severity()
    out = [
        f"# Corpus report: {report.root}", "",
        f"**Health {report.health_score}/100 ({report.health_grade}, {report.health_label})**", "",
        f"{report.files_analyzed} file(s), {report.total_chunks} chunk(s); {counts['error']} error(s), {counts['warning']} warning(s), {counts['info']} info. Made {report.generated_at}.",
    ]
    if sizes := _sizes(report):
        out += ["", "## Chunks", "", "| | min | median | mean | p95 | max | stdev |", "|-|-|-|-|-|-|-|"]
        out += [f"| {k} | " + " | ".join(str(d[x]) for x in ("min", "median", "mean", "p95", "max", "stdev")) + " |" for k, d in sizes]
    if (frag := report.metrics.get("fragmentation")) and frag["top_fragmented"]:
        out += ["", f"## Fragmentation (experimental): {frag['cfi']:.3f}", "", "| entity | fragmentation | chunks |", "|-|-|-|"]
        out += [f"| {_cell(e['entity'])} | {e['fragmentation']} | {e['chunks']} |" for e in frag["top_fragmented"]]
    out += ["", "## Findings", ""] + (["None."] if not report.findings else [])
    for f in report.findings:
        out += [f"### {f.rule_id} {get_rule(f.rule_id).name} ({f.severity.value})", "", f.message, ""]
        out += [f"- `{x.render()}`" for x in f.locations] + ([""] if f.locations else [])
        out += [f"> {f.recommendation}", ""] if f.recommendation else []
    return "\n".join(out).rstrip() + "\n"


def render_compare(before: Report, after: Report, delta: dict, *, color: bool = False) -> str:
    style = Style(color)
    pick = lambda r, a, m: r.metrics.get(a, {}).get(m, 0)
    rows = [
        ("health", before.health_score, after.health_score, delta["health"]),
        ("findings", len(before.findings), len(after.findings), delta["findings"]),
        ("duplicated %", pick(before, "duplicates", "duplicate_pct"), pick(after, "duplicates", "duplicate_pct"), delta["duplicate_pct"]),
        ("fragmentation", pick(before, "fragmentation", "cfi"), pick(after, "fragmentation", "cfi"), delta["cfi"]),
    ]
    verdict = "better" if delta["health"] > 0 else "worse" if delta["health"] < 0 else "unchanged"
    out = [style(f"{before.root} -> {after.root}", "bold"), *(f"{n:14}{a:>10}{b:>10}{d:>+10}" for n, a, b, d in rows), style(f"Health is {verdict}.", {"better": "green", "worse": "red"}.get(verdict, "dim"))]
    return "\n".join(out) + "\n"
