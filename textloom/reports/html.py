"""A page of its own, without scripts; everything from the corpus is escaped."""

from __future__ import annotations

from html import escape

from textloom.models import Report
from textloom.rules import get_rule

SHOWN = 8
_STYLE = """
body{font:15px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#1f2328}
h1{font-size:1.4rem}.row{display:flex;gap:2rem;align-items:center;flex-wrap:wrap}.kpi b{display:block;font-size:1.3rem}
.f{border-left:4px solid #999;padding:.3rem .8rem;margin:.8rem 0;background:#f6f8fa}.error{border-color:#cf222e}.warning{border-color:#bf8700}.info{border-color:#0969da}
code{background:#eaeef2;padding:0 .25rem}.bar{display:flex;height:.6rem;width:16rem}.bar i{display:block}
"""


def _ring(score: int) -> str:
    around = 2 * 3.14159 * 42
    colour = "#1a7f37" if score >= 80 else "#bf8700" if score >= 60 else "#cf222e"
    return (
        '<svg width="110" height="110" role="img" aria-label="health"><circle cx="55" cy="55" r="42" fill="none" stroke="#eaeef2" stroke-width="10"/>'
        f'<circle cx="55" cy="55" r="42" fill="none" stroke="{colour}" stroke-width="10" stroke-dasharray="{around * score / 100:.1f} {around:.1f}" transform="rotate(-90 55 55)"/>'
        f'<text x="55" y="62" text-anchor="middle" font-size="24">{score}</text></svg>'
    )


def _histogram(report: Report) -> str:
    h = report.metrics.get("chunk_stats", {}).get("histogram") or {"edges": [], "counts": []}
    if not h["counts"]:
        return ""
    top, bars = max(h["counts"]) or 1, []
    for i, n in enumerate(h["counts"]):
        tall = 80 * n / top
        bars.append(f'<rect x="{i * 26}" y="{90 - tall:.1f}" width="22" height="{tall:.1f}" fill="#0969da"><title>{h["edges"][i]} to {h["edges"][i + 1]}: {n}</title></rect>')
    return f'<h2>Chunk sizes</h2><svg width="{26 * len(bars)}" height="92" role="img" aria-label="histogram">{"".join(bars)}</svg>'


def _severities(report: Report) -> str:
    counts = report.counts_by_severity()
    total = sum(counts.values())
    if not total:
        return ""
    colours = {"error": "#cf222e", "warning": "#bf8700", "info": "#0969da"}
    return '<div class="bar">' + "".join(f'<i style="width:{100 * counts[s] / total:.1f}%;background:{c}" title="{counts[s]} {s}"></i>' for s, c in colours.items()) + "</div>"


def render_html(report: Report) -> str:
    kpis = (("files", report.files_analyzed), ("chunks", report.total_chunks), ("findings", len(report.findings)), ("duplicated %", report.metrics.get("duplicates", {}).get("duplicate_pct", 0.0)), ("fragmentation", report.metrics.get("fragmentation", {}).get("cfi", 0.0)))
    out = [
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Corpus report</title><style>{_STYLE}</style></head><body>',
        f"<h1>Corpus report: {escape(report.root)}</h1><p>{escape(report.generated_at)}</p><div class=row>{_ring(report.health_score)}",
        f"<div class=kpi><b>{escape(report.health_grade)}</b>{escape(report.health_label)}</div>",
        *(f"<div class=kpi><b>{escape(str(v))}</b>{escape(k)}</div>" for k, v in kpis), "</div>",
        _severities(report), _histogram(report),
    ]
    if top := report.metrics.get("fragmentation", {}).get("top_fragmented"):
        out += ["<h2>Scattered entities (experimental)</h2><ul>", *(f"<li>{escape(e['entity'])}: {e['fragmentation']} in {e['chunks']} chunks</li>" for e in top), "</ul>"]
    out.append("<h2>Findings</h2>" + ("" if report.findings else "<p>None.</p>"))
    for f in report.findings:
        places = "".join(f"<li><code>{escape(x.render())}</code></li>" for x in f.locations[:SHOWN])
        more = f"<li>and {len(f.locations) - SHOWN} more</li>" if len(f.locations) > SHOWN else ""
        out.append(f'<div class="f {f.severity.value}"><b>{escape(f.rule_id)}</b> {escape(get_rule(f.rule_id).name)}<p>{escape(f.message)}</p><ul>{places}{more}</ul><p>{escape(f.recommendation)}</p></div>')
    return "\n".join([*out, "</body></html>"]) + "\n"
