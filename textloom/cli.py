"""Command line: analyze, compare, baseline, rules."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from textloom import __version__
from textloom.baseline import load_baseline, save_baseline
from textloom.config import Config
from textloom.engine import analyze_path, analyze_paths, compare
from textloom.models import Severity
from textloom.plugins import load_all
from textloom.reports import FORMATS, badge_markdown, render, render_compare, report_to_dict
from textloom.reports.texts import supports_color
from textloom.rules import all_rules

_NUMBERS = ("chunk_size", "chunk_overlap", "max_chunk_chars", "min_chunk_chars", "embedding_token_limit", "shingle_size", "max_chunks_per_heading", "min_entity_freq")


def _ids(value: str) -> tuple[str, ...]:
    return tuple(x.strip().upper() for x in value.split(",") if x.strip())


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description="Measure the quality of text corpora for retrieval.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config")
    common.add_argument("--select", type=_ids)
    common.add_argument("--ignore", type=_ids)
    common.add_argument("--plugin", action="append", default=[])
    for n in _NUMBERS:
        common.add_argument("--" + n.replace("_", "-"), type=int)
    common.add_argument("--near-duplicate-threshold", type=float)
    common.add_argument("--cfi-threshold", type=float, dest="cfi_warning_threshold")
    for n in ("secrets", "pii", "encoding"):
        common.add_argument(f"--no-{n}", action="store_true")
    a = commands.add_parser("analyze", parents=[common], help="analyze files and folders")
    a.add_argument("paths", nargs="+")
    a.add_argument("--format", "-f", choices=FORMATS, default="terminal")
    a.add_argument("--output", "-o")
    a.add_argument("--fail-on", choices=["error", "warning", "info", "never"], default="never")
    a.add_argument("--baseline")
    a.add_argument("--no-color", action="store_true")
    c = commands.add_parser("compare", help="compare two corpora")
    c.add_argument("before")
    c.add_argument("after")
    c.add_argument("--format", "-f", choices=["terminal", "json"], default="terminal")
    c.add_argument("--output", "-o")
    b = commands.add_parser("baseline", parents=[common], help="store the findings of now")
    b.add_argument("paths", nargs="+")
    b.add_argument("--output", "-o", default=".textloom-baseline.json")
    r = commands.add_parser("rules", help="list the rules")
    r.add_argument("--plugin", action="append", default=[])
    r.add_argument("--format", "-f", choices=["terminal", "json"], default="terminal")
    return top


def build_config(args: argparse.Namespace) -> Config:
    config = Config.load(args.config) if args.config else Config.discover(args.paths[0])
    for name in (*_NUMBERS, "near_duplicate_threshold", "cfi_warning_threshold", "select", "ignore"):
        if (value := getattr(args, name, None)) is not None:
            setattr(config, name, value)
    config.plugins = (*config.plugins, *args.plugin)
    config.detect_secrets &= not args.no_secrets
    config.detect_pii &= not args.no_pii
    config.detect_encoding_artifacts &= not args.no_encoding
    return config


def _put(text: str, output: str | None) -> None:
    text = text if text.endswith("\n") else text + "\n"
    if output:
        Path(output).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def _missing(paths: list[str]) -> bool:
    absent = [p for p in paths if "://" not in p and not Path(p).exists()]
    for p in absent:
        print(f"error: no such file or folder: {p}", file=sys.stderr)
    return bool(absent)


def _analyze(args: argparse.Namespace) -> int:
    if _missing(args.paths):
        return 2
    known: set[str] | None = None
    if args.baseline:
        if Path(args.baseline).exists():
            known = load_baseline(args.baseline)
        else:
            print(f"note: no baseline at {args.baseline}", file=sys.stderr)
    report = analyze_paths(args.paths, build_config(args), baseline=known)
    _put(render(report, args.format, color=not args.no_color and not args.output and supports_color()), args.output)
    if report.baseline_suppressed:
        print(f"{report.baseline_suppressed} known finding(s) left out", file=sys.stderr)
    if args.format == "badge":
        print(badge_markdown(report), file=sys.stderr)
    return int(args.fail_on != "never" and report.has_at_least(Severity.from_str(args.fail_on)))


def _compare(args: argparse.Namespace) -> int:
    if _missing([args.before, args.after]):
        return 2
    before, after = analyze_path(args.before, Config()), analyze_path(args.after, Config())
    delta = compare(before, after)
    if args.format == "json":
        _put(json.dumps({"before": report_to_dict(before), "after": report_to_dict(after), "delta": delta}, indent=2, ensure_ascii=False), args.output)
    else:
        _put(render_compare(before, after, delta, color=not args.output and supports_color()), args.output)
    return 0


def _baseline(args: argparse.Namespace) -> int:
    if _missing(args.paths):
        return 2
    n = save_baseline(analyze_paths(args.paths, build_config(args)), args.output)
    print(f"{n} fingerprint(s) in {args.output}")
    return 0


def _rules(args: argparse.Namespace) -> int:
    load_all(Config(plugins=tuple(args.plugin)))
    if args.format == "json":
        _put(json.dumps([{"id": r.id, "name": r.name, "category": r.category, "severity": r.default_severity.value, "description": r.description, "recommendation": r.recommendation, "experimental": r.experimental} for r in all_rules()], indent=2), None)
    else:
        _put("\n".join(f"{r.id}  {r.default_severity.value:8} {r.name}{' (experimental)' if r.experimental else ''}: {r.description}" for r in all_rules()), None)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return {"analyze": _analyze, "compare": _compare, "baseline": _baseline, "rules": _rules}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
