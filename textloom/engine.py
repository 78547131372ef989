"""From sources to a report."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from textloom.config import Config
from textloom.models import Finding, HealthScore, Location, Report, Severity
from textloom.plans import postfilter
from textloom.plans.analyzers import DEFAULT_ANALYZERS, CorpusContext, findings_table
from textloom.scoring import health
from textloom.session import cut
from textloom.sources import files, frames


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("textloom").getOrCreate()


def to_findings(table: DataFrame) -> list[Finding]:
    rows = postfilter.ordered(table).collect()
    return [Finding(r.rule_id, Severity(r.severity), r.message, r.recommendation, [Location(x.file, x.chunk_id, x.line, x.detail) for x in r.locations], r.experimental, json.loads(r.data)) for r in rows]


@dataclass
class Analysis:
    """What was found, as tables: a finding for each cut table and each long section can be many.

    findings: columns of models.FINDINGS, after directives, rule settings and baseline, stored in the shared folder.
    """

    root: str
    documents: DataFrame
    findings: DataFrame
    metrics: dict
    config: Config
    n_documents: int
    n_chunks: int
    suppressed: int = 0

    def health(self) -> HealthScore:
        """Worked out where the findings are."""
        return HealthScore(*health(self.findings).first())

    def report(self) -> Report:
        """With all findings in it, on the driver: a report lists them."""
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return Report(self.root, now, self.n_documents, self.n_chunks, self.health(), self.suppressed, to_findings(self.findings), self.metrics, self.config.to_dict())


def analyze_corpus(root: str, documents: DataFrame, chunks: DataFrame, config: Config, baseline: set[str] | None = None) -> Analysis:
    """Analyse a corpus: analyzers, directives, rule settings, baseline. Nothing of it but counts and listed places goes to the driver."""
    from textloom.plugins import load_all

    ctx = CorpusContext(documents.sparkSession, documents, cut(chunks), config)
    analyzers = [cls() for cls in (*DEFAULT_ANALYZERS, *load_all(config))]
    outputs = [a.analyze(ctx) for a in analyzers]
    table = cut(postfilter.apply_rule_config(postfilter.apply_pragmas(findings_table(ctx, outputs), documents), config))
    known = postfilter.drop_baseline(table, baseline) if baseline else table
    suppressed = table.count() - known.count() if baseline else 0
    metrics = {a.name: o.metrics for a, o in zip(analyzers, outputs)}
    return Analysis(root, documents, known, metrics, config, documents.count(), ctx.n_chunks(), suppressed)


def assemble(root: str, documents: DataFrame, chunks: DataFrame, config: Config, baseline: set[str] | None = None) -> Report:
    return analyze_corpus(root, documents, chunks, config, baseline).report()


def analyze_paths(paths: Iterable[str | Path], config: Config | None = None, *, baseline: set[str] | None = None, spark: SparkSession | None = None) -> Report:
    """Files and folders as one corpus."""
    paths, config, spark = list(paths), config or Config(), spark or session()
    documents, chunks = files.load(spark, paths, config)
    root = str(paths[0]) if len(paths) == 1 else f"{len(paths)} paths"
    return assemble(root, documents, chunks, config, baseline)


def analyze_path(path: str | Path, config: Config | None = None, *, baseline: set[str] | None = None, spark: SparkSession | None = None) -> Report:
    return analyze_paths([path], config, baseline=baseline, spark=spark)


def analyze_chunks(chunks: Iterable[object] | DataFrame, config: Config | None = None, *, source: str = "chunks", text_col: str = "text", doc_col: str | None = None, order_col: str | None = None, spark: SparkSession | None = None) -> Report:
    """A list of strings and objects, or a DataFrame whose rows are chunks of the documents in doc_col, in order_col's order."""
    config, spark = config or Config(), spark or session()
    if isinstance(chunks, DataFrame):
        from pyspark.sql import functions as F

        rows = chunks.withColumn("__doc", F.col(doc_col) if doc_col else F.lit(0)).withColumn("__order", F.col(order_col) if order_col else F.monotonically_increasing_id())
        documents, own = frames.chunks_frame(rows, "__doc", "__order", text_col, source)
    else:
        documents, own = frames.chunk_list(spark, chunks, source)
    return assemble(source, documents, own, config)


def worst_severity(report: Report) -> Severity | None:
    return report.worst()


def compare(before: Report, after: Report) -> dict:
    """How the second report differs from the first."""
    pick = lambda r, a, m: r.metrics.get(a, {}).get(m, 0) or 0
    return {
        "health": after.health_score - before.health_score,
        "findings": len(after.findings) - len(before.findings),
        "duplicate_pct": round(pick(after, "duplicates", "duplicate_pct") - pick(before, "duplicates", "duplicate_pct"), 2),
        "cfi": round(pick(after, "fragmentation", "cfi") - pick(before, "fragmentation", "cfi"), 3),
    }
