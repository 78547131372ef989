"""What happens to findings after analysis: directives in files, rule settings, a stored baseline."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.models import Severity

ALL = "*"


def apply_pragmas(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Locations in files that disable the rule go; findings all of whose locations go, go too; others stay as they are."""
    off = documents.where(F.size("disabled_rules") > 0).select(F.col("path").alias("file"), F.explode("disabled_rules").alias("rule")).distinct()
    numbered = findings.withColumn("__f", F.struct("analyzer_seq", "emit", "rule_id"))
    placed = numbered.select("__f", "rule_id", F.posexplode("locations").alias("at", "x")).withColumn("file", F.col("x.file"))
    silenced = placed.join(off, "file").where((F.col("rule") == F.col("rule_id")) | (F.col("rule") == ALL)).select("__f", "at").distinct()
    gone = silenced.groupBy("__f").agg(F.collect_set("at").alias("gone"))
    kept = F.filter("locations", lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    left = numbered.join(gone, "__f", "left").withColumn("__kept", kept)
    return left.where((F.size("locations") == 0) | (F.size("__kept") > 0)).withColumn("locations", F.col("__kept")).select(*findings.columns)


def apply_rule_config(findings: DataFrame, config: Config) -> DataFrame:
    """Rules selected, if any are, less the ignored ones; severities as overridden."""
    overrides = {k: Severity.from_str(v).value for k, v in (config.severity or {}).items()}
    if config.select:
        findings = findings.where(F.col("rule_id").isin(*config.select))
    if config.ignore:
        findings = findings.where(~F.col("rule_id").isin(*config.ignore))
    for rule_id, severity in overrides.items():
        findings = findings.withColumn("severity", F.when(F.col("rule_id") == rule_id, F.lit(severity)).otherwise(F.col("severity")))
    return findings


def fingerprint(rule_id: str = "rule_id", locations: str = "locations") -> Column:
    """First 16 hex digits of the SHA-1 of the rule and its sorted files."""
    files = F.array_join(F.array_sort(F.array_distinct(F.transform(locations, lambda x: x["file"]))), "|")
    return F.substring(F.sha1(F.concat(F.col(rule_id), F.lit("|"), files).cast("binary")), 1, 16)


def drop_baseline(findings: DataFrame, known: Iterable[str]) -> DataFrame:
    """Findings whose fingerprints aren't among the known ones."""
    table = findings.sparkSession.createDataFrame([(k,) for k in sorted(set(known))], "fingerprint string")
    return findings.withColumn("fingerprint", fingerprint()).join(table, "fingerprint", "left_anti").select(*findings.columns)


def rank(severity: str = "severity") -> Column:
    return F.coalesce(*[F.when(F.col(severity) == s.value, F.lit(s.rank)) for s in Severity])


def ordered(findings: DataFrame) -> DataFrame:
    """Gravest first, then by rule, then as analyzers gave them."""
    return findings.orderBy(F.desc(rank()), "rule_id", "analyzer_seq", "emit")


def positioned(findings: DataFrame) -> DataFrame:
    """findings with position long: 1, 2, 3 ... in the order of ordered(); for findings of one report."""
    from pyspark.sql import Window

    return findings.withColumn("position", F.row_number().over(Window.orderBy(F.desc(rank()), "rule_id", "analyzer_seq", "emit")).cast("long"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n: one row for each severity, zeros included."""
    names = findings.sparkSession.createDataFrame([(s.value,) for s in Severity], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return names.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
