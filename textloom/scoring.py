"""The health score: 100 that decays with the weights of the findings."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed import GRADES, SCORE_DECAY, SEVERITY_WEIGHTS
from textloom.models import Finding, HealthScore


def grade(score: int) -> HealthScore:
    return next(HealthScore(score, g, label) for least, g, label in GRADES if score >= least)


def compute_health(findings: Iterable[Finding]) -> HealthScore:
    return grade(round(100 * math.exp(-sum(SEVERITY_WEIGHTS[f.severity.value] for f in findings) / SCORE_DECAY)))


def health(findings: DataFrame) -> DataFrame:
    """score, grade, label of a findings table, as one row."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in SEVERITY_WEIGHTS.items()])
    score = F.bround(100 * F.exp(-F.coalesce(F.sum(weight), F.lit(0.0)) / SCORE_DECAY), 0).cast("int")

    def pick(at: int) -> Column:
        return F.coalesce(*[F.when(F.col("score") >= g[0], F.lit(g[at])) for g in GRADES])

    return findings.agg(score.alias("score")).select("score", pick(1).alias("grade"), pick(2).alias("label"))
