"""What detectors find in chunks: one row for each chunk and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.detectors import encoding_counts, pii_counts, placeholder_terms, secret_labels

_KEYS = ("doc_key", "index", "chunk_id", "source_file", "start_line")


def _rows(chunks: DataFrame, kinds: Column) -> DataFrame:
    keys = [c for c in _KEYS if c in chunks.columns]
    found = chunks.select(*keys, F.posexplode_outer(kinds).alias("ord", "x")).where("x is not null")  # outer: else Catalyst works kinds out again for a filter
    return found.select(*keys, "ord", "x.kind", "x.n")


def secrets(chunks: DataFrame) -> DataFrame:
    labels = F.transform(secret_labels(F.col("text")), lambda k: F.struct(k.alias("kind"), F.lit(1).alias("n")))
    return _rows(chunks, labels)


def pii(chunks: DataFrame) -> DataFrame:
    return _rows(chunks, pii_counts(F.col("text")))


def encoding_issues(chunks: DataFrame) -> DataFrame:
    return _rows(chunks, encoding_counts(F.col("text")))


def placeholders(chunks: DataFrame) -> DataFrame:
    found = placeholder_terms(F.col("text"))
    return chunks.select(*[c for c in _KEYS if c in chunks.columns], F.size(found).alias("n")).where("n > 0")


def by_kind(found: DataFrame) -> DataFrame:
    """kind, total, chunks."""
    return found.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("chunks"))
