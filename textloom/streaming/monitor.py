"""Corpora that arrive as streams: detectors on each row, and duplicates of content within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.detectors import encoding_counts, pii_counts, secret_labels
from textloom.functions.text import content_hash, estimate_tokens, word_count


def scanned(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with counts and what detectors find; stateless, so it runs on streams and tables alike."""
    t = F.col(text)
    return rows.withColumns({"word_count": word_count(t), "token_estimate": estimate_tokens(t), "secrets": secret_labels(t), "pii": pii_counts(t), "encoding_issues": encoding_counts(t)})


def first_seen(rows: DataFrame, time: str, text: str = "text", delay: str = "1 day") -> DataFrame:
    """Rows whose content wasn't there before within the delay; state is bounded by the watermark."""
    return rows.withColumn("content_hash", content_hash(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def token_windows(rows: DataFrame, time: str, key: str, text: str = "text", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Texts and estimated tokens by key and window of event time."""
    counted = rows.withWatermark(time, delay).groupBy(F.window(time, window), key)
    return counted.agg(F.count("*").alias("n"), F.sum(estimate_tokens(F.col(text))).alias("tokens")).select("window.start", "window.end", key, "n", "tokens")
