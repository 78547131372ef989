"""DataFrames and lists as corpora."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.chunking import given_chunks, indexed, numbered
from textloom.sources.formats import chunk_text, disabled_rules, json_texts, jsonl_texts


def documents_frame(rows: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "text", path: str | None = None) -> DataFrame:
    """A table of texts as documents that are still to be chunked; null texts become empty."""
    name = F.col(path) if path else F.concat(F.lit("doc-"), F.col(key).cast("string"))
    return rows.select(F.col(key).cast("long").alias("doc_key"), name.alias("path"), F.lit(kind).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("raw"), F.lit(False).alias("pre_chunked"), F.array().cast("array<string>").alias("disabled_rules"))


def chunks_frame(rows: DataFrame, key: str, order: str, text: str = "text", name: str = "chunks") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a table whose rows are chunks: a document for each key, its chunks in the order given.

    Keys of any type that can be ordered; those that are no whole numbers are numbered in their order. Rows without a key
    are one document, those without a text are left out.
    """
    picked = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.concat(F.lit(f"{name}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("source_file"), F.col(order).alias("__o"), F.col(text).alias("text"))
    if isinstance(rows.schema[key].dataType, T.IntegralType):
        picked = picked.withColumn("doc_key", F.col("__k").cast("long"))
    else:
        firsts = numbered(picked.select("__k").distinct().withColumn("n", F.lit(1).cast("long")), "__k").select(F.col("__k").alias("__key"), F.col("first").alias("doc_key"))
        picked = picked.join(firsts, F.col("__k").eqNullSafe(F.col("__key")))
    numbers = F.row_number().over(W.partitionBy("doc_key").orderBy("__o", "text")) - 1
    chunks = picked.select("doc_key", "source_file", numbers.cast("int").alias("doc_index"), "text")
    documents = picked.select("doc_key", F.col("source_file").alias("path")).distinct().select("doc_key", "path", F.lit("chunks").alias("kind"), F.lit("").alias("raw"), F.lit(True).alias("pre_chunked"), F.array().cast("array<string>").alias("disabled_rules"))
    return documents, indexed(given_chunks(chunks))


def chunk_list(spark: SparkSession, items: Iterable[object], source: str = "chunks") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of strings and objects with a text; other items are dropped."""
    texts = [t for t in map(chunk_text, items) if t is not None]
    rows = spark.createDataFrame([(0, source, i, t) for i, t in enumerate(texts)], "doc_key long, source_file string, doc_index int, text string")
    documents = spark.createDataFrame([(0, source, "chunks", "\n\n".join(texts), True, [])], "doc_key long, path string, kind string, raw string, pre_chunked boolean, disabled_rules array<string>")
    return documents, indexed(given_chunks(rows))


def pasted(text: str) -> list[str]:
    """Chunks of a pasted text: a JSON document, JSON lines with other lines kept as they are, or blocks between blank lines."""
    import json
    import re

    bare = text.strip()
    if bare[:1] in "[{" and bare:
        try:
            return json_texts(json.loads(bare))
        except ValueError:
            pass
        if bare[0] == "{":
            return [t for line in bare.splitlines() if line.strip() for t in (jsonl_texts(line) or [line.strip()])]
    return [b.strip() for b in re.split(r"\n\s*\n", bare) if b.strip()]


__all__ = ["chunk_list", "chunks_frame", "disabled_rules", "documents_frame", "pasted"]
