"""Tables that go on over the border of two chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.tables import edges


def broken_boundaries(chunks: DataFrame) -> DataFrame:
    """One row for each border inside a document at which a table is cut: both chunks, and the second's index if chunks have it."""
    w = W.partitionBy("doc_key").orderBy("doc_index")
    index = ["index"] if "index" in chunks.columns else []
    marked = chunks.select("doc_key", "doc_index", *index, "source_file", "chunk_id", "start_line", "end_line", edges(F.col("text")).alias("e"))
    both = marked.select("*", F.lag("e.ends").over(w).alias("open"), F.lag("chunk_id").over(w).alias("before_id"), F.lag("end_line").over(w).alias("before_line"))
    broken = F.col("open").isNotNull() & ((F.col("open") & F.col("e.first_row")) | F.col("e.starts"))
    return both.where(broken).select("doc_key", "doc_index", *index, "source_file", "before_id", "before_line", "chunk_id", "start_line")
