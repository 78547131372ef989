"""Sections of markdown documents and the chunks that begin in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import WS, strip

_BREAK_CHARS = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
_LINES = rf"([^{_BREAK_CHARS}]*(?:\r\n|[{_BREAK_CHARS}])|[^{_BREAK_CHARS}]+)"
_HEADING = rf"(?d)\A(#{{1,6}})[{WS}]+(.*[^{WS}])[{WS}]*\z"


def headings(documents: DataFrame) -> DataFrame:
    """doc_key, ord, offset, until, level, title: headings outside fences, and where the next one or the text ends."""
    picked = documents.where("kind = 'markdown' and not pre_chunked").select("doc_key", F.length("raw").alias("size"), F.posexplode_outer(F.regexp_extract_all("raw", F.lit(_LINES), F.lit(1))).alias("n", "line")).where("line is not null")
    before = W.partitionBy("doc_key").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    fence = strip(F.col("line")).rlike(r"\A(?:`{3}|~{3})")
    placed = picked.select("doc_key", "size", "n", "line", fence.alias("fence"), F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("int").alias("offset"), (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2).alias("inside"))
    bare = F.regexp_replace("line", r"\n+\z", "")
    found = placed.where(~F.col("fence") & (F.col("inside") == 0) & bare.rlike(_HEADING)).select(
        "doc_key", "size", "n", "offset", F.length(F.regexp_extract(bare, _HEADING, 1)).alias("level"), strip(F.regexp_extract(bare, _HEADING, 2)).alias("title")
    )
    order = W.partitionBy("doc_key").orderBy("offset")
    return found.select("doc_key", F.row_number().over(order).alias("ord"), "offset", F.lead("offset").over(order).alias("next"), "size", "level", "title").select("doc_key", "ord", "offset", F.coalesce("next", F.col("size") + 1).alias("until"), "level", "title")


def sections(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_key, ord, offset, level, title, span, first_chunk, first_line, first_index: one row a heading, spans of 0 included.

    A chunk belongs to the last heading at or before its start: an as-of assignment by one window over both.
    """
    heads = headings(documents)
    none = F.lit(None)
    marks = heads.select("doc_key", F.col("offset").alias("at"), F.lit(0).alias("kind"), "ord", none.cast("string").alias("chunk_id"), none.cast("int").alias("line"), none.cast("long").alias("index"))
    own = chunks.where("char_start is not null").join(heads.select("doc_key").distinct(), "doc_key", "left_semi")
    starts = own.select("doc_key", F.col("char_start").alias("at"), F.lit(1).alias("kind"), none.cast("int").alias("ord"), "chunk_id", F.col("start_line").alias("line"), "index")
    w = W.partitionBy("doc_key").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    assigned = marks.unionByName(starts).select("*", F.last("ord", ignorenulls=True).over(w).alias("section")).where("kind = 1 and section is not null")
    spans = assigned.groupBy("doc_key", F.col("section").alias("ord")).agg(F.count("*").alias("span"), F.min(F.struct("index", "chunk_id", "line")).alias("f"))
    return heads.join(spans, ["doc_key", "ord"], "left").select("doc_key", "ord", "offset", "level", "title", F.coalesce("span", F.lit(0)).alias("span"), F.col("f.chunk_id").alias("first_chunk"), F.col("f.line").alias("first_line"), F.col("f.index").alias("first_index"))
