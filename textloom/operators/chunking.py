"""Structure-aware chunks of documents, and their dense numbering over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import WS, estimate_tokens, let, word_count
from textloom.session import cut, ship

_NAMES = ("text", "char_start", "char_end", "overlap_chars", "start_line", "end_line")
_PIECES = "array<struct<text:string,char_start:int,char_end:int,overlap_chars:int,start_line:int,end_line:int>>"
_FENCES = ("`" * 3, "~" * 3)


def blocks(text: str, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of runs of lines that aren't blank; blank lines in a fence don't end one. Longer ones are cut to limit."""
    at, begin, end, fenced = 0, -1, 0, False
    for line in [*text.split("\n"), None]:
        blank = line is None or not line.strip()
        if begin >= 0 and blank and (line is None or not fenced):
            for a in range(begin, end, limit):
                yield a, min(a + limit, end)
            begin = -1
        if line is None:
            return
        if not blank or (fenced and at < len(text)):
            begin = at if begin < 0 else begin
            end = at + len(line)
            if line.lstrip().startswith(_FENCES):
                fenced = not fenced
        at += len(line) + 1


def pieces(text: str, size: int, overlap: int) -> list[tuple[str, int, int, int]]:
    """Blocks packed greedily while their own length fits; each piece begins with the end of the one before."""
    spans: list[list[int]] = []
    for a, b in blocks(text, size):
        if spans and spans[-1][1] - spans[-1][0] + b - a <= size:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out, before = [], ""
    for a, b in spans:
        own = text[a:b]
        head = before[-overlap:] + "\n" if overlap and before else ""
        out.append((head + own, a, b, len(head)))
        before = own
    return out


def plain(text: Column) -> Column:
    """Whether the text is one block: no blank line and no fence."""
    ends = rf"[{WS}&&[^\n]]*(?:\n|`{{3}}|~{{3}}|\z)"
    return ~text.rlike(rf"\A{ends}") & ~(F.contains(text, F.lit("\n")) & text.rlike(rf"\n{ends}"))


def lined(text: str, cut: list[tuple[str, int, int, int]]) -> Iterator[tuple]:
    """pieces() with the lines in which they begin and end, in one pass over the text."""
    line, at = 1, 0
    for own, a, b, head in cut:
        line, at = line + text.count("\n", at, a), a
        yield own, a, b, head, line, line + text.count("\n", a, b - 1)


def plain_pieces(text: Column, size: int, overlap: int) -> Column:
    """Pieces of a text that is one block: slices of size characters, with the end of the slice before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    slices = F.transform(starts, lambda a: F.substr(text, a + 1, F.lit(size)))

    def breaks(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def cut(own: Column) -> Column:
        counts = F.transform(own, breaks)

        def piece(k: Column, lines: Column) -> Column:
            part, a = F.get(own, k), k * size
            before = F.get(own, k - 1)
            head = F.when((k > 0) & F.lit(overlap > 0), F.concat(F.right(before, F.lit(min(overlap, size))), F.lit("\n"))).otherwise(F.lit(""))
            first = 1 + F.aggregate(F.slice(lines, F.lit(1), k), F.lit(0), lambda s, x: s + x)
            last = first + F.get(lines, k) - F.endswith(part, F.lit("\n")).cast("int")
            return F.struct(F.concat(head, part).alias("text"), a.alias("char_start"), (a + F.length(part)).alias("char_end"), F.length(head).alias("overlap_chars"), first.alias("start_line"), last.alias("end_line"))

        return let(counts, lambda lines: F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: piece(k, lines)))

    return let(slices, cut).cast(_PIECES)


def chunk_pieces(text: Column, chunk_size: int = 1200, chunk_overlap: int = 120) -> Column:
    """array<struct<text, char_start, char_end, overlap_chars, start_line, end_line>> of a text.

    Texts of one block are sliced by expressions. Packing several blocks is a fold over lines, done for those texts only
    by an Arrow UDF, in time linear in the text.
    """
    size, overlap = max(1, chunk_size), max(0, chunk_overlap)

    @F.pandas_udf(_PIECES)
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(_NAMES, p)) for p in lined(t, pieces(t, size, overlap))] for t in texts])

    simple = plain(text)
    return F.when(simple, plain_pieces(text, size, overlap)).otherwise(packed(F.when(~simple, text)))


def measured(chunks: DataFrame) -> DataFrame:
    text = F.col("text")
    return chunks.withColumns({"char_count": F.length(text).cast("int"), "word_count": word_count(text), "token_estimate": estimate_tokens(text)})


def chunk_documents(documents: DataFrame, chunk_size: int = 1200, chunk_overlap: int = 120) -> DataFrame:
    """Chunks of documents (doc_key, path, raw), without their corpus index. Null texts give none."""
    ship(documents.sparkSession)
    cut = documents.select("doc_key", F.col("path").alias("source_file"), chunk_pieces(F.coalesce("raw", F.lit("")), chunk_size, chunk_overlap).alias("p"))
    rows = cut.select("doc_key", "source_file", F.posexplode_outer("p").alias("doc_index", "x")).where("x is not null")  # outer: else Catalyst works p out again for a filter
    ids = F.concat_ws("#", "source_file", F.col("doc_index").cast("string"))
    return measured(rows.select(ids.alias("chunk_id"), "doc_key", "source_file", "doc_index", "x.text", "x.char_start", "x.char_end", "x.start_line", "x.end_line"))


def given_chunks(rows: DataFrame) -> DataFrame:
    """Chunks that are given as such: doc_key, source_file, doc_index, text; no places in a document."""
    none = F.lit(None).cast("int")
    ids = F.concat_ws("#", "source_file", F.col("doc_index").cast("string"))
    return measured(rows.select(ids.alias("chunk_id"), "doc_key", "source_file", "doc_index", "text", none.alias("char_start"), none.alias("char_end"), none.alias("start_line"), none.alias("end_line")))


def piece_count(text: Column, chunk_size: int = 1200, chunk_overlap: int = 120) -> Column:
    """How many pieces chunk_pieces() gives, without their texts where one block is all there is."""
    size = max(1, chunk_size)
    simple = plain(text)
    others = F.size(chunk_pieces(F.when(~simple, text).otherwise(F.lit("")), chunk_size, chunk_overlap))
    return F.when(simple, F.ceil(F.length(text) / size)).otherwise(others).cast("long")


def piece_counts(documents: DataFrame, chunk_size: int = 1200, chunk_overlap: int = 120) -> DataFrame:
    """doc_key, n: chunks of each key, for indexed(). Documents with a column texts that isn't null have one for each."""
    n = piece_count(F.coalesce("raw", F.lit("")), chunk_size, chunk_overlap)
    if "texts" in documents.columns:
        n = F.when(F.col("pre_chunked"), F.size("texts").cast("long")).otherwise(n)
    return documents.select("doc_key", n.alias("n")).groupBy("doc_key").agg(F.sum("n").alias("n")).where("n > 0")


def numbered(sizes: DataFrame, key: str) -> DataFrame:
    """key, first: the sum of n over all smaller keys. sizes: key, n, a row for each key.

    Keys are dealt by ranges and stored; sums by partition are summed up in one small window, those within a partition in
    windows of their own.
    """
    dealt = cut(sizes.repartitionByRange(key).select(key, "n", F.spark_partition_id().alias("part")))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row a partition
    base = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(base, "part").select(key, (F.col("base") + before).alias("first"))


def indexed(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """rows with index: 0, 1, 2 ... in order of doc_key and doc_index.

    rows: one for each chunk, of any columns beside these two; the fewer and smaller they are, the less is shuffled.
    counts: doc_key, n, where they are known for less than the rows. Nothing goes to the driver. Chunks without a key are
    those of one document, the first; documents that repeat a key are one, with their chunks in order of doc_index and
    then of a hash of the row.
    """
    counts = rows.groupBy("doc_key").agg(F.count("*").alias("n")) if counts is None else counts
    firsts = numbered(counts, "doc_key").withColumnRenamed("doc_key", "__key")
    place = F.row_number().over(W.partitionBy("doc_key").orderBy("doc_index", F.xxhash64(*rows.columns))) - 1
    return rows.join(firsts, F.col("doc_key").eqNullSafe(F.col("__key"))).withColumn("index", F.col("first") + place).drop("first", "__key")
