"""Sizes of chunks: distributions, histogram, outliers, overlap of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import hashed_shingles

BINS = 12


def size_distribution(chunks: DataFrame, column: str = "char_count") -> DataFrame:
    """min, max, mean, median, p95, stdev of the population: one row, unrounded; null statistics without chunks."""
    c = F.col(column)
    return chunks.agg(
        F.count("*").alias("n"), F.min(c).cast("long").alias("min"), F.max(c).cast("long").alias("max"), F.avg(c).alias("mean"),
        F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.95)).alias("p95"), F.stddev_pop(c).alias("stdev"),
    )


def size_histogram(chunks: DataFrame, column: str = "char_count", bins: int = BINS) -> DataFrame:
    """bin, lo, hi, n for bins of equal width; one bin if all sizes are equal; none without chunks."""
    ends = chunks.agg(F.min(column).cast("long").alias("lo"), F.max(column).cast("long").alias("hi")).where("lo is not null")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    counted = chunks.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(ends))  # ends: one row
    binned = counted.select(F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.when(width > 0, F.lit(bins - 1)).otherwise(F.lit(0)))).alias("bin"))
    edge = lambda i: F.when(width > 0, F.bround(F.col("lo") + i * width, 0)).otherwise(F.col("lo") * 1.0).cast("long")
    top = F.when(width > 0, edge(F.col("bin") + 1)).otherwise(F.col("hi"))
    return frame.join(F.broadcast(binned), "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), top.alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def oversized(limit: int) -> Column:
    return F.col("char_count") > limit


def undersized(limit: int) -> Column:
    return (F.col("char_count") > 0) & (F.col("char_count") < limit)


def over_tokens(limit: int) -> Column:
    return F.col("token_estimate") > limit


def neighbour_overlap(chunks: DataFrame, size: int = 5) -> DataFrame:
    """doc_key, doc_index, ratio: share of a chunk's shingles that the chunk before has; chunks without shingles are left out."""
    w = W.partitionBy("doc_key").orderBy("doc_index")
    marked = chunks.select("doc_key", "doc_index", hashed_shingles(F.col("text"), size).alias("s"))
    pairs = marked.select("doc_key", "doc_index", "s", F.lag("s").over(w).alias("before")).where("before is not null and size(s) > 0")
    return pairs.select("doc_key", "doc_index", (F.size(F.array_intersect("s", "before")) / F.size("s")).alias("ratio"))


def overlap_pct(chunks: DataFrame, size: int = 5) -> DataFrame:
    return neighbour_overlap(chunks, size).agg((100.0 * F.coalesce(F.avg("ratio"), F.lit(0.0))).alias("overlap_pct"))
