"""How far apart the chunks are that speak of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.entities import entity_set


def occurrences(chunks: DataFrame) -> DataFrame:
    """entity, index: distinct. chunks: with index and text, or with index and entities."""
    entities = F.col("entities") if "entities" in chunks.columns else entity_set(F.col("text"))
    return chunks.select("index", F.explode_outer(entities).alias("entity")).where("entity is not null")  # outer: else Catalyst works them out again for a filter


def entity_fragmentation(chunks: DataFrame, min_freq: int = 2, total: int | None = None) -> DataFrame:
    """entity, chunks, fragmentation of the entities in at least min_freq chunks.

    The mean gap between positions telescopes to (last - first) / (count - 1), so sums by entity are enough. An entity
    with one position has fragmentation 0. total: chunks of the corpus, counted if not given.
    """
    n = chunks.count() if total is None else total
    found = occurrences(chunks).groupBy("entity").agg(F.count("*").alias("chunks"), F.min("index").alias("lo"), F.max("index").alias("hi")).where(F.col("chunks") >= min_freq)
    gap = (F.col("hi") - F.col("lo")) / F.greatest(F.col("chunks") - 1, F.lit(1))
    frag = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (gap - 1.0) / float(max(1, n - 1))))
    return found.select("entity", "chunks", frag.alias("fragmentation"))


def fragmentation_index(entities: DataFrame) -> DataFrame:
    """cfi (weighted by chunks, unrounded; 0 without entities), repeated: one row."""
    weight = F.sum("chunks")
    return entities.agg(F.coalesce(F.sum(F.col("fragmentation") * F.col("chunks")) / weight, F.lit(0.0)).alias("cfi"), F.count("*").alias("repeated"))


def top_entities(entities: DataFrame, k: int = 8) -> DataFrame:
    return entities.orderBy(F.desc("fragmentation"), F.desc("chunks"), "entity").limit(k)
