"""Connected components of links between integer vertices, by contraction.

Each round, every vertex moves to the smallest of its neighbours and itself, moves on twice along the same map, and the
links are drawn anew between where they moved. At least half of the vertices that still have links go each round, so
rounds grow with the logarithm of the largest component. A round is lookups by key and a minimum by key: no vertex's
neighbours are gathered. Where one vertex is looked up by many others, the centre of a star or the name of a giant
component, its rows are dealt to several places. Each round's map is cut by a checkpoint in the shared folder.

Defined results: links without vertices give nothing; links of a vertex to itself and repeated links count for nothing;
links with a null end are no links. A vertex without links is its own component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import spread_join
from textloom.session import cut


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mapped(rows: DataFrame, column: str, m: DataFrame) -> DataFrame:
    """rows with what m (v, to) has for this column, or the column itself where m has nothing."""
    on = m.select(F.col("v").alias(column), F.col("to").alias("__to"))
    return spread_join(rows, on, column).withColumn(column, F.coalesce("__to", column)).select(*rows.columns)


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each reaches. vertices: column v; links: columns a and b, of those vertices."""
    e = cut(_links(links.select("a", "b")))
    label = vertices.select("v", F.col("v").alias("component"))
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("w")))
        m = cut(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")))
        for _ in range(2):
            m = cut(_mapped(m, "to", m))  # twice as far along the map
        e = cut(_links(_mapped(cut(_mapped(e, "a", m)), "b", m)))
        label = cut(_mapped(label, "component", m))
    return label
