"""What the operators of this subpackage share: word patterns, row keys, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a word or a line's margin; a Java character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Stands for a null doc_id in keys; it sorts before every id in use.
NULL_ID = -(1 << 63)
FLUSH_BYTES = 4 << 20


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_ids(docs: DataFrame, column: str) -> DataFrame:
    """docs, if this column has whole numbers: ids are compared, and the smallest or largest decides."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"ids have to be whole numbers; {column} is of type {kind.simpleString()}")
    return docs


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __th, __text): ids without null, a hash of the text that tells rows of one id apart, text without null.

    Rows that repeat both id and text share their key, so a join on it gives each of them the same result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return whole_ids(docs, id_col).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))


def public_id(column: str = "__id") -> Column:
    """Undo keyed(): the null id is null again."""
    return F.when(F.col(column) != F.lit(NULL_ID), F.col(column)).alias("doc_id")


#: A key with more than a HOT_SHARE-th of the rows is hot; so there are fewer than HOT_SHARE hot keys. Its rows go to SLICES places.
HOT_SHARE, SLICES = 256, 64


def hot_keys(rows: DataFrame, key: str) -> list:
    """The values that more than one row in HOT_SHARE has: fewer than HOT_SHARE of them, whatever rows holds."""
    least = rows.count() / HOT_SHARE
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key).collect()]


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", also: tuple[str, ...] = ()) -> DataFrame:
    """rows joined with table on key, and on the columns also. Rows of a hot key are dealt to SLICES places, and the table's rows for it repeated there.

    rows are read for their hot keys first, so they have to be cheap to read twice, and the same each time: stored rows, or
    what is made of them row by row. Rows of a hot key are dealt by where they are stored, as they can be equal.
    """
    hot = F.col(key).isin(hot_keys(rows, key))
    slot = F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SLICES))).otherwise(F.lit(0).cast("long"))
    slots = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return rows.withColumn("__slot", slot).join(table.withColumn("__slot", F.explode(slots)), [key, *also, "__slot"], how).drop("__slot")


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], name: str, limit: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of the named string column, so that long texts bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        if column.nbytes <= limit:
            yield batch
            continue
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def dealt_labels(width: int) -> np.ndarray:
    """One number for each of width partitions, which Spark's hash partitioning (Murmur3, seed 42) deals there.

    Groups that are named so fill each partition of repartition(width, name) with one group. Only balance depends on it.
    """
    out, left, at = np.full(width, -1, np.int64), width, 0
    while left:
        tried = np.arange(at, at + 4 * width, dtype=np.int64)
        parts, first = np.unique(murmur3(tried).astype(np.int64) % width, return_index=True)
        new = out[parts] < 0
        out[parts[new]] = tried[first[new]]
        left, at = left - int(new.sum()), at + 4 * width
    return out


def murmur3(numbers: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of a long column."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    h = np.full(len(numbers), seed, np.uint32)
    for half in (numbers & 0xFFFFFFFF, numbers >> 32):
        h ^= turned(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, multiplier in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(multiplier)
    return h.astype(np.int32)
