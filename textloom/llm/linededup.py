"""Line dedup by range-partitioned hashes with a secondary sort.

A line's key is the line without margins of ASCII white space, A-Z lower-cased. Keys of at least `min_chars` code points
that at least `min_docs` documents hold lose all their lines, except in the document with the largest id that has it.

Each line with a key gives one row: 128-bit hash, id, place. Rows are partitioned by ranges of (hash, id) and sorted by
hash, then by id from the largest, then by place: the first document in the stream of a key is the one that keeps it. As
the id is part of the range, a key that a third of all documents hold spreads over as many partitions as its rows need.
A key inside a partition is decided there. The first and the last key of a partition may go on in others: their rows are
left open, summed up by (partition, key), merged by key over the partitions that it reaches, and decided by a join on
(partition, key), which no hot key can swell. Nothing goes to the driver but the number of rows. The dropped places are
gathered into a compressed bitmap of kept lines a document; text doesn't move with them.

Defined results: a null or empty text is one empty line. Rows that repeat an id count as one document; repeated rows
lose the same lines. A null id counts as one document, the smallest. Very long texts and lines are hashed whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_LOWER, NULL_ID, SPACE_CHARS, keyed, pieces, public_id, texts
from textloom.session import cut, ship, width_for

MIN_CHARS, MIN_DOCS = 20, 3
#: Rows of a range.
RANGE_ROWS = 1 << 18
_COLUMNS = ("h1", "h2", "id", "th", "n_lines", "place")
_ROW = "h1 long, h2 long, id long, th long, n_lines int, place int"


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, id, th, n_lines, place: one row for each line of keyed() rows that has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            keys, ids, ths, counts, places = [], [], [], [], []
            for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "__text")):
                lines = text.split("\n")
                stripped = [line.strip(SPACE_CHARS) for line in lines]
                own = [at for at, line in enumerate(stripped) if len(line) >= min_chars]
                keys += [hashlib.blake2b(stripped[at].translate(ASCII_LOWER).encode("utf-8", "surrogatepass"), digest_size=16).digest() for at in own]
                ids += [i] * len(own)
                ths += [th] * len(own)
                counts += [len(lines)] * len(own)
                places += own
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((h[:, 0], h[:, 1], ids, ths, counts, places), kinds)], names=_COLUMNS)

    return docs.mapInArrow(run, _ROW)


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    """Where each key begins in sorted rows."""
    h1, h2 = rows[:2]
    return np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(h1)])


def _stream(min_docs: int):
    """Of a sorted partition: the rows that go, and, marked open, the rows of its first and its last key."""

    def key(rows: list[np.ndarray], at: int) -> tuple[int, int]:
        return int(rows[0][at]), int(rows[1][at])

    def given(rows: list[np.ndarray], chosen: np.ndarray | slice, is_open: bool, before: tuple | None = None) -> pa.RecordBatch:
        """before: the key and id of the open row before these. new: whether a row is the first of its document under the key here."""
        from pyspark import TaskContext

        own = [x[chosen] for x in rows]
        n = len(own[0])
        new = np.ones(n, bool)
        if n and is_open:
            new[1:] = np.any([x[1:] != x[:-1] for x in own[:3]], axis=0)
            new[0] = before != (*key(own, 0), int(own[2][0]))
        part = np.full(n, TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, is_open), new, part, *own)], names=["open", "new", "part", *_COLUMNS])

    def goes(rows: list[np.ndarray]) -> np.ndarray:
        """Rows of whole keys."""
        starts, ids = _starts(rows), rows[2]
        run = np.zeros(len(ids), np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        new = np.r_[True, (run[1:] != run[:-1]) | (ids[1:] != ids[:-1])]
        docs = np.add.reduceat(new.astype(np.int64), starts)
        return (docs[run] >= min_docs) & (ids != ids[starts][run])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[int, int] | None = None
        held: list[list[np.ndarray]] = []  # rows of the last key so far, which may go on
        before: tuple | None = None

        def left_open(rows: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal before
            out = given(rows, slice(None), True, before)
            before = (*key(rows, -1), int(rows[2][-1]))
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(len(_COLUMNS))]
            first = first or key(rows, 0)
            if held and key(rows, -1) == key(held[0], 0):
                held.append(rows)
                continue
            if held:
                rows = [np.concatenate(x) for x in zip(*held, rows)]
            starts = _starts(rows)
            begin = int(starts[1]) if key(rows, 0) == first and len(starts) > 1 else 0
            last = int(starts[-1])
            if begin:
                yield left_open([x[:begin] for x in rows])
            if begin < last:
                inner = [x[begin:last] for x in rows]
                yield given(inner, goes(inner), False)
            tail = [x[last:] for x in rows]
            if key(tail, 0) == first:
                yield left_open(tail)
                held = []
            else:
                held = [tail]
        for rows in held:
            yield left_open(rows)

    return run


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """__id, __th, n_lines int, n_dropped int, keep binary: for each document that loses lines, a zlib-compressed bitmap with 1 for each line kept."""
    spark = docs.sparkSession
    ship(spark)
    rows = cut(line_rows(keyed(docs, id_col, text_col), min_chars))  # ranges are drawn and dealt from what is stored
    order = ["h1", "h2", F.col("id").desc()]
    lined = rows.repartitionByRange(width_for(spark, rows.count(), RANGE_ROWS), *order).sortWithinPartitions(*order, "place")
    found = cut(lined.mapInArrow(_stream(min_docs), f"open boolean, new boolean, part int, {_ROW}"))
    left_open = found.where("open")
    ends = left_open.groupBy("part", "h1", "h2").agg(F.count_if("new").alias("docs"), F.max("id").alias("top"), F.min("id").alias("low"))
    by_key = W.partitionBy("h1", "h2")  # a row a partition that the key reaches
    goes_on = F.coalesce(F.lag("low").over(by_key.orderBy("part")) == F.col("top"), F.lit(False)).cast("int")  # one document in two partitions
    known = ends.withColumn("docs", F.col("docs") - goes_on).select("part", "h1", "h2", F.sum("docs").over(by_key).alias("docs"), F.max("top").over(by_key).alias("top"))
    decided = left_open.join(known.where(F.col("docs") >= min_docs), ["part", "h1", "h2"]).where("id <> top")
    dropped = found.where("not open").select("id", "th", "n_lines", "place").unionByName(decided.select("id", "th", "n_lines", "place"))

    @F.pandas_udf("struct<n_dropped:int,keep:binary>")
    def bitmap(n_lines, places):
        import pandas as pd

        out = []
        for n, gone in zip(n_lines, places):
            keep = np.ones(n, bool)
            keep[gone] = False
            out.append((int((~keep).sum()), zlib.compress(np.packbits(keep).tobytes())))
        return pd.DataFrame(out, columns=["n_dropped", "keep"])

    gathered = dropped.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("places"))
    return gathered.select("__id", "__th", "n_lines", bitmap("n_lines", "places").alias("b")).select("__id", "__th", "n_lines", "b.n_dropped", "b.keep")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines long, n_dropped long, kept string (the lines left, joined by \\n); then the columns named in extra.

    The text is shuffled once, to meet its bitmap.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)]
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"), *others)
    joined = source.join(bitmaps.select("__id", "__th", "n_dropped", "keep"), ["__id", "__th"], "left")

    @F.pandas_udf("string")
    def left(text, keep):
        import pandas as pd

        out = []
        for t, k in zip(text, keep):
            if k is not None:
                lines = t.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines)).tolist()
                t = "\n".join([x for x, b in zip(lines, bits) if b])
            out.append(t)
        return pd.Series(out, dtype=object)

    n_lines = (F.length("__text") - F.length(F.replace(F.col("__text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    changed = joined.select("*", F.when(F.col("keep").isNotNull(), left(F.when(F.col("keep").isNotNull(), F.col("__text")).otherwise(F.lit("")), F.col("keep"))).otherwise(F.col("__text")).alias("__kept"))
    return changed.select(public_id(), n_lines.alias("n_lines"), F.coalesce(F.col("n_dropped").cast("long"), F.lit(0).cast("long")).alias("n_dropped"), F.col("__kept").alias("kept"), *[F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)])


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
