"""SimHash near-dedup with pigeonhole blocks.

A fingerprint has 64 bits over the hashes of a text's 3-word shingles. It is split into `blocks` blocks; fingerprints
that differ in at most `distance` bits agree in at least blocks - distance of them, so any such pair meets under one of
the C(blocks, blocks - distance) keys. Only distinct fingerprints take part, each as the smallest doc_id that has it, so
exact copies never meet. The fingerprints under a key are compared with XOR and bit counts, and a key gives a star for
each connected group in it, not its pairs. Keys over GROUP fingerprints are cut into slices of that size, and each two
slices meet in a group of their own of two slices at most. Links become components by contraction. Where components
are brought back to documents, a fingerprint that many copies share is dealt to several places.

Defined results: null and wordless texts have fingerprint zero and link like others. Repeated rows and rows of one id
each get a row. A null id counts as the smallest. Whole texts are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_LOWER, keyed, pieces, public_id, spread_join, texts
from textloom.llm.components import components
from textloom.session import cut, ship, shuffle_partitions

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints under one key that are compared in one task.
GROUP = 1024
#: Keys a fingerprint; more blocks make more keys, which fewer fingerprints share by chance.
MOST_KEYS = 60
_LANES, _BYTES = np.uint64(0x0101010101010101), np.uint64(0xFF)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, from the lowest: eight byte lanes at a time."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        block = hashes[at : at + 255 * 256]
        edges = np.arange(0, len(block), 255)
        for shift in range(8):
            lanes = np.add.reduceat((block >> np.uint64(shift)) & _LANES, edges)
            for byte in range(8):
                out[8 * byte + shift] += int(((lanes >> np.uint64(8 * byte)) & _BYTES).sum())
    return out


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if over half of the shingles' XXH64 have it."""
    import xxhash

    words = text.translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, len(words) - k + 1)
    bits = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits[::-1]).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """__id, __th, fp long (the 64 bits as a signed number): one row for each input row, in one narrow pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            values = np.array([fingerprint(t, shingle, seed) for t in texts(batch, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["__id", "__th", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "__id long, __th long, fp long")


def block_keys(distance: int, fingerprints: int) -> tuple[list[tuple[int, int]], int]:
    """((first bit, width) of each block, blocks that close pairs share): few keys whose chance meetings stay below the fingerprints."""
    blocks = distance + 1
    while fingerprints >= 2 ** ((blocks - distance) * (64 // blocks) - 3) and blocks < 64 and comb(blocks + 1, distance) <= MOST_KEYS:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], blocks - distance


def stars(fps: np.ndarray, reps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of one group that connect what its pairs within the distance connect."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= distance
    a, b, free = [], [], np.ones(n, bool)
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        front = np.array([i])
        while len(front):
            reached = near[front].any(axis=0) & free
            free &= ~reached
            front = np.flatnonzero(reached)
            a += [int(reps[i])] * len(front)
            b += reps[front].tolist()
    return a, b


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of representatives, enough to connect all whose fingerprints differ in at most distance bits. distinct: fp, rep."""
    spark = distinct.sparkSession
    ship(spark)
    spans, shared = block_keys(distance, distinct.count())
    choices = list(combinations(spans, shared))

    def key(number: int, chosen) -> F.Column:
        taken = [F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)) for first, width in chosen]
        return F.xxhash64(F.lit(number), *taken)

    keyed_rows = distinct.select("fp", "rep", F.explode(F.array(*[key(i, c) for i, c in enumerate(choices)])).alias("k"))
    sizes = keyed_rows.groupBy("k").agg(F.count("*").alias("n"))
    keyed_rows = spread_join(keyed_rows, sizes.where("n > 1"), "k", "inner")
    slices = F.ceil(F.col("n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    met = keyed_rows.select("k", "fp", "rep", own.alias("s"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("t"))
    met = met.select("k", "fp", "rep", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
    dealt = met.repartition(shuffle_partitions(spark), "k", "s", "t").sortWithinPartitions("k", "s", "t", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in (0, 3, 4, 1, 2)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            new = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])])
            held = [x[new[-1] :] for x in rows]
            yield _found(rows, new)
        if held is not None:
            yield _found(held, np.array([0, len(held[0])]))

    def _found(rows: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        a: list[int] = []
        b: list[int] = []
        fps = rows[3].view(np.uint64)
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if end - at == 2:
                if np.bitwise_count(fps[at] ^ fps[at + 1]) <= distance:
                    a.append(int(rows[4][at]))
                    b.append(int(rows[4][at + 1]))
            elif end - at > 2:
                x, y = stars(fps[at:end], rows[4][at:end], distance)
                a += x
                b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, __th, fingerprint string (16 hex digits), component_id long: the smallest doc_id that is reachable over links."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min("__id").alias("rep")))
    # A doc_id with several texts has several fingerprints: they share their representative, so they link.
    vertices = distinct.select(F.col("rep").alias("v")).distinct()
    grouped = components(vertices, links(distinct, distance))
    by_fp = spread_join(distinct, grouped.withColumnRenamed("v", "rep"), "rep", "inner").select("fp", "component")
    return spread_join(marked, by_fp, "fp", "inner").select(public_id(), "__id", "__th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != F.lit(-(1 << 63)), F.col("component")).alias("component_id"))
