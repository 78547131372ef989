"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

Pairwise interactions have low rank: score = w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which
takes time linear in the features. It is fitted on the driver over at most `sample` labelled rows, those with the
smallest hashes of their ids, features only; scoring is one narrow pass over all texts with the model, of a fixed size,
in a broadcast.

Defined results: null and empty texts have the features of an empty text, and a score. Without labels of both classes
the score is the share of label 1, or 0.5. Null labels aren't learnt from. Rows are scored one by one, repeated or not;
labels and documents that repeat a doc_id are learnt from once. Metadata are columns of documents: numbers by their
order of magnitude, strings by their hash, null as a value of its own; columns that are absent count as null. Language,
source and ids are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pieces, texts, whole_ids
from textloom.session import ship

BUCKETS, RANK = 1 << 16, 4
#: Labelled rows that a fit reads at most.
SAMPLE = 6000
THRESHOLD, HELD_OUT_OF, HELD_OUT = 0.7, 4, 2
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"
_BINS = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9)
_LENGTHS = (1.5, 2.5, 3.5, 4.5, 5.0, 5.5, 6.0, 6.5, 7.5, 9.0, 12.0)
_STATS = 10
_WIDTH = 16
#: Values of metadata are hashed to so many features.
_META = 1024
N_FEATURES = BUCKETS + _STATS * _WIDTH + _META
METADATA = ("n_chars",)


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, hash bucket) of each word."""
    import zlib

    codes = pa.array(words, pa.binary()).dictionary_encode()
    table = np.fromiter((zlib.crc32(w) % BUCKETS for w in codes.dictionary.to_pylist()), np.int64, len(codes.dictionary))
    at = codes.indices.to_numpy()
    return at, table[at]


def features(text: str, metadata: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text; words weigh by the log of their count and together have length one."""
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), max(1, len(raw))
    if n:
        codes, buckets = word_buckets(words)
        index, count = np.unique(buckets, return_counts=True)
        value = np.log1p(count)
        value /= np.sqrt((value**2).sum())
        repeated, distinct = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, len(np.unique(codes)) / n
    else:
        index, value, repeated, distinct = np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0
    lines = raw.split(b"\n")
    bare = [x for x in lines if x.strip()]
    stats = [
        np.searchsorted(_BINS, len(raw) / size - len(raw.translate(None, _SYMBOLS)) / size),
        np.searchsorted(_BINS, len(raw) / size - len(raw.translate(None, _DIGITS)) / size),
        np.searchsorted(_BINS, repeated),
        np.searchsorted(_BINS, distinct),
        np.searchsorted(_LENGTHS, sum(map(len, words)) / max(1, n)),
        np.searchsorted(_BINS, 1 - len(set(bare)) / max(1, len(bare))),
        np.searchsorted(_BINS, raw.count(b"|") / max(1, n)),
        min(15, n.bit_length()),
        min(15, (n // max(1, len(bare))).bit_length()),
        np.searchsorted(_BINS, (raw.count(b".") + raw.count(b"!") + raw.count(b"?") + raw.count(b"@")) / max(1, n)),
    ]
    extra = BUCKETS + _WIDTH * np.arange(_STATS) + np.array(stats, np.int64)
    meta = np.unique([BUCKETS + _WIDTH * _STATS + zlib.crc32(m.encode()) % _META for m in metadata]).astype(np.int64)
    return np.r_[index, extra, meta], np.r_[value, np.full(_STATS + len(meta), 0.5)].astype(np.float64)


def metadata_texts(columns: dict[str, str], wanted: tuple[str, ...]) -> F.Column:
    """array<string>: what features() takes of these columns. columns: the type of each that is there, by its name."""

    def one(name: str) -> F.Column:
        if name not in columns:
            return F.lit(f"{name}=")
        value = F.col(name)
        if columns[name] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz"):
            value = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1))
        return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")))

    return F.array(*[one(n) for n in wanted]).cast("array<string>")


class FactorizationMachine:
    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0 = w0
        self.w = np.zeros(N_FEATURES, np.float32) if w is None else w
        self.v = np.zeros((N_FEATURES, RANK), np.float32) if v is None else v

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        z = self.w0 + float(self.w[index] @ value) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return 1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, batch: int = 128) -> FactorizationMachine:
        """Adagrad on the logistic loss; the same rows in the same order give the same model."""
        n, share = len(labels), float(labels.mean()) if len(labels) else 0.5
        if not n or not 0 < share < 1:
            limit = min(1 - 1e-6, max(1e-6, share))
            return cls(float(np.log(limit / (1 - limit))))
        rng = np.random.default_rng(7)
        self = cls(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.01, (N_FEATURES, RANK)).astype(np.float32))
        gw, gv, g0 = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 1e-3
        for _ in range(max(12, steps // max(1, n // batch))):  # few labels are gone through more often
            order = rng.permutation(n)
            for at in range(0, n, batch):
                own = order[at : at + batch]
                index = np.concatenate([rows[i][0] for i in own])
                value = np.concatenate([rows[i][1] for i in own])
                starts = np.r_[0, np.cumsum([len(rows[i][0]) for i in own])[:-1]]
                row = np.repeat(np.arange(len(own)), np.diff(np.r_[starts, len(index)]))
                vx = self.v[index] * value[:, None]
                sums = np.add.reduceat(vx, starts)
                z = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
                e = error[row] * value
                seen, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, e) + decay * self.w[seen]
                dv = np.stack([np.bincount(back, e * (sums[row, k] - vx[:, k])) for k in range(RANK)], axis=1) + decay * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                self.w[seen] -= (rate * dw / np.sqrt(gw[seen])).astype(np.float32)
                self.v[seen] -= (rate * dv / np.sqrt(gv[seen])).astype(np.float32)
                g0 += error.sum() ** 2
                self.w0 -= rate * float(error.sum()) / np.sqrt(g0)
        return self


def held_out(id_col: str = "doc_id", of: int = HELD_OUT_OF, rest: int = HELD_OUT) -> F.Column:
    """Whether the crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: F.Column, sample: int) -> DataFrame:
    """__id, __text, label, and the other columns of docs under their names with __d before, of at most sample labelled rows.

    They are those with the smallest hashes of their ids; only ids are sorted for it. An id with several labels or texts
    counts once, by its largest label and its text of the smallest hash.
    """
    ids = whole_ids(labels, "doc_id").where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")
    held = whole_ids(docs, "doc_id").select(F.col("doc_id").cast("long").alias("__id"), text, *[F.col(c).alias(f"__d{c}") for c in docs.columns if c not in ("doc_id", "text")])
    found = held.join(F.broadcast(chosen), "__id")  # at most sample rows of two numbers
    first = found.groupBy("__id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "__id"]), F.xxhash64("__text")).alias("r"))
    return first.select("__id", "r.*").select("__id", "__text", "label", *[c for c in found.columns if c.startswith("__d")])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, metadata: tuple[str, ...] = METADATA) -> FactorizationMachine:
    ship(docs.sparkSession)
    told = docs.select("doc_id", "text", metadata_texts(dict(docs.dtypes), metadata).alias("m"))
    chosen = labelled_sample(told, labels, label, ~held_out(), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            rows = [features(t, m) for t, m in zip(texts(batch, "__text"), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(2), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "at", "val"])

    found = sorted(chosen.mapInArrow(run, "id long, label int, at binary, val binary").collect())
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(np.float64)) for r in found]
    return FactorizationMachine.fit(rows, np.array([r.label for r in found], np.float64))


def scored(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    source = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), metadata_texts(dict(docs.dtypes), metadata).alias("__m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        for batch in pieces(batches, "__text"):
            scores = [machine.score(*features(t, m)) for t, m in zip(texts(batch, "__text"), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
