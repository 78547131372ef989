"""Substring dedup with repeated-phrase automata.

A window of `window` consecutive words goes if its word sequence starts anywhere else too. Words are written as byte
codes, so a phrase of `phrase` words is a string of eight characters at most. Of each window, the phrase with the
smallest hash is its anchor; windows with the same words have the same anchor.

1. Each bucket of documents asks for its distinct anchors. Parts, dealt by hash, confirm those that recur anywhere and
   send the confirmed phrases to the buckets that asked: one shard of the confirmed phrases for each bucket.
2. Each bucket compiles its shard into an Aho-Corasick automaton (pyahocorasick) and streams every document of its own
   through it. Nothing is known of places before: the windows that hold a hit are the only ones looked at further. They
   are asked for by 128-bit fingerprints of their words, so equal codes of different words do no harm.
3. Parts say which of these windows start at two places at least, and
4. each bucket, told again where its automaton located them, takes out the words that they cover.

A phrase that recurs in a document is an anchor of that document's bucket, so its shard has every phrase that its
documents can hold a repeated window by: no document has to visit other shards, and the work is linear in the corpus.
A bucket holds about BUCKET_BYTES of text, several go to a task one after another. A bucket names each item once, with a
mark for "twice here", so a passage that every document holds puts one item a bucket into its part, and no key gathers
rows. Rows are dealt by id, text and place, so that rows which repeat both id and text spread too; docs has to be a
table, or another plan that gives the same rows in the same order if it is computed again. Steps 2 and 4 read a bucket
from the shuffle separately and know windows by place, so both put its rows in order first.

Defined results: null and empty texts have no words. Texts under one window lose nothing. A repeated row is a further
place where its windows start, so both rows lose them. Texts are taken whole. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import NULL_ID, dealt_labels, keyed
from textloom.session import ship, text_bytes, width_for

WINDOW, PHRASE = 35, 8
#: Text of a bucket, and of the buckets in a task.
BUCKET_BYTES, TASK_BYTES = 2 << 20, 16 << 20
#: Rows of one id and text are dealt over so many buckets.
SPREAD = 64
_FACTORS = (0xD6E8FEB86659FD95, 0xA0761D6478BD642D)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Rows to a part: a bucket's questions, or a note to itself that the part hands back.
_ASK = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary()), ("note", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
#: Kinds of answers: confirmed phrases, a bit for each window asked, a note handed back.
PHRASES, WINDOWS, NOTES = 0, 1, 2


def rolling(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of length items, by doubling."""
    if len(h) < length:
        return h[:0]
    out, done, power, size, left = None, 0, h, 1, length
    while True:
        if left & 1:
            if out is None:
                out, done = power, size
            else:
                m = len(h) - done - size + 1
                out, done = out[:m] + np.uint64(pow(factor, done, 1 << 64)) * power[done : done + m], done + size
        left >>= 1
        if not left:
            return out
        m = len(power) - size
        power, size = power[:m] + np.uint64(pow(factor, size, 1 << 64)) * power[size : size + m], 2 * size


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads the weakness of low bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIERS[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MULTIPLIERS[1])
    return h ^ (h >> np.uint64(32))


def unmixed(h: np.ndarray) -> np.ndarray:
    """What mixed() was given."""

    def unshifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.bitwise_xor.reduce([x >> np.uint64(k) for k in range(0, 64, by)])

    first, second = (np.uint64(pow(m, -1, 1 << 64)) for m in _MULTIPLIERS)
    return unshifted(unshifted(unshifted(h, 32) * second, 29) * first, 31)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after another, where each text's words begin and the last's end)."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # a margin leaves an empty word
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    offsets = lists.offsets.to_numpy()
    return words.filter(real), before[offsets - (offsets[0] if len(offsets) else 0)]


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a number of each word, 128 bits of each word in two columns); distinct words are hashed once."""
    import xxhash

    codes = words.dictionary_encode()
    table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, codes.dictionary.cast(pa.binary()).to_pylist())), np.uint64).reshape(-1, 2)
    numbers = codes.indices.to_numpy()
    return numbers, table[numbers]


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value in each run of width values."""
    best, size = np.arange(len(values)), 1
    while size < width:  # minima over doubled, then overlapping stretches
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best, size = np.where(values[b] < values[a], b, a), size + step
    return best[: max(0, len(values) - width + 1)]


def ordered(items: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit columns by their values."""
    order = np.argsort(items[:, 0])
    if items.shape[1] > 1:
        a = items[order]
        if ((a[1:, 0] == a[:-1, 0]) & (a[1:, 1] != a[:-1, 1])).any():
            return np.lexsort(items.T[::-1])
    return order


class Packed:
    """Distinct items in order, each in the part of its first bits; what is twice here is known to recur. parts: their labels."""

    def __init__(self, items: np.ndarray, parts: np.ndarray):
        self.order = ordered(items)
        flat = items[self.order]
        first = np.r_[True, (flat[1:] != flat[:-1]).any(axis=1)][: len(flat)]
        at = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.twice = np.diff(np.r_[at, len(flat)]) > 1
        self.items = flat[at]
        part = (self.items[:, 0] >> np.uint64(33)) * np.uint64(len(parts)) >> np.uint64(31)
        self.labels, self.edges = parts, np.searchsorted(part, np.arange(len(parts) + 1, dtype=np.uint64))

    def questions(self, bucket: int) -> pa.Table:
        rows = []
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            own = slice(self.edges[p], self.edges[p + 1])
            items, twice = self.items[own], self.twice[own]
            rows.append((bucket, int(self.labels[p]), items[~twice].tobytes(), items[twice].tobytes(), None))
        return pa.table(list(zip(*rows)) or [[]] * 5, schema=_ASK)

    def recurring(self, answers: dict[int, bytes]) -> np.ndarray:
        """Of each item as it was given: whether it is twice here or, by the answers, elsewhere too."""
        known = self.twice.copy()
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            own = np.arange(self.edges[p], self.edges[p + 1])
            once = own[~self.twice[own]]
            if len(once):
                known[once] = np.unpackbits(np.frombuffer(answers[int(self.labels[p])], np.uint8), count=len(once)).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = known[self.group]
        return out


def answered(columns: int, kind: int):
    """Of a part, for each bucket: which of its items are anywhere else too; phrases themselves, or a bit for each item once."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        noted = frame["note"].notna()
        notes = pd.DataFrame({"bucket": frame["bucket"][noted], "kind": NOTES, "part": frame["part"][noted], "found": frame["note"][noted]})
        frame = frame[~noted]
        if frame.empty:
            return notes
        once = [np.frombuffer(x, np.uint64).reshape(-1, columns) for x in frame["once"]]
        twice = [np.frombuffer(x, np.uint64).reshape(-1, columns) for x in frame["twice"]]
        sizes = np.array([len(x) for x in once])
        flat = np.concatenate([*once, *twice])
        total = int(sizes.sum())
        order = ordered(flat)
        flat = flat[order]
        first = np.r_[True, (flat[1:] != flat[:-1]).any(axis=1)][: len(flat)]
        at = np.flatnonzero(first)
        several = np.add.reduceat(np.where(order < total, 1, 2), at) > 1 if len(at) else np.zeros(0, bool)
        again = np.zeros(len(order), bool)
        again[order] = several[np.cumsum(first) - 1]
        marks = np.split(again[:total], np.cumsum(sizes)[:-1])
        if kind == PHRASES:
            found = [x[m].tobytes() + y.tobytes() for x, m, y in zip(once, marks, twice)]
        else:
            found = [np.packbits(m).tobytes() for m in marks]
        return pd.concat([pd.DataFrame({"bucket": frame["bucket"], "kind": kind, "part": frame["part"], "found": found}), notes])

    return answer


class Phrases:
    """Words as byte codes: a phrase is a number of 64 bits, and a string of one character a byte."""

    def __init__(self, phrase: int):
        self.words, self.each = phrase, 8 // phrase
        self.size = self.words * self.each

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The bytes of all words one after another. hashes: 64 bits of each word."""
        return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, : self.each].ravel()

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The phrase that begins at each word, mixed."""
        if len(codes) < self.size:
            return np.zeros(0, np.uint64)
        runs = np.lib.stride_tricks.sliding_window_view(codes, self.size)[:: self.each]
        padded = np.zeros((len(runs), 8), np.uint8)
        padded[:, : self.size] = runs
        return mixed(padded.view(np.uint64).ravel())

    def strings(self, numbers: np.ndarray) -> list[str]:
        text = unmixed(numbers).tobytes().decode("latin-1")
        return [text[i : i + self.size] for i in range(0, len(text), 8)]


class Bucket:
    """The words of a bucket's documents, one after another."""

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        self.window, self.phrases = window, Phrases(phrase)
        self.words, self.edges = split_words(texts)
        self.sizes = np.diff(self.edges)
        self.numbers, self.hashes = word_hashes(self.words)

    def anchors(self) -> np.ndarray:
        """The phrases that are anchors, in order of their places; those at several places repeat."""
        numbers = self.phrases.numbers(self.phrases.codes(self.hashes[:, 0]))
        places = first_minima(numbers, self.window - self.phrases.words + 1)
        fits = np.ones(len(places), bool)  # the window doesn't reach into the next document
        for e in self.edges[1:-1].tolist():
            fits[max(0, e - self.window + 1) : e] = False
        own = places[fits]
        return numbers[own[np.r_[True, own[1:] != own[:-1]][: len(own)]]]  # a window's anchor never stands before the last window's

    def located(self, confirmed: np.ndarray) -> np.ndarray:
        """The starts of windows that hold a confirmed phrase: every document goes through an automaton of these phrases."""
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in self.phrases.strings(confirmed):
            automaton.add_word(phrase)
        if not len(automaton):
            return np.zeros(0, np.int64)
        automaton.make_automaton()
        each, reach = self.phrases.each, self.window - self.phrases.words
        stream = self.phrases.codes(self.hashes[:, 0]).tobytes().decode("latin-1")
        steps = np.zeros(len(self.numbers) + 1, np.int64)
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            ends = [end for end, _ in automaton.iter(stream, a * each, b * each)]
            if ends and b - a >= self.window:
                last = np.array(ends, np.int64) + 1
                at = last[last % each == 0] // each - self.phrases.words  # hits at the borders of words
                np.add.at(steps, np.maximum(at - reach, a), 1)
                np.add.at(steps, np.minimum(at, b - self.window) + 1, -1)
        return np.flatnonzero(np.cumsum(steps)[:-1] > 0)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """128-bit fingerprints of the windows at these starts."""
        if not len(starts):
            return np.zeros((0, 2), np.uint64)
        return np.stack([mixed(rolling(self.hashes[:, k], self.window, _FACTORS[k])[starts]) for k in (0, 1)], axis=1)

    def gone(self, starts: np.ndarray) -> np.ndarray:
        """Of each word, whether one of these windows covers it."""
        step = np.zeros(len(self.numbers) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.window, -1)
        return np.cumsum(step)[:-1] > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        left = np.r_[0, np.cumsum(~gone)][self.edges]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), self.words.filter(pa.array(~gone))), " ")

    def spans(self, gone: np.ndarray) -> pa.Array:
        """Stretches of gone words in each document, by place in it."""
        bounds = np.zeros(len(gone) + 1, bool)  # a stretch ends with its document
        bounds[self.edges] = True
        first = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | bounds[1:-1]][: len(gone)])
        last = np.flatnonzero(gone & np.r_[~gone[1:] | bounds[1:-1], True][: len(gone)]) + 1
        doc = np.searchsorted(self.edges, first, "right") - 1
        base = self.edges[doc]
        pairs = pa.StructArray.from_arrays([pa.array(first - base, pa.int32()), pa.array(last - base, pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(self.sizes) + 1)), pa.int32()), pairs)


def to_runs(starts: np.ndarray) -> bytes:
    """Ascending numbers as the bounds of their runs."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.r_[0, breaks + 1]], starts[np.r_[breaks, len(starts) - 1]] + 1], axis=1).tobytes() if len(starts) else b""


def from_runs(blob: bytes) -> np.ndarray:
    runs = np.frombuffer(blob, np.int64).reshape(-1, 2)
    sizes = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - np.r_[0, np.cumsum(sizes)[:-1]][: len(runs)], sizes) + np.arange(int(sizes.sum()))


def _answers(replies: pa.Table, kind: int) -> dict[int, bytes]:
    some = replies.filter(pc.equal(replies["kind"], kind))
    return dict(zip(some["part"].to_pylist(), some["found"].to_pylist()))


def in_order(rows: pa.Table) -> pa.Table:
    """A bucket's rows by id and text; rows that tie are equal. Between executors a shuffle's blocks arrive in any order."""
    return rows.sort_by([(name, "ascending") for name in ("__id", "__th", "__text")])


def _texts(rows: pa.Table) -> pa.Array:
    return rows["__text"].combine_chunks()


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words long, n_removed long, kept string (the words left, joined by a space), spans array<struct<start:int,end:int>>.

    spans: stretches of words that went, by place in the input. One row for each input row.
    The text is shuffled once by bucket and read from that shuffle by all passes.
    """
    if not 0 < phrase <= min(window, 8):
        raise ValueError("a phrase has at least one word and at most eight or a window's")
    spark = docs.sparkSession
    ship(spark)
    total = text_bytes(docs, text_col)
    width, buckets = (width_for(spark, total, each) for each in (TASK_BYTES, BUCKET_BYTES))
    parts = dealt_labels(width)  # a part a task
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    held = keyed(docs, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("__id", "__th", salt), F.lit(buckets))).repartition(width, "bucket")

    def ask_phrases(rows: pa.Table) -> pa.Table:
        anchors = Bucket(_texts(rows), window, phrase).anchors()
        return Packed(anchors[:, None], parts).questions(rows["bucket"][0].as_py())

    def ask_windows(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _ASK.empty_table()
        rows = in_order(rows)
        number = rows["bucket"][0].as_py()
        bucket = Bucket(_texts(rows), window, phrase)
        starts = bucket.located(np.frombuffer(b"".join(_answers(replies, PHRASES).values()), np.uint64))
        asked = Packed(bucket.windows(starts), parts).questions(number)
        note = pa.table([[number], [int(parts[number % width])], [None], [None], [to_runs(starts)]], schema=_ASK)
        return pa.concat_tables([asked, note])

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _RESULT.empty_table()
        rows = in_order(rows)
        bucket = Bucket(_texts(rows), window, phrase)
        starts = from_runs(_answers(replies, NOTES)[int(parts[rows["bucket"][0].as_py() % width])])
        repeated = Packed(bucket.windows(starts), parts).recurring(_answers(replies, WINDOWS))
        gone = bucket.gone(starts[repeated])
        removed = np.diff(np.r_[0, np.cumsum(gone)][bucket.edges])
        ids = pc.if_else(pc.equal(rows["__id"], NULL_ID), pa.scalar(None, pa.int64()), rows["__id"])
        return pa.table([ids, pa.array(bucket.sizes), pa.array(removed), bucket.kept(gone), bucket.spans(gone)], schema=_RESULT)

    def answers_to(questions: DataFrame, columns: int, kind: int):
        answers = questions.repartition(width, "part").groupBy("part").applyInPandas(answered(columns, kind), "bucket long, kind int, part long, found binary")
        return answers.repartition(width, "bucket").groupBy("bucket")

    ask = "bucket long, part long, once binary, twice binary, note binary"
    phrases = answers_to(held.groupBy("bucket").applyInArrow(ask_phrases, ask), 1, PHRASES)
    windows = answers_to(held.groupBy("bucket").cogroup(phrases).applyInArrow(ask_windows, ask), 2, WINDOWS)
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
    return held.groupBy("bucket").cogroup(windows).applyInArrow(finish, schema)


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
