"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is its last token appended to the encoding of what stands before that token. A token can be
the last one exactly if the merges leave it and its neighbour apart. So the distinct words of a batch go into a trie,
held as sorted words, and one depth-first walk gives each node the last token of its prefix: prefixes that words share
are encoded once.
The last character of a word carries the end-of-word mark, and is a leaf of its own.

Defined results: a null or empty text has no tokens and decodes to "". A text of any length is encoded whole. Repeated
rows each get their result; other columns, also those named like an output, are not read.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import FLUSH_BYTES, pieces, texts
from textloom.session import ship

#: White space for some tools and not for others: texts with these are only split at plain spaces, and the tokenizer's own rules do the rest.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -     　]")
_PLAIN = re.compile("[^ \t-\r]+")
#: Chunks of these letters need no composing, and lower-case alike in Python and in the library: their words are found here, the others' by the library.
_LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_BYTE_LEVEL = {c: "".join(_BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}
CACHED_CHUNKS, CACHED_WORDS, CACHED_PAIRS = 180_000, 180_000, 200_000
#: Characters over which a chunk or word isn't kept.
LONG_CHUNK = 64


class TrieBpe:
    """Encoder of one vocabulary file of the tokenizers library, with a BPE model that marks word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or unsupported or spec.get("decoder") or spec.get("post_processor") or not model.get("end_of_word_suffix"):
            raise ValueError(f"not a word-end BPE vocabulary without decoder: {path} {unsupported}")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match the raw text as they stand")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else (lambda s: s)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.made = {left + right: (r, left, right) for r, (left, right) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.id_text = {t: str(i) for t, i in self.vocab.items()}
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and first == _WORD_PATTERN
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_start = next(iter({t[0] for t in self.added}), "") if len({t[:1] for t in self.added}) == 1 else ""
        self.token |= {i: t for t, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.young_words: dict[str, tuple[str, int, str]] = {}
        self.old_words: dict[str, tuple[str, int, str]] = {}
        self.long: list[str] = []
        self.wordless = False  # whether a chunk without words was met

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges leave these neighbours as two tokens.

        Undo the merges of both from the last to the first. A merge over the border comes about if its rank is before
        the merge that would take one of its parts away; of equal ranks, the left one is first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        rank, made, limit = self.rank, self.made, 1 << 60
        while True:
            if rank.get((left, right), limit) < limit:
                self.pairs[key] = False
                return False
            a, b = made.get(left), made.get(right)
            if a and (not b or a[0] > b[0]):
                limit, left = a[0], a[2]
            elif b:
                limit, right = b[0] + 1, b[1]
            else:
                self.pairs[key] = True
                return True

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, in the byte-level alphabet: one depth-first walk through the trie of the words.

        The trie is held as its depth-first order, the sorted words: a word leaves the path of the one before it where
        their characters part. The state of a node is the last token of its prefix. It is worked out from the states
        above it when a word below first asks for it, and holds while the walk stays below that node. The path and the
        depth of questions grow with the longest word.
        """
        end, vocab, apart, longest = self.end, self.vocab, self.apart, self.longest
        ordered = sorted(words)
        most = max(map(len, ordered), default=0)
        out: dict[str, list[str]] = {}
        last: list[str] = [""] * (most + 1)  # last[n]: of the first n characters of the path, "" while unknown
        unknown, path = [""] * (most + 1), ""

        def state(word: str, n: int) -> str:
            for start in range(n - longest if n > longest else 0, n):
                token = word[start:n]
                if token in vocab and (start == 0 or apart(last[start] or state(word, start), token)):
                    last[n] = token
                    return token
            raise ValueError(f"the vocabulary can't spell {word[:n]!r}")

        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, most + 1000))
        try:
            for word in ordered:
                n, shared = len(word), 0
                for a, b in zip(path, word):
                    if a != b:
                        break
                    shared += 1
                last[shared + 1 : len(path) + 1] = unknown[shared + 1 : len(path) + 1]
                path, leaf = word, word + end
                for start in range(n + len(end) - longest if n + len(end) > longest else 0, n):
                    token = leaf[start:]
                    if token in vocab and (start == 0 or apart(last[start] or state(word, start), token)):
                        break
                else:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                tokens, rest = [token], start
                while rest > 0:
                    token = last[rest] or state(word, rest)
                    tokens.append(token)
                    rest -= len(token)
                tokens.reverse()
                out[word] = tokens
        finally:
            sys.setrecursionlimit(limit)
        return out

    def word(self, chunk: str) -> str:
        """The one word of a chunk of letters, in the byte-level alphabet, or "" if the library has to say."""
        if not self.simple:
            return ""
        if chunk.isascii():
            return chunk.lower()
        return chunk.lower().translate(_BYTE_LEVEL) if _LATIN.fullmatch(chunk) else ""

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in the byte-level alphabet."""
        head, mark = chunk[:-1], chunk[-1]
        if head.isalpha() and mark.isascii() and not mark.isalpha() and (w := self.word(head)):
            return [w, mark]
        if self.simple and _LATIN.fullmatch(chunk):
            lower = chunk.lower()
            if lower.isascii():
                return _LATIN_WORDS.findall(lower)
            return [w if w.isascii() else w.translate(_BYTE_LEVEL) for w in _LATIN_WORDS.findall(lower)]
        return [w for w, _ in self.split(self.normalize(chunk))]

    def chunks(self, text: str) -> list[str]:
        return _PLAIN.findall(text) if _ODD_SPACE.search(text) else text.split()

    def entry(self, tokens: list[str]) -> tuple[str, int, str]:
        return " ".join(map(self.id_text.__getitem__, tokens)), len(tokens), " ".join(tokens)

    def learn(self, wanted: set[str]) -> dict[str, tuple[str, int, str]]:
        """(ids, number, tokens) of these chunks of text without white space, among others.

        What is known is kept by chunk and by word, each in two generations of bounded size: a word that comes with
        other marks around it is not encoded again. Long chunks are forgotten at the next call.
        """
        for c in self.long:
            del self.young[c]
        if len(self.young) > CACHED_CHUNKS:
            self.old, self.young = self.young, {}
        if len(self.young_words) > CACHED_WORDS:
            self.old_words, self.young_words = self.young_words, {}
        young, old, spelled, once = self.young, self.old, self.young_words, self.old_words
        new = wanted.difference(young)
        self.long = [c for c in new if len(c) > LONG_CHUNK]
        known = new.intersection(old)
        young.update(zip(known, map(old.__getitem__, known)))
        new -= known
        single = {c: w for c in new if c.isalpha() and (w := self.word(c))}  # most chunks are a word
        several = {c: self.words(c) for c in new if c not in single}
        fresh = set(single.values()).union(*several.values()).difference(spelled)
        known = fresh.intersection(once)
        spelled.update(zip(known, map(once.__getitem__, known)))
        fresh -= known
        for word, tokens in self.encode_words(fresh).items():
            spelled[word] = self.entry(tokens)
        young.update(zip(single, map(spelled.__getitem__, single.values())))
        for chunk, ws in several.items():
            own = [spelled[w] for w in ws]
            young[chunk] = own[0] if len(own) == 1 else (" ".join([e[0] for e in own]), sum([e[1] for e in own]), " ".join([e[2] for e in own]))
            self.wordless |= not ws
        for word in [w for w in fresh if len(w) > LONG_CHUNK]:
            del spelled[word]
        return young

    def encode(self, documents: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text."""
        segments: list[list[list[str] | str]] = []
        wanted: set[str] = set()
        for text in documents:
            parts = self.added_pattern.split(text) if self.added_pattern and self.added_start in text else [text]
            row: list[list[str] | str] = []
            for i, part in enumerate(parts):
                if i % 2:
                    row.append(part)
                elif part:
                    row.append(cs := self.chunks(part))
                    wanted.update(cs)
            segments.append(row)
        known, out = self.learn(wanted), []
        for row in segments:
            entries: list[tuple[str, int, str]] = []
            for part in row:
                if isinstance(part, str):
                    entries.append((str(self.added[part]), 1, part))
                else:
                    entries += map(known.__getitem__, part)
            if self.wordless:
                entries = [e for e in entries if e[1]]
            ids, numbers, tokens = zip(*entries) if entries else ((), (), ())
            out.append((sum(numbers), " ".join(ids), " ".join(tokens)))
        return out

    def forget(self) -> None:
        """Give back the memory of what was learnt; the vocabulary stays."""
        for known in (self.young, self.old, self.young_words, self.old_words, self.pairs):
            known.clear()
        self.long = []

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode() gives where a vocabulary has no decoder: tokens joined by a space."""
        return " ".join([self.token[i] for i in ids if i in self.token])


_ENCODERS: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """One encoder a process and vocabulary: workers keep it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieBpe(path)
        gc.freeze()  # the tables stay as long as the worker
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and n_tokens long, ids_text string (decimal ids joined by a space), decoded string.

    One narrow pass without a shuffle. Words are encoded once for each batch of about 4 MB of text and kept in a cache
    of bounded size. vocabulary: a path that every executor can open.
    """
    ship(docs.sparkSession)
    source = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"__{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), "n_tokens long", "ids_text string", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        model.forget()  # a task before this one may have failed
        for batch in pieces(batches, "__text", FLUSH_BYTES // 2):
            rows = model.encode(texts(batch, "__text"))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"__{i}" for i in range(len(keep))), "n_tokens", "ids_text", "decoded"])
        model.forget()  # other operators run in this worker too

    return source.mapInArrow(run, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_text", "decoded")


def token_ids(ids_text: str = "ids_text"):
    """ids_text as array<int>."""
    return F.transform(F.filter(F.split(F.col(ids_text), " "), lambda x: x != ""), lambda x: x.cast("int"))


def decode(frame: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """frame with a column decoded for an array of ids; null arrays decode to null, ids outside the vocabulary are passed over."""
    ship(frame.sparkSession)

    @F.pandas_udf("string")
    def spell(ids):
        import pandas as pd

        model = encoder(vocabulary)
        return pd.Series([None if x is None else model.decode(x.tolist()) for x in ids])

    return frame.withColumn("decoded", spell(F.col(ids_col)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
