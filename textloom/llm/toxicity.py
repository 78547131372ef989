"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learnt from labelled rows: words that toxic documents have more often than chance allows, by a binomial
tail at a false discovery rate. Copies of a document count once. Terms are held in a trie. A word that is no term is
matched by walking the trie and a Levenshtein automaton of the word together, as far as both go on. The automata of all
words are one table of states and transitions: a state is a set of positions relative to a place in the word, and what a
letter does to it depends only on which of the next few letters of the word it equals (Schulz and Mihov 2002). The table
is worked out as words need it and kept. Words that labelled ordinary documents have are no misspellings.

Each occurrence is weighed by its context window: quotation marks around it or a verb of reporting before it tell
mention from abuse. Sums over the occurrences go into a logistic score that is fitted on the same labelled rows.

At most `sample` labelled rows are read for learning, those with the smallest hashes of their ids; every term that they
show is kept. Scoring is one narrow pass over whole texts. Defined results: null and empty texts score as texts without
terms. Without toxic labels nothing is toxic. Rows are scored one by one, repeated or not. Labels and documents that
repeat an id are learnt from once. Language, source and ids are no inputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pieces, texts
from textloom.llm.quality import held_out, labelled_sample
from textloom.session import ship

#: Labelled rows that learning reads at most.
SAMPLE = 20_000
THRESHOLD, HELD_OUT_OF, HELD_OUT = 0.5, 5, 0
FALSE_DISCOVERIES = 0.02
WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\"'“”„«‹‘’`", "\"'“”«»›‘’`"
#: Verbs and nouns that announce a quoted or mentioned word.
REPORTING = frozenset("said says wrote called calls quote quoted term word meaning sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
CONTEXT = 6


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LevenshteinTable:
    """The automaton of words within `limit` edits, for any word.

    A state is a sorted tuple of (offset, edits): the letters read so far cost so many edits to reach the word's place
    base + offset. No position is kept that another one makes needless.
    """

    START = ((0, 0),)

    def __init__(self, limit: int):
        self.limit, self.span = limit, 2 * limit + 1
        self.moves: dict[tuple, tuple[int, tuple]] = {}

    def step(self, state: tuple, word: str, base: int, letter: str) -> tuple[int, tuple]:
        """(new base, new state) after a letter; an empty state has no way on."""
        ahead = word[base : base + self.span]
        key = (state, len(ahead), *[i for i, c in enumerate(ahead) if c == letter])
        known = self.moves.get(key)
        if known is None:
            known = self.moves[key] = self._worked_out(state, len(ahead), set(key[2:]))
        return base + known[0], known[1]

    def _worked_out(self, state: tuple, left: int, equal: set[int]) -> tuple[int, tuple]:
        """left: letters of the word from the base on, as far as they matter; equal: those of them that the letter equals."""
        reached: dict[int, int] = {}

        def reach(offset: int, edits: int) -> None:
            if edits <= self.limit and offset <= left and edits < reached.get(offset, edits + 1):
                reached[offset] = edits

        for offset, edits in state:
            reach(offset, edits + 1)  # the letter is one too many
            reach(offset + 1, edits + 1)  # it stands for another
            for skipped in range(self.limit - edits + 1):  # letters of the word are left out before it
                if offset + skipped in equal:
                    reach(offset + skipped + 1, edits + skipped)
        best = [(o, e) for o, e in reached.items() if not any(f < e and abs(p - o) <= e - f for p, f in reached.items())]
        lowest = min((o for o, _ in best), default=0)
        return lowest, tuple(sorted((o - lowest, e) for o, e in best))

    def edits(self, state: tuple, rest: int) -> int | None:
        """Edits if the letters end here, with so many of the word's letters after the base."""
        return min((e + rest - o for o, e in state if e + rest - o <= self.limit), default=None)


class LexiconTrie:
    """Terms by character; END holds a term where it ends."""

    END = ""

    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        self.terms = frozenset(terms)
        self.automaton = LevenshteinTable(2)
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.middles: set[str] = set()
        for term in self.terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[self.END] = term
            self._pieces(term)
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})
        self.middle_sizes = sorted({len(x) for x in self.middles})

    def _pieces(self, term: str) -> None:
        k, n = edits_allowed(term), len(term)
        if k:
            edges = [n * i // (k + 1) for i in range(k + 2)]
            cut = [term[a:b] for a, b in zip(edges, edges[1:])]
            self.heads.add(cut[0])
            self.tails.add(cut[-1])
            self.middles.update(cut[1:-1])

    def may_match(self, word: str) -> bool:
        """k edits leave one of k + 1 pieces of the term whole: at its start, at its end or within."""
        if any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes):
            return True
        return any(word[i : i + n] in self.middles for n in self.middle_sizes for i in range(len(word) - n + 1))

    def nearest(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within the edits that the term allows; of equals, the first by code points."""
        if word in self.terms:
            return word, 0
        if len(word) < 4 or not self.may_match(word):
            return None
        best: tuple[int, str] | None = None
        step, n = self.automaton.step, len(word)
        stack = [(self.root, 0, LevenshteinTable.START)]
        while stack:
            node, base, state = stack.pop()
            for c, below in node.items():
                if c == self.END:
                    edits = self.automaton.edits(state, n - base)
                    if edits is not None and edits <= edits_allowed(below) and (best is None or (edits, below) < best):
                        best = (edits, below)
                    continue
                after = step(state, word, base, c)
                if after[1]:
                    stack.append((below, *after))
        return best and (best[1], best[0])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at least k of n)."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return min(1.0, sum(map(math.exp, log)))


def choose_terms(counts: list[tuple[str, int, int]], share: float, words: int) -> dict[str, float]:
    """Term: weight, of (word, toxic groups, other groups); words: how many words were tested in all."""
    tested = sorted((binomial_tail(t, t + o, share), -t, w, o) for w, t, o in counts if t > 4 * o)
    out: dict[str, float] = {}
    for rank, (p, t, w, o) in enumerate(tested, 1):
        if p > FALSE_DISCOVERIES * rank / max(1, words):
            break
        out[w] = min(1.0, (-t) / (-t + o + 0.5))
    return out


class Scorer:
    """Weighs the occurrences of terms in a text and turns their sums into a score."""

    FEATURES = 5

    def __init__(self, terms: dict[str, float], ordinary: Iterable[str], weights: list[float]):
        self.terms, self.trie, self.ordinary, self.weights = terms, LexiconTrie(terms), frozenset(ordinary), weights
        self.memo: dict[str, tuple[str, int] | None] = {}

    def match(self, word: str) -> tuple[str, int] | None:
        found = self.memo.get(word, 0)
        if found == 0:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = (word, 0) if word in self.terms else None if word in self.ordinary else self.trie.nearest(word)
            self.memo[word] = found
        return found

    def occurrences(self, text: str) -> list[dict]:
        """Each term found: start, end, word, term, edits, mentioned (quoted or reported)."""
        lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = {w: m for w in set(WORD.findall(lower)) if (m := self.match(w))}
        if not found:
            return []
        out, before = [], []
        for m in WORD.finditer(lower):
            word = m.group()
            if hit := found.get(word):
                a, b = m.span()
                quoted = (a > 0 and text[a - 1] in _OPEN and b < len(text) and text[b] in _CLOSE) or self._within_quotes(text, a, b)
                out.append({"start": a, "end": b, "word": word, "term": hit[0], "edits": hit[1], "mentioned": quoted or any(w in REPORTING for w in before)})
            before = [*before[-(CONTEXT - 1) :], word]
        return out

    @staticmethod
    def _within_quotes(text: str, a: int, b: int) -> bool:
        left, right = text[max(0, a - 60) : a], text[b : b + 60]
        for o, c in (("“", "”"), ("„", "“"), ("«", "»"), ("‹", "›")):
            if left.rfind(o) > left.rfind(c) and c in right:
                return True
        return left.count('"') % 2 == 1 and right.count('"') % 2 == 1

    def features(self, hits: list[dict]) -> list[float]:
        """Of the occurrences in a text: exact and misspelled, each as abuse and as mention."""
        sums = [0.0] * 4
        for h in hits:
            sums[2 * (h["edits"] > 0) + h["mentioned"]] += self.terms[h["term"]]
        return [1.0, *map(math.log1p, sums)]

    def score(self, features: list[float]) -> float:
        z = sum(a * b for a, b in zip(features, self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Where the fit starts from and is drawn to: base rate apart, what occurrences count for before any label says more.
PRIOR = (-3.0, 6.0, 1.0, 5.0, 0.5)


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.5) -> list[float]:
    """Logistic weights by Newton steps, drawn to PRIOR; no occurrence speaks against toxicity."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w.tolist()


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, with a signature that copies and near copies share: their three smallest hashes."""
    import zlib

    for batch in pieces(batches, "__text"):
        labels, groups, words = [], [], []
        for text, label in zip(texts(batch, "__text"), batch.column(2).to_pylist()):
            own = sorted(set(WORD.findall(text.lower())))
            labels.append(label)
            groups.append(",".join(map(str, sorted({zlib.crc32(w.encode()) for w in own})[:3])))
            words.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(groups, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["label", "grp", "words"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Lexicon and weights from the labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labelled_sample(docs.select("doc_id", "text"), labels, label, ~held_out(of=HELD_OUT_OF, rest=HELD_OUT), sample)
    told = chosen.mapInArrow(_words_of, "label int, grp string, words array<string>").persist()
    groups = told.groupBy("label").agg(F.countDistinct("grp").alias("n")).collect()
    size = {r.label: r.n for r in groups}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic:
        told.unpersist()
        return Scorer({}, (), [-6.0, 0.0, 0.0, 0.0, 0.0])
    share = toxic / (toxic + other) if other else 0.5
    own = told.select("label", "grp", F.explode("words").alias("w")).distinct()
    counts = own.groupBy("w").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o")).persist()
    words = counts.where("t + o >= 2").count()
    likely = [(r.w, r.t, r.o) for r in counts.where("t >= 2 and t > 4 * o").collect()]
    terms = choose_terms(likely, share, words)

    def near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = LexiconTrie(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in texts(batch, "w") if w not in terms and trie.nearest(w)], pa.string())], names=["w"])

    ordinary = [r.w for r in counts.where("o >= 2").select("w").mapInArrow(near_terms, "w string").collect()]  # those that the trie would take for terms
    counts.unpersist()
    told.unpersist()
    draft = Scorer(terms, ordinary, list(PRIOR))
    shared = spark.sparkContext.broadcast((draft.terms, list(draft.ordinary), draft.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in pieces(batches, "__text"):
            rows = [scorer.features(scorer.occurrences(t)) for t in texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    found = sorted((tuple(r.x), r.label) for r in chosen.mapInArrow(run, "label int, x array<double>").collect())
    draft.weights = fit_weights(np.array([f[0] for f in found]).reshape(-1, Scorer.FEATURES), np.array([f[1] for f in found], float))
    return draft


def scored(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, then score double, hits array<struct<start,end,term,edits,mentioned>>, predicted int."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((scorer.terms, list(scorer.ordinary), scorer.weights))
    source = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("mentioned", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in pieces(batches, "__text"):
            scores, hits = [], []
            for t in texts(batch, "__text"):
                found = own.occurrences(t)
                scores.append(own.score(own.features(found)))
                hits.append([{k: h[k] for k in ("start", "end", "term", "edits", "mentioned")} for h in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(hits, hit)], names=[*(f"__{i}" for i in range(len(keep))), "score", "hits"])

    kinds = ", ".join([*(f"__{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), "score double", "hits array<struct<start:int,end:int,term:string,edits:int,mentioned:boolean>>"])
    rows = source.mapInArrow(run, kinds)
    return rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "score", "hits", (F.col("score") >= threshold).cast("int").alias("predicted"))


def judged(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, scorer).select("doc_id", held_out(of=HELD_OUT_OF, rest=HELD_OUT).alias("held_out"), "score", "predicted")
