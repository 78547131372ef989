"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Statistics are array and string expressions over the words and lines of a text; each rule compares one of them with its
bounds. Words are runs of characters other than ASCII white space. Repeated words: the windows of `span` words are named
by 64-bit hashes built by doubling (1, 2, 4 words ...), sorted with their places, and the places of windows that occur
twice are merged into a count of words; only texts with such windows pay for that.

Defined results: a null text counts as empty: no words, no lines with words, all counts 0, base_failed. Texts are taken
whole. Ids, null or repeated, and other columns have no part in it: one row out for each row in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, lower_az

SYMBOLS = "#*$%&|<>"
SPAN = 8
#: Frequent short words of the languages in the corpus, A-Z lower-cased; a text of running words has some of them.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "it", "that", "be", "der", "die", "das", "und", "den", "ist", "ein", "zu", "nicht", "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "el", "los", "las", "y", "se", "del", "por")


@dataclass(frozen=True)
class Threshold:
    """A rule fails where its statistic is under least or over most; from: it holds for texts of so many words."""

    name: str
    statistic: str
    least: float | None = None
    most: float | None = None
    words_from: int = 0


#: The method's own rules, beside the two of the base.
THRESHOLDS: tuple[Threshold, ...] = (
    Threshold("symbols_per_word", "symbol_ratio", most=0.3),
    Threshold("mean_word_length", "mean_word_length", least=2.0, most=15.0),
    Threshold("duplicate_lines", "dup_line_ratio", most=0.5),
    Threshold("bullet_lines", "bullet_line_ratio", most=0.9, words_from=50),
    Threshold("ellipsis_lines", "ellipsis_line_ratio", most=0.5, words_from=50),
    Threshold("alphabetic_words", "alpha_ratio", least=0.5),
    Threshold("stop_words", "stop_ratio", least=0.02, words_from=100),
)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(step: int):
    """From hashes of runs of step words to those of twice as many."""

    def body(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))

    return body


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words that windows of span words cover which occur twice or more in the array; span: a power of two."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < span:
        hashes = let(hashes, _doubled(step))
        step *= 2

    def covered(h: Column) -> Column:
        # Sorted (hash, place): a window recurs if a neighbour has its hash.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            n = F.size(p)
            same = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: a["h"] == b["h"])
            flags = let(same, lambda s: F.zip_with(F.concat(F.array(F.lit(False)), s), F.concat(s, F.array(F.lit(False))), lambda a, b: a | b))
            marked = F.zip_with(p, flags, lambda x, f: F.when(f, x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        return let(pairs, lambda p: let(places(p), lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(span)), F.lit(span))), F.lit(0).cast("long"), lambda s, x: s + x)))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measured(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios that rules use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    longest = max(map(len, STOP_WORDS))

    def line_counts(ls: Column) -> Column:
        bare = F.transform(ls, lambda x: F.trim(x))
        return F.struct(
            F.size(ls).cast("long").alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
            F.size(F.filter(bare, lambda x: F.substring(x, 1, 1).isin("-", "*", "•", "·"))).alias("bullets"),
            F.size(F.filter(bare, lambda x: x.endswith("...") | x.endswith("…"))).alias("ellipses"),
        )

    def word_counts(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n"),
            F.length(F.array_join(ws, "")).cast("long").alias("chars"),
            repeated_words(ws).alias("repeated"),
            F.size(F.filter(ws, lambda w: (F.length(w) <= longest) & lower_az(w).isin(*STOP_WORDS))).alias("stop"),
            F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).alias("alpha"),
        )

    base = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text.alias("__t"))
    text = F.col("__t")
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    marks = F.regexp_count(text, F.lit("[" + "".join(f"\\{c}" for c in SYMBOLS) + "]")).cast("long")
    counted = base.select("*", marks.alias("__s"), let(words, word_counts).alias("__w"), let(lines, line_counts).alias("__l"))
    n, word_chars, symbols = F.col("__w.n"), F.col("__w.chars"), F.col("__s")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    return counted.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        n.alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"), F.col("__l.dup").alias("n_dup_lines"), F.col("__w.repeated").alias("n_repeat_words"),
        ratio(symbols, n).alias("symbol_ratio"), ratio(word_chars, n).alias("mean_word_length"), ratio(F.col("__l.dup"), F.col("__l.n")).alias("dup_line_ratio"),
        ratio(F.col("__l.bullets"), F.col("__l.n")).alias("bullet_line_ratio"), ratio(F.col("__l.ellipses"), F.col("__l.n")).alias("ellipsis_line_ratio"),
        ratio(F.col("__w.alpha"), n).alias("alpha_ratio"), ratio(F.col("__w.stop"), n).alias("stop_ratio"),
    )


def failed(thresholds: Sequence[Threshold] = THRESHOLDS) -> Column:
    """Names of the rules that a row of measured() fails, as an array."""
    tests = []
    for t in thresholds:
        bad = F.lit(False)
        if t.least is not None:
            bad = bad | (F.col(t.statistic) < F.lit(t.least))
        if t.most is not None:
            bad = bad | (F.col(t.statistic) > F.lit(t.most))
        tests.append(F.when(bad & (F.col("n_words") >= F.lit(t.words_from)), F.lit(t.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judged(docs: DataFrame, text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """measured(), base_failed boolean, failed_rules array<string>, kept boolean."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured(docs, text_col, keep).withColumn("base_failed", base).withColumn("failed_rules", failed(thresholds))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
