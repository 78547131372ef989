"""Scalar text functions as column expressions. Regular expressions spell out the classes that Python's re would use."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom.functions.shingling import shingle_sets
from textloom.session import ship

#: Body of a character class: what Python counts as white space.
WS = r"\s\x1c-\x1f\x85\xa0  -     　"
#: Where Python's splitlines() breaks.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]+"
ELLIPSIS = "…"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, most of them, are left as they are."""
    return F.trim(F.regexp_replace(text, rf" ?[{WS}&&[^ ]][{WS}]*|  [{WS}]*", " "))


def normalize_for_hash(text: Column) -> Column:
    return F.lower(normalize_whitespace(text))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without regard to case and runs of white space."""
    return F.sha2(normalize_for_hash(text), 256)


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.lower(w))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def estimate_tokens(text: Column) -> Column:
    """The larger of a quarter of the characters and three quarters of the words, rounded half to even; 0 if blank."""
    guess = F.bround(F.greatest(F.length(text) / 4.0, word_count(text) * 0.75), 0)
    return F.when(is_blank(text), F.lit(0)).otherwise(F.greatest(F.lit(1.0), guess)).cast("int")


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of size words; all words together if there are fewer; none without words."""

    def cut(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, size), " "))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(words(text), cut)


def hashed_shingles(text: Column, size: int = 5) -> Column:
    """array<long>: the same set by 64-bit hashes of the hashes of its words, worked out in Arrow batches."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return shingle_sets(texts, size)

    return sets(text)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0.0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def minhash_signature(shingle_set: Column, permutations: int = 32) -> Column:
    """Smallest hash of the set under each seed; an empty set has the largest value everywhere."""
    seeds = F.sequence(F.lit(0), F.lit(permutations - 1))
    hashed = F.transform(shingle_set, lambda x: F.xxhash64(x))  # bound once: else each seed would cut the text anew
    return let(hashed, lambda hs: F.transform(seeds, lambda s: F.coalesce(F.array_min(F.transform(hs, lambda h: F.xxhash64(h, s))), F.lit((1 << 63) - 1))))


def minhash_similarity(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) > 0, same / F.size(a)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), rf"(?<=[.!?])[{WS}]+"), lambda s: s != "")


def truncate(text: Column, limit: int = 80) -> Column:
    """A preview on one line."""
    flat = normalize_whitespace(text)
    cut = F.regexp_replace(F.substring(flat, 1, limit - 1), rf"[{WS}]+\z", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line in which a 0-based character offset lies."""
    before = F.substr(text, F.lit(1), F.greatest(offset, F.lit(0)))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_BREAK), lambda line: ~is_blank(line))
