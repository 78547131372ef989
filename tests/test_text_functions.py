import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.entities import entity_set

SAMPLES = ["", "  ", "hello world foo", "café naïve x", "A\tb\n c\x1cd\x85e", "İstanbul Straße ΣΑΣ", "one. two! three? four", "x" * 100, "a_b c-d 12", "　wide　"]


def one(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def py_words(t):
    return [w.lower() for w in re.findall(r"\w+", t)]


def py_tokens(t):
    return max(1, round(max(len(t) / 4, len(py_words(t)) * 0.75))) if t.strip() else 0


def test_counts_match_python(spark):
    c = F.col("t")
    assert one(spark, SAMPLES, T.words(c)) == [py_words(t) for t in SAMPLES]
    assert one(spark, SAMPLES, T.word_count(c)) == [len(py_words(t)) for t in SAMPLES]
    assert one(spark, SAMPLES, T.estimate_tokens(c)) == [py_tokens(t) for t in SAMPLES]
    assert one(spark, SAMPLES, T.is_blank(c)) == [not t.strip() for t in SAMPLES]
    assert one(spark, SAMPLES, T.strip(c)) == [t.strip() for t in SAMPLES]
    flat = [re.sub(r"\s+", " ", t).strip() for t in SAMPLES]
    assert one(spark, SAMPLES, T.normalize_whitespace(c)) == flat
    assert one(spark, SAMPLES[:5], T.content_hash(c)) == [hashlib.sha256(f.lower().encode()).hexdigest() for f in flat[:5]]


def test_hash_ignores_case_and_space(spark):
    a, b = one(spark, ["Hello   World", " hello world\n"], T.content_hash(F.col("t")))
    assert a == b


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles(spark, size):
    def py(t):
        w = py_words(t)
        return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    assert [set(x) for x in one(spark, SAMPLES, T.shingles(F.col("t"), size))] == [py(t) for t in SAMPLES]


def test_jaccard_and_minhash(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["a"]), ([], []), (["x"], ["y"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 1.0, 0.0, 0.0]
    sims = [r[0] for r in df.select(T.minhash_similarity(T.minhash_signature(F.col("a")), T.minhash_signature(F.col("b")))).collect()]
    assert sims[1] == 1.0 and sims[3] < 0.5


def test_lines_sentences_truncate(spark):
    df = spark.createDataFrame([("abcde\nfghij\nklmno",)], "t string")
    assert [df.select(T.line_of(F.col("t"), F.lit(o))).first()[0] for o in (0, 5, 6, 12)] == [1, 1, 2, 3]
    assert one(spark, ["One. Two! Three"], T.sentences(F.col("t"))) == [["One.", "Two!", "Three"]]
    assert one(spark, ["a " * 60, "short"], T.truncate(F.col("t"), 10)) == ["a a a a a…", "short"]


def test_entities(spark):
    text = "The Zephyr project uses RAG with PostgreSQL and LLM tools. The Orion Engine has snake_case_name and camelCaseName."
    found = set(one(spark, [text], entity_set(F.col("t")))[0])
    assert {"zephyr", "rag", "postgresql", "llm", "orion engine", "snake_case_name", "camelcasename"} <= found
    assert "the" not in found


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("aB é_1.\n\t |-"), max_size=30), min_size=1, max_size=20))
def test_words_and_strip_property(spark, texts):
    assert one(spark, texts, T.words(F.col("t"))) == [py_words(t) for t in texts]
    assert one(spark, texts, T.strip(F.col("t"))) == [t.strip() for t in texts]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("aB  \u3000\x1c\x85\xa0\n\t\r\u2009."), max_size=40), min_size=1, max_size=30))
def test_white_space_property(spark, texts):
    assert one(spark, texts, T.normalize_whitespace(F.col("t"))) == [" ".join(t.split()) for t in texts]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_hashed_shingles_are_as_many_and_as_alike(spark, size):
    df = spark.createDataFrame([(t, u) for t in SAMPLES for u in SAMPLES], "t string, u string")
    pairs = df.select(*[T.jaccard(f(F.col("t"), size), f(F.col("u"), size)).alias(n) for n, f in (("a", T.shingles), ("b", T.hashed_shingles))], F.size(T.shingles(F.col("t"), size)).alias("m"), F.size(T.hashed_shingles(F.col("t"), size)).alias("n"))
    assert all(r.a == r.b and r.m == r.n for r in pairs.collect())


def test_hashed_shingles_have_the_values_of_sparks_hashes(spark):
    texts = ["one two three four five six two three four five six", "short text", "", " .,", None, "ÀB cd_1 \u0130x ΟΔΟΣ ΟΔΟΣ' ² 漢字 a\u0307b x-y", " ".join("long" * 40 for _ in range(9)), "w " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 2, 5):
        cut = lambda hs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(hs) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hs, i, size)))  # noqa: B023, E731
        hs = F.transform(T.words(F.col("t")), lambda w: F.xxhash64(w))
        own = F.when(F.size(hs) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(cut(hs)))
        for r in df.select(F.sort_array(T.hashed_shingles(F.col("t"), size)).alias("a"), F.sort_array(own).alias("b"), "t").collect():
            assert r.a == (None if r.t is None else r.b), r


def test_fingerprints_have_the_values_of_sparks_hashes(spark):
    from textloom.operators.duplicates import fingerprinted

    texts = ["A  b\n\tc\u00a0\u3000D", " \x1c\u2028 ", "", None, "\u0130x ΟΔΟΣ ΟΔΟΣ'", "!!", "a\x85b \u200b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "index long, text string")
    t = F.col("text")
    own = df.select("index", F.when(~T.is_blank(t), T.content_hash(t)).alias("h"), F.when(~T.is_blank(t), F.sort_array(T.hashed_shingles(t, 2))).alias("s"))
    got = fingerprinted(df, 2).select("index", F.col("content_hash").alias("h"), F.sort_array("shingles").alias("s"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, own.collect()))
    assert fingerprinted(df, None).columns == ["index", "content_hash"]
