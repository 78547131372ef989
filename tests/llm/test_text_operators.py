from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import AZ, MARGIN, SPACE_WORD, found, frame, key, sha, texts
from textloom.llm import bpe, decontaminate, linededup, rules, substring, tokencounts


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    rows = texts() + [(60, "It's WE'LL <|endoftext|>x<|startoftext|> 12ab ΣΑΣ İ 漢字 😀 e\u0301 <|end"), (61, "\ud7ff\u180e a\u2028b"), (62, "end. No, x' yes! été, ñandú; ªº µ3 Straße) ſo, a1 b' 'tis it's'"), (63, "internationalization" * 400)]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((key(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    encoded = bpe.encode(frame(spark, rows), vocabulary)
    assert found(bpe.digests(encoded), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    again = bpe.decode(encoded.withColumn("ids", bpe.token_ids()).withColumnRenamed("decoded", "first"), vocabulary)
    assert again.where("decoded <> first").count() == 0
    assert bpe.encode(frame(spark, []), vocabulary).count() == 0


def test_trie_shares_prefixes(vocabulary):
    model = bpe.TrieBpe(vocabulary)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    words = ["the", "then", "thens", "thensss", "a", "internationalization", "zzzzzz", "o", "abz" * 200, "x" * 255, "x" * 256, "ab" * 4000, "qzx" * 3000, "thenx" * 52]
    assert {w: [model.vocab[t] for t in ts] for w, ts in model.encode_words(words).items()} == {w: library.encode(w, add_special_tokens=False).ids for w in words}


def windows_brute(rows, window):
    words = [SPACE_WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((key(i), len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


@pytest.mark.parametrize("window,phrase", [(35, 8), (5, 2), (1, 1), (4, 4), (7, 3)])
def test_substring_dedup(spark, window, phrase):
    rows = texts() + [(70, "p q " * 60), (71, "z " * 36)]
    got = substring.removed_words(frame(spark, rows), window=window, phrase=phrase)
    assert found(substring.digests(got), "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(rows, window)
    assert got.where(F.expr("n_removed <> aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")).count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for operator in (substring.removed_words, linededup.kept_lines, lambda d: decontaminate.hits(d, d.withColumnRenamed("doc_id", "item_id"))):
        with pytest.raises(TypeError, match="whole numbers"):
            operator(docs)


def test_mixing_can_be_undone():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert np.array_equal(substring.unmixed(substring.mixed(h)), h)


def test_labels_fill_each_partition_once(spark):
    import numpy as np

    from textloom.llm.common import dealt_labels, murmur3

    numbers = [0, 1, -1, 1 << 40, -(1 << 63), 12345678901]
    assert [r.h for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(F.hash("n").alias("h")).collect()] == murmur3(np.array(numbers)).tolist()
    names = spark.createDataFrame([(int(n),) for n in dealt_labels(13)], "n long").repartition(13, "n")
    assert sorted(r.p for r in names.select(F.spark_partition_id().alias("p")).collect()) == list(range(13))


def test_windows_are_found_by_the_automaton_alone(monkeypatch):
    """Without its hits nothing is located, and a phrase from elsewhere locates windows that no anchor of the bucket names."""
    import ahocorasick
    import numpy as np
    import pyarrow as pa

    def located(texts, phrases_of):
        other = substring.Bucket(pa.array(phrases_of), 6, 2)
        numbers = other.phrases.numbers(other.phrases.codes(other.hashes[:, 0]))
        return substring.Bucket(pa.array(texts), 6, 2).located(numbers)

    text = "a b c d e f g h i j k l"
    assert located([text, "too short", text], ["g h"]).tolist() == [*range(2, 7), *range(16, 21)]
    assert located([text], ["l a", "x y"]).tolist() == []

    class Deaf:
        def __init__(self, *kinds):
            self.words = 0

        def add_word(self, word):
            self.words += 1

        def __len__(self):
            return self.words

        def make_automaton(self):
            pass

        def iter(self, *stream):
            return iter(())

    monkeypatch.setattr(ahocorasick, "Automaton", Deaf)
    assert located([text], ["g h"]).tolist() == []


def passages() -> list[tuple[int, str]]:
    """Every third document holds a passage of 60 words, each elsewhere; the others repeat nothing."""
    passage = " ".join(f"p{k}" for k in range(60))
    return [(i, " ".join([f"w{i}x{k}" for k in range(i % 50)] + [passage] * (i % 3 == 0) + [f"v{i}x{k}" for k in range(60)])) for i in range(600)]


ON_EXECUTORS = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tests.llm.test_text_operators import passages
from textloom.llm import substring

folder = sys.argv[1]
conf = {"spark.master": "local-cluster[3,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "12", "spark.sql.files.openCostInBytes": "128m"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.createDataFrame(passages(), "doc_id long, text string").repartitionByRange(12, "doc_id").write.parquet(folder + "/documents")
substring.digests(substring.removed_words(spark.read.parquet(folder + "/documents"))).write.parquet(folder + "/result")
spark.stop()
"""


def test_substring_dedup_on_several_executors(spark, tmp_path):
    """Between executors a shuffle's blocks arrive in another order in each pass; windows have to stay those of their documents."""
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", ON_EXECUTORS, str(tmp_path)], cwd=Path(__file__).parents[2], check=True, timeout=300)
    got = spark.read.parquet(str(tmp_path / "result"))
    assert found(got, "doc_id", "n_words", "n_removed", "kept_sha256") == windows_brute(passages(), 35)


def test_substring_dedup_of_nothing(spark):
    assert substring.removed_words(frame(spark, [])).count() == 0


def lines_brute(rows, min_chars, min_docs):
    keys = [[x.strip(MARGIN).translate(AZ) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            if len(k) >= min_chars:
                holders[k].add(key(i))
    out = []
    for (i, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, ks) if not (len(k) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != key(i))]
        out.append((key(i), len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out)


@pytest.mark.parametrize("min_chars,min_docs,parts", [(20, 3, 3), (1, 2, 1), (4, 1, 7)])
def test_line_dedup(spark, min_chars, min_docs, parts):
    rows = texts()
    got = linededup.kept_lines(frame(spark, rows, parts), min_chars=min_chars, min_docs=min_docs, extra=("source",))
    assert "source" in got.columns
    assert found(linededup.digests(got), "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_brute(rows, min_chars, min_docs)


def test_line_dedup_over_many_partitions_and_none(spark):
    """One line that nearly all documents hold reaches over several ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = [(i, f"own line number {i} of this text\nThe common line of nearly everyone\n{'tail that many have here' if i % 3 else ''}") for i in range(150)]
        got = linededup.kept_lines(frame(spark, rows, 5))
        assert found(linededup.digests(got), "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_brute(rows, 20, 3)
        assert linededup.kept_lines(frame(spark, [])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def rules_brute(t):
    w = SPACE_WORD.findall(t or "")
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = [False] * len(w)
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            again[i : i + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if x.strip(MARGIN)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(again)


def test_quality_rules(spark):
    rows = texts() + [(80, "same line\nsame line\n# <x> | 50%"), (81, "a b c d e f g h " * 3), (82, "r " * 30)]
    got = rules.judged(frame(spark, rows))
    want = sorted((key(i), *rules_brute(t), rules_brute(t)[0] < 20 or 100 * rules_brute(t)[4] > 30 * rules_brute(t)[0]) for i, t in rows)
    assert found(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed and kept").count() == 0
    assert rules.judged(frame(spark, [])).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("RoundRobin", "").split("Project")[0]


def plain_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def leaks_brute(rows, items, window):
    held = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            held[tuple(w[k : k + window])] |= {str(i)} if i is not None else set()
    out = []
    for i, t in rows:
        w, ids = plain_words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if (own := tuple(w[k : k + n])) in held:
                    ids |= held[own]
                    hit[k : k + n] = [True] * n
        out.append((key(i), len(w), sum(hit), len(ids), sha(",".join(sorted(ids))), any(hit)))
    return sorted(out)


@pytest.mark.parametrize("places", [decontaminate.MASK_PLACES, 64])
def test_decontamination(spark, monkeypatch, places):
    """A bitmap that is full marks words in vain, and no more."""
    rows = texts()
    items = [(1, rows[13][1].split("\n")[1]), (2, "Changed"), (10, "short item"), (3, None), (4, "!!"), (2, rows[0][1]), (None, rows[3][1]), (9, " ".join(rows[1][1].split()[:12]) + " and words that nobody has"), (11, "lora " * 14)]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, w string, n int")
    monkeypatch.setattr(decontaminate, "MASK_PLACES", places)
    got = decontaminate.digests(decontaminate.hits(frame(spark, rows), bench))
    assert found(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == leaks_brute(rows, items, 10)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert decontaminate.hits(frame(spark, []), bench).count() == 0
    empty = decontaminate.digests(decontaminate.hits(frame(spark, rows), bench.limit(0)))
    assert empty.count() == len(rows) and empty.where("contaminated").count() == 0


def test_token_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b, c", "en", "s"), (2, None, None, "s"), (3, "d", "en", None), (3, "d", "en", None)], "doc_id long, text string, lang string, source string")
    store = tokencounts.Rollup(spark, f"{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("one", tokencounts.changes(docs, "space-1"))
    assert not store.commit("one", tokencounts.changes(docs, "space-1"))
    want = [("s", "en", 1, 3, 6), ("s", None, 1, 0, 0), (None, "en", 2, 2, 2)]
    rows = lambda: sorted(((r.source, r.lang, r.n_docs, r.n_tokens, r.n_chars) for r in store.totals().collect()), key=str)
    assert rows() == sorted(want, key=str)
    store.commit("two", tokencounts.changes(docs.where("doc_id = 3"), "space-1", tokencounts.DELETE))
    assert rows() == sorted(want[:2], key=str)
    store.compact()
    assert rows() == sorted(want[:2], key=str) and not store.commit("two", tokencounts.changes(docs, "space-1"))
    store.commit("three", tokencounts.changes(docs, "marks-2"))
    assert {(r.tokenizer_version, r.n_tokens) for r in store.totals().where("lang = 'en' and source = 's'").collect()} == {("space-1", 3), ("marks-2", 4)}
    before = rows()
    store.compact()
    assert rows() == before
    for name in ("a/b", "a@b", "", ".a"):
        with pytest.raises(ValueError):
            store.commit(name, tokencounts.changes(docs, "space-1"))


def test_token_counts_survive_failures_and_races(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " * i, "en", "s") for i in range(5)], "doc_id long, text string, lang string, source string")
    rows = tokencounts.changes(docs, "space-1")
    store = tokencounts.Rollup(spark, f"{tmp_path}/store")
    total = lambda: [tuple(r) for r in store.totals().collect()]

    def fails(*names):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the driver goes after the deltas are written
        m.setattr(store, "_mark", fails)
        with pytest.raises(RuntimeError):
            store.commit("one", rows)
    assert total() == []
    assert store.commit("one", rows)
    want = total()
    other = tokencounts.Rollup(spark, f"{tmp_path}/store")
    with monkeypatch.context() as m:  # two attempts at once: the second hasn't seen the first
        seen = [{}]
        m.setattr(other, "committed", lambda: seen.pop() if seen else tokencounts.Rollup.committed(other))
        other.commit("one", rows)
    assert len(store._marks("commits")) == 2 and total() == want
    store.commit("two", rows)
    doubled = total()
    assert [(n, t) for *_, n, t, _ in doubled] == [(2 * n, 2 * t) for *_, n, t, _ in want]
    with monkeypatch.context() as m:  # a fold that fails
        m.setattr(store, "_mark", fails)
        with pytest.raises(RuntimeError):
            store.compact()
    assert total() == doubled
    read = store._read

    def slow(*args):  # a batch is committed while a fold runs
        other.commit("three", rows)
        return read(*args)

    with monkeypatch.context() as m:
        m.setattr(store, "_read", slow)
        store.compact()
    assert [t[3] for t in total()] == [15] and not store.commit("three", rows)
    other.compact()
    assert [t[3] for t in total()] == [15]
    store._mark("folds", "2", "0")  # another fold of that number, whose folder doesn't win
    assert [t[3] for t in total()] == [15]


def test_maintained_counts(spark, tmp_path):
    text = "word " * 30
    rows = [(1, text + "me@example.org and you@example.org"), (2, "short"), (3, None), (None, text), (4, text * 3000), (4, text * 3000)]
    docs = frame(spark, rows)
    got = {(r.source, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars) for r in tokencounts.maintained(docs, f"{tmp_path}/store").collect()}
    src = {k: [t for i, (_, t) in enumerate(rows) if i % 3 == k and len((t or "").split()) >= 20] for k in range(3)}
    masked = {k: [t.replace("me@example.org", "[masked address]").replace("you@example.org", "[masked address]") for t in ts] for k, ts in src.items()}
    assert {k: v for k, v in got.items() if k[1] == "space-1"} == {(f"src{k}", "space-1"): (len(ts), sum(len(t.split()) for t in ts), sum(map(len, ts))) for k, ts in masked.items() if ts}
    assert tokencounts.maintained(frame(spark, []), f"{tmp_path}/none").count() == 0
