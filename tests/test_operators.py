import random

from pyspark.sql import functions as F

from textloom.functions.text import hashed_shingles
from textloom.operators import duplicates, fragmentation, headings, simjoin, stats, tables
from textloom.operators.chunking import chunk_documents, indexed
from textloom.sources.frames import chunk_list, documents_frame


def corpus(spark, *texts):
    return chunk_list(spark, list(texts))[1]


def test_distribution_and_histogram(spark):
    own = corpus(spark, *[f"chunk {i} " * (i + 1) for i in range(10)])
    d = stats.size_distribution(own).first()
    assert d["min"] <= d["median"] <= d["p95"] <= d["max"] and d.n == 10
    bars = stats.size_histogram(own).orderBy("bin").collect()
    assert len(bars) == 12 and sum(b.n for b in bars) == 10
    (flat,) = stats.size_histogram(corpus(spark, "aaa", "bbb")).collect()
    assert (flat.lo, flat.hi, flat.n) == (3, 3, 2)
    assert stats.size_histogram(corpus(spark)).count() == 0


def test_overlap_is_containment_in_the_chunk_before(spark):
    own = corpus(spark, "a b c d e f", "b c d e f", "x y")
    got = {r.doc_index: r.ratio for r in stats.neighbour_overlap(own, 2).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_exact_groups_and_canonical(spark):
    own = corpus(spark, "Same  text", "unique", "same text ", "  ")
    (g,) = duplicates.exact_groups(own).collect()
    assert (g.first_index, g.n) == (0, 2)
    assert {r["index"]: r.canonical for r in duplicates.exact_members(own).collect()} == {0: True, 2: False}


def test_similarity_join_equals_brute_force(spark, monkeypatch):
    """Also where many items share a hash and meet in slices."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))

    def sh(t, k):
        w = t.split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    items = spark.createDataFrame([*enumerate(texts), (75, None), (76, " ")], "id long, text string").repartition(3)
    monkeypatch.setattr(simjoin, "SLICE", 8)
    for k, t in ((2, 0.6), (5, 0.85), (1, 1.0)):
        sets = [sh(x, k) for x in texts]
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
        own = items.select("id", hashed_shingles(F.col("text"), k).alias("s"))
        got = [(r.a, r.b) for r in simjoin.similar_pairs(own, t).collect()]
        assert set(got) == want and len(got) == len(want)
    own = items.select("id", hashed_shingles(F.col("text"), 2).alias("s"))
    assert {(r.a, r.b) for r in simjoin.minhash_pairs(own, 1.0).collect()} >= {(i, j) for i in range(75) for j in range(i + 1, 75) if texts[i] == texts[j]}


def test_near_pairs_stand_for_copies(spark):
    a, b = "the quick brown fox jumps over the lazy dog near the river", "the quick brown fox jumps over the lazy dog near the bank"
    own = corpus(spark, a, b, a, "something else entirely here")
    pairs = duplicates.near_pairs(own, 0.6, 3)
    (p,) = pairs.collect()
    assert (p.a, p.b, p.n_a, p.n_b) == (0, 1, 2, 1)
    assert [(r.i, r.j) for r in duplicates.top_pairs(own, pairs, 20).collect()] == [(0, 1), (1, 2)]
    assert [(r.i, r.j) for r in duplicates.top_pairs(own, pairs, 1).collect()] == [(0, 1)]
    m = duplicates.duplicate_metrics(own, pairs).first()
    assert (m.exact_groups, m.exact_duplicate_chunks, m.near_pairs, m.duplicated, m.nonblank) == (1, 1, 2, 2, 4)


def test_tables(spark):
    split = corpus(spark, "| a | b |\n|---|---|\n| 1 | 2 |", "| 3 | 4 |\n| 5 | 6 |")
    assert tables.broken_boundaries(split).count() == 1
    whole = corpus(spark, "| a | b |\n|---|---|\n| 1 | 2 |", "just prose")
    assert tables.broken_boundaries(whole).count() == 0
    head = corpus(spark, "prose", "| a | b |\n|:--|--:|\n| 1 | 2 |")
    assert tables.broken_boundaries(head).count() == 0


def test_headings(spark):
    fence = "`" * 3
    text = f"pre\n# One\n\n{fence}\n# no\n{fence}\n\n## Two ##\n" + "\n\n".join("p" * 30 for _ in range(6)) + "\r\n### Three\x0bx"
    docs = documents_frame(spark.createDataFrame([(1, text)], "doc_id long, text string"), kind="markdown")
    got = [(r.level, r.title) for r in headings.headings(docs).orderBy("ord").collect()]
    assert got == [(1, "One"), (2, "Two ##"), (3, "Three")]
    own = indexed(chunk_documents(docs, 40, 0))
    spans = {r.title: r.span for r in headings.sections(docs, own).collect()}
    assert spans["Two ##"] == 6 and sum(spans.values()) <= own.count()


def test_fragmentation(spark):
    near = corpus(spark, "Orion one", "Orion two", "Orion three", "nothing")
    assert fragmentation.fragmentation_index(fragmentation.entity_fragmentation(near)).first().cfi == 0.0
    far = corpus(spark, "Orion here", *["plain words"] * 6, "Orion again")
    (top,) = fragmentation.top_entities(fragmentation.entity_fragmentation(far)).collect()
    assert top.entity == "orion" and top.fragmentation > 0.8
    alone = fragmentation.entity_fragmentation(far, 1).where("chunks = 1")
    assert alone.where(F.col("fragmentation") > 0).count() == 0
