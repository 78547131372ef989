import random
import zlib

import numpy as np
import pytest

from tests.llm.data import AZ, SCHEMA, SPACE_WORD, frame, key, labels, texts
from textloom.llm import quality, simhash, toxicity, urlfilter
from textloom.llm.components import components


def fingerprint_brute(t):
    import xxhash

    w = SPACE_WORD.findall((t or "").translate(AZ))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass"), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(ids, fps, distance):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = top(ids[a]), top(ids[b])
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in ids]


@pytest.mark.parametrize("distance", [3, 0, 20])
def test_simhash(spark, distance):
    rows = texts()
    fps = [fingerprint_brute(t) for _, t in rows]
    ids = [key(i) for i, _ in rows]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), components_brute(ids, fps, distance)))
    got = simhash.near_duplicates(frame(spark, rows), distance=distance)
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in got.collect()) == want


def test_large_group_of_near_fingerprints(spark, monkeypatch):
    """Over GROUP fingerprints under one key: slices meet in pairs, and no link is lost."""
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    links = simhash.links(distinct, 3)
    got = {r.v: r.component for r in components(distinct.selectExpr("rep as v"), links).collect()}
    assert [got[i] for i in range(len(fps))] == components_brute(list(range(len(fps))), fps, 3)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5)], "a long, b long")
    got = components(spark.range(n + 2).selectExpr("id as v"), links).collect()
    assert {r.v: r.component for r in got} == {i: 0 if i < n else i for i in range(n + 2)}


def test_components_of_stars_and_odd_links(spark):
    """A centre that many vertices name is a hot key; loops, repeats and null ends are no links."""
    pairs = [(7, i) for i in range(100, 500)] + [(900 - i, 900) for i in range(1, 300)] + [(3, 3), (None, 4), (4, None), (7, 100), (499, 620)]
    got = components(spark.range(1000).selectExpr("id as v"), spark.createDataFrame(pairs, "a long, b long")).collect()
    one = {7, *range(100, 500), *range(601, 901)}
    assert {r.v: r.component for r in got} == {i: 7 if i in one else i for i in range(1000)}
    assert components(spark.range(0).selectExpr("id as v"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join(spark):
    from textloom.llm import common

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k long, x long")
    table = spark.createDataFrame([(i, i * 10) for i in range(0, 600, 2)] + [(1, 5), (None, 9)], "k long, y long")
    assert common.hot_keys(rows, "k") == [1]
    for how in ("left", "inner"):
        assert sorted(common.spread_join(rows, table, "k", how).collect(), key=str) == sorted(rows.join(table, "k", how).collect(), key=str)


def test_bit_counts():
    h = np.random.default_rng(0).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    assert simhash.bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def labelled(n=400):
    rng = random.Random(4)
    good = ["w" + a + b + c for a in "abcdefgh" for b in "ijklmn" for c in "opqrstu"]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(40)]
        junk, toxic = rng.random() < 0.4, rng.random() < 0.3
        if junk:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        if toxic:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(["grobbelkopf", "idiotling"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(not junk), int(toxic)))
    return rows, marks


def rest(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_quality(spark):
    rows, marks = labelled()
    docs, told = frame(spark, rows + texts()[-12:]), labels(spark, marks + [(None, 1, 0), (5, None, None)])
    model = quality.fit(docs, told)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect() if r.doc_id is not None and r.doc_id < 400}
    truth = dict((i, q) for i, q, _ in marks)
    out = [i for i in truth if got[i].held_out and i >= 54]
    assert out and all(got[i].held_out == (rest(i, 4) == 2) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.95
    # Held-out labels have no part in the model.
    flipped = labels(spark, [(i, 1 - q if rest(i, 4) == 2 else q, t) for i, q, t in marks])
    assert np.array_equal(quality.fit(docs, flipped).w, quality.fit(docs, labels(spark, marks)).w)
    assert quality.fit(docs, labels(spark, [])).score(*quality.features("")) == pytest.approx(0.5)
    assert quality.scored(frame(spark, []), model).count() == 0
    # Rows and labels that repeat an id are learnt from once; metadata can be absent, and null, and of any type.
    twice = quality.fit(frame(spark, rows + rows[:90]), labels(spark, marks + marks[:70]))
    assert np.array_equal(twice.w, quality.fit(frame(spark, rows), labels(spark, marks)).w)
    bare = docs.select("doc_id", "text")
    assert quality.scored(bare, quality.fit(bare, told), metadata=("n_chars", "page")).count() == docs.count()


def test_metadata_take_part(spark):
    rows = [(i, "the same words in every text", "en", f"s{i % 2}", None if i % 7 == 0 else 10 + 90_000 * (i % 2), "", "", "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = labels(spark, [(i, i % 2, 0) for i in range(300)])
    for metadata, right in ((("n_chars",), 0.8), (("fp",), 0.0)):
        got = quality.scored(docs, quality.fit(docs, told, metadata=metadata), 0.5, metadata).collect()
        share = np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id % 7])
        assert share > 0.95 if right else share < 0.7


def test_machine_is_linear_time_form_of_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorizationMachine(0.3, rng.normal(size=quality.N_FEATURES).astype(np.float32), rng.normal(0, 0.2, (quality.N_FEATURES, 4)).astype(np.float32))
    index, value = np.array([1, 7, 30]), np.array([0.5, -1.0, 2.0])
    z = 0.3 + m.w[index] @ value + sum(float(m.v[index[i]] @ m.v[index[j]]) * value[i] * value[j] for i in range(3) for j in range(i + 1, 3))
    assert m.score(index, value) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_toxicity(spark):
    rows, marks = labelled()
    docs, told = frame(spark, rows), labels(spark, marks)
    scorer = toxicity.learn(docs, told)
    assert {"grobbelkopf", "idiotling"} <= set(scorer.terms) and not any(t.startswith("w") for t in scorer.terms)
    got = {r.doc_id: r for r in toxicity.judged(docs, scorer).collect()}
    assert all(got[i].held_out == (rest(i, 5) == 0) for i, _, _ in marks)
    assert np.mean([got[i].predicted == t for i, _, t in marks if got[i].held_out]) > 0.95
    odd = {r.doc_id: r for r in toxicity.scored(frame(spark, [(1, "you grobelkopf and idjotling and grobbelkopff"), (2, 'he quoted the word "grobbelkopf" here'), (3, None), (4, "plain")]), scorer).collect()}
    assert [h.edits for h in odd[1].hits] == [1, 1, 1] and odd[1].predicted == 1
    assert odd[2].hits[0].mentioned and odd[2].predicted == 0
    assert odd[3].predicted == odd[4].predicted == 0 and odd[3].hits == []
    nobody = toxicity.learn(docs, labels(spark, []))
    assert toxicity.judged(docs, nobody).where("predicted = 1").count() == 0
    assert toxicity.judged(frame(spark, []), scorer).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["clown", "worthless", "disgusting", "abcdefghijkl", "abc", "aaaaabaaaaa", "abababababab"]
    trie = toxicity.LexiconTrie(terms)
    for limit in (0, 1, 2, 3):
        table = toxicity.LevenshteinTable(limit)
        for _ in range(700):
            word, other = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
            base, state = 0, table.START
            for c in other:
                base, state = table.step(state, word, base, c)
            want = edit_distance(word, other)
            assert table.edits(state, len(word) - base) == (want if want <= limit else None), (word, other)
    for _ in range(1500):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "s", "a"])
        word = "".join(word)
        near = sorted((edit_distance(word, t), t) for t in terms if edit_distance(word, t) <= toxicity.edits_allowed(t))
        want = (near[0][1], near[0][0]) if near and (len(word) >= 4 or near[0][0] == 0) else None
        assert trie.nearest(word) == want, word


def test_every_term_and_ordinary_word_of_the_sample_counts(spark):
    """No number of terms is too many, and ordinary words near terms are no misspellings, however rare."""
    letters = "bcdfghklmnprstvz"
    terms = [a + "o" + b + "i" + c + d + "axu" for a in letters for b in letters for c in letters[:8] for d in "eou"]
    rows, marks = [], []
    for i, at in enumerate(range(0, len(terms), 64)):
        for copy in range(14):
            key_ = 100_000 + 14 * i + copy
            rows.append((key_, " ".join([*(f"x{'abcdefghijklmn'[copy]}{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)), *terms[at : at + 64]])))
            marks.append((key_, 1, 1))
    rows += [(i, "quiet words " + ("zozibeaxx" if i < 40 else "more")) for i in range(9000)]
    rows = [(i, t if i >= 100_000 else t + "".join(f" o{a}{b}{c}" for a in "ab" for b, c in [(chr(97 + i % 26), chr(97 + i // 26 % 26) + chr(97 + i // 676))])) for i, t in rows]
    marks += [(i, 1, 0) for i in range(9000)]
    scorer = toxicity.learn(frame(spark, rows), labels(spark, marks))
    assert set(terms) <= set(scorer.terms) and len(terms) > 5000
    assert scorer.match("zozibeaxx") is None and scorer.match("zozibeaxuu") == ("zozibeaxu", 1)


def test_toxicity_of_long_and_repeated_rows(spark):
    rows, marks = labelled(200)
    docs = frame(spark, rows + rows[:50] + [(5, "another text of that id"), (9_000, "w " * 40_000 + "grobbelkopf idiotling grobbelkopf"), (9_000, "w " * 40_000 + "grobbelkopf idiotling grobbelkopf")])
    scorer = toxicity.learn(docs, labels(spark, marks + marks[:30]))
    once = toxicity.learn(frame(spark, rows), labels(spark, marks))
    assert scorer.terms.keys() == once.terms.keys()
    got = [(r.score, r.predicted) for r in toxicity.judged(docs, scorer).where("doc_id = 9000").collect()]
    assert len(got) == 2 and got[0] == got[1] and got[0][1] == 1


URLS = [
    ("http://a.net/x", "net/", "block"), ("http://example.net/en/y", "example.net/en/", "allow"), ("http://m.EXAMPLE.net/en", "net/", "block"), ("https://x.example.com/de/?q=/en/", "example.com/de/", "block"),
    ("http://example.com/fr/", None, "allow"), ("http://q.org/fr/1#a", "org/fr/", "allow"), ("http://net", None, "allow"), ("http://net/", "net/", "block"), ("http://net?x/", None, "allow"), ("notaurl", None, "allow"),
    ("", None, "allow"), (None, None, "allow"), ("x://y.net:80/", None, "allow"), ("http://planet/", None, "allow"), ("://a.net//en/", "net/", "block"), ("http://a.net/x", "net/", "block"),
]


@pytest.mark.parametrize("by_join", [False, True])
def test_url_filter(spark, by_join):
    def judge(pages, rules=urlfilter.RULES):
        if not by_join:
            return urlfilter.judge(pages, rules)
        return urlfilter.judge_by_join(pages, spark.createDataFrame(list(rules), "action string, rule string"))

    pages = spark.createDataFrame([(i, u, "h", "p") for i, (u, _, _) in enumerate(URLS)] + [(None, URLS[0][0], "h", "p"), (99, "http://" + "l." * 5000 + "net/" + "a/" * 20_000, "h", "p")], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in judge(pages).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(URLS))] == [(r, v) for _, r, v in URLS]
    assert (got[None].rule, got[99].rule, len(got[99].path)) == ("net/", "net/", 40_001)
    assert (got[3].host, got[3].path, got[9].host, got[11].path) == ("x.example.com", "/de/", "", "")
    tie = judge(pages, [("allow", "net/"), ("block", "net/"), ("block", "a.net/xyz"), ("block", "net/en/a")])
    assert {r.page_id: r.verdict for r in tie.collect()}[0] == "block"
    assert judge(pages.limit(0)).count() == 0
    assert judge(pages, []).where("verdict = 'allow'").count() == len(URLS) + 2


def test_rules_beyond_the_broadcast_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_RULES", 1)
    with pytest.raises(ValueError, match="judge_by_join"):
        urlfilter.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"))
