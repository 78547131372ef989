import random

import pytest

from textloom.operators.chunking import chunk_documents, indexed, piece_counts, pieces
from textloom.sources.frames import documents_frame

FENCE = "`" * 3


def chunked(spark, text, size=120, overlap=0):
    docs = documents_frame(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    return chunk_documents(docs, size, overlap).orderBy("doc_index").collect()


def test_empty_and_tiny(spark):
    assert chunked(spark, "") == [] and chunked(spark, " \n \n") == []
    (only,) = chunked(spark, "One sentence.")
    assert (only.text, only.char_start, only.start_line) == ("One sentence.", 0, 1)


def test_paragraphs_pack_and_spans_hold_text(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 6 for i in range(10))
    rows = chunked(spark, text)
    assert len(rows) > 1
    for r in rows:
        assert text[r.char_start : r.char_end] in r.text
        assert r.start_line == text.count("\n", 0, r.char_start) + 1


def test_hard_split(spark):
    rows = chunked(spark, "x" * 1000, 100, 0)
    assert len(rows) == 10 and all(r.char_end - r.char_start == 100 for r in rows)


def test_overlap(spark):
    rows = chunked(spark, "\n\n".join("sentence number %d goes here and on" % i * 2 for i in range(6)), 120, 40)
    assert all(len(r.text) > r.char_end - r.char_start for r in rows[1:])


def test_fences_keep_blank_lines(spark):
    text = f"intro\n{FENCE}\ncode\n\nmore\n{FENCE}\ntail\n\nnext"
    rows = chunked(spark, text, 30, 0)
    assert [r.text for r in rows] == [text[: text.index("\n\nnext")], "next"]
    assert len(chunked(spark, f"{FENCE}\nopen\n\n\nend", 100, 0)) == 1


def reference(text, size, overlap):
    """The rules once more, line by line."""
    out, begin, end, fenced, at = [], None, 0, False, 0
    lines = text.split("\n")
    if len(lines) > 1 and lines[-1] == "":
        lines.pop()
    spans = []
    for line in lines:
        s, e = at, at + len(line)
        at = e + 1
        fence = line.lstrip()[:3] in (FENCE, "~~~")
        if fenced:
            end = e
            fenced = not fence
        elif not line.strip():
            if begin is not None:
                spans.append((begin, end))
            begin = None
        else:
            begin = s if begin is None else begin
            end, fenced = e, fence
    if begin is not None:
        spans.append((begin, end))
    cut = [(a, min(a + size, e)) for s, e in spans for a in range(s, e, size)]
    for s, e in cut:
        if out and out[-1][1] - out[-1][0] + e - s <= size:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    texts, before = [], ""
    for s, e in out:
        head = before[-overlap:] + "\n" if overlap and before else ""
        texts.append((head + text[s:e], s, e, len(head)))
        before = text[s:e]
    return texts


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (25, 30)])
def test_native_and_fold_agree(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["a", "bc ", "\n", "\n\n", FENCE + "\n", " ", "~~~"]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    docs = documents_frame(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {}
    for r in chunk_documents(docs, size, overlap).orderBy("doc_key", "doc_index").collect():
        got.setdefault(r.doc_key, []).append((r.text, r.char_start, r.char_end))
    for i, t in enumerate(texts):
        want = reference(t, size, overlap)
        assert pieces(t, size, overlap) == want, repr(t)
        assert got.get(i, []) == [w[:3] for w in want], repr(t)


def test_index_is_dense_whatever_the_partitions(spark):
    rows = [(i, "word " * (i % 7 * 20 + 1)) for i in range(40)]
    docs = documents_frame(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = indexed(chunk_documents(docs, 100, 10)).orderBy("doc_key", "doc_index").collect()
    assert [r["index"] for r in got] == list(range(len(got)))
    counts = {r.doc_key: r.n for r in piece_counts(docs, 100, 10).collect()}
    assert counts == {k: sum(r.doc_key == k for r in got) for k in range(40)}
    again = indexed(chunk_documents(docs, 100, 10).select("doc_key", "doc_index"), piece_counts(docs, 100, 10))
    assert {(r.doc_key, r.doc_index, r["index"]) for r in again.collect()} == {(r.doc_key, r.doc_index, r["index"]) for r in got}


def test_index_of_null_and_repeated_keys(spark):
    rows = [(None, "a" * 25), (2, "b" * 25), (2, "c" * 35), (None, "d"), (1, None), (3, ""), (4, "x\n\n\ny" * 9), (2, "b" * 25)]
    docs = documents_frame(spark.createDataFrame(rows, "doc_id long, text string"))
    own = chunk_documents(docs, 10, 0)
    for counts in (None, piece_counts(docs, 10, 0)):
        got = indexed(own, counts).orderBy("index").collect()
        assert [r["index"] for r in got] == list(range(own.count()))
        assert [r.doc_key for r in got] == sorted((r.doc_key for r in got), key=lambda k: (k is not None, k))
    assert indexed(own.limit(0)).count() == 0
