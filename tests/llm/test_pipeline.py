import os
import random

import pytest

from tests.llm.data import frame, labels, texts
from tests.llm.test_text_operators import leaks_brute, lines_brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    words = ["v" + a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(100 + i, prose(60)) for i in range(80)]
    rows = [(i, t + " grobbelkopf") if i % 4 == 0 else (i, t) for i, t in rows]
    leak = prose(25)
    rows += [(300, rows[1][1]), (301, "begin " + leak + " end"), (302, "the one line that three share\nA " + prose(40)), (303, "the one line that three share\nB " + prose(40)), (304, "the one line that three share\nC " + prose(40))]
    rows += texts()
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(100, 180)]).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, leak


def test_stages(spark, tables, tmp_path):
    import corpus_pipeline as p

    at, rows, leak = tables
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, at)
        if name != "bpe":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()) if name != "bpe" else docs.count()
    ids = {n: {i for i, _ in k} for n, k in kept.items() if n != "bpe"}
    assert all(i not in ids["toxicity"] for i in range(100, 180, 4)) and {101, 102, 300, 301, 303} <= ids["toxicity"]
    brute = {b[0]: b[2] for b in lines_brute([r for r in rows if r[0] is not None and r[0] not in range(100, 180, 4)], 20, 3)}
    texts_ = {}
    for i, t in kept["line_dedup"]:
        texts_.setdefault(i, t)
    assert all("\n" not in texts_[i] for i in (302, 303)) and "\n" in texts_[304] and brute[302] == 1
    assert 101 in ids["near_dedup"] and 300 not in ids["near_dedup"]
    leaks = {b[0] for b in leaks_brute(kept["near_dedup"], [(1, leak)], 10) if b[-1]}
    assert leaks == {301} and ids["decontamination"] == ids["near_dedup"] - leaks
    assert kept["bpe"] >= len(ids["decontamination"])


def test_run_and_empty_tables(spark, tables, tmp_path):
    import corpus_pipeline as p

    at, _, _ = tables
    out = p.run(spark, at)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)


def test_a_run_that_failed_goes_on(spark, tables, tmp_path, monkeypatch):
    import corpus_pipeline as p

    at, _, _ = tables
    want = sorted(p.run(spark, at).collect(), key=str)
    calls: list[str] = []

    def watched(name, stage, fails):
        def run(*args):
            calls.append(name)
            if fails and name == "near_dedup":
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    stages = list(p.STAGES)
    monkeypatch.setattr(p, "STAGES", [watched(n, f, True) for n, f in stages])
    with pytest.raises(RuntimeError):
        p.run(spark, at, f"{tmp_path}/kept")
    monkeypatch.setattr(p, "STAGES", [watched(n, f, False) for n, f in stages])
    got = p.run(spark, at, f"{tmp_path}/kept")
    assert sorted(got.collect(), key=str) == want
    assert calls == ["toxicity", "line_dedup", "near_dedup", "near_dedup", "decontamination", "bpe"]
    assert os.listdir(f"{tmp_path}/kept") == ["3-decontamination"]
