import json

import pytest

from textloom.baseline import fingerprint, load_baseline, save_baseline
from textloom.config import Config
from textloom.engine import analyze_chunks, analyze_path, compare, worst_severity
from textloom.models import Finding, Location, Severity
from textloom.plans import postfilter
from textloom.reports import FORMATS, render
from textloom.rules import Rule, get_rule, register_rule
from textloom.scoring import compute_health
from textloom.sources import formats
from textloom.sources.frames import pasted


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    (at / "a.md").write_text("# Title\n\n" + "\n\n".join(f"Paragraph {i} about the Orion system. " * 5 for i in range(4)), encoding="utf-8")
    (at / "_b.txt").write_text("password = 'abcdefghijklmnop1234'\nmail me@example.com", encoding="utf-8")
    (at / "c.json").write_text(json.dumps({"chunks": [{"text": "alpha one"}, {"content": "beta two"}, {"x": 1}]}), encoding="utf-8")
    (at / "d.csv").write_text("name,role\nAda,engineer\nBob,\n", encoding="utf-8")
    (at / "e.html").write_text("<p>Hello <b>there</b></p><script>var x</script>", encoding="utf-8")
    (at / "f.jsonl").write_text('{"text":"one"}\n\nbroken\n{"body":"two"}\n', encoding="utf-8")
    (at / "bad.json").write_text("{", encoding="utf-8")
    (at / "g.md").write_text("<!-- textloom: disable=CTX008, CTX002 -->\nwrite to you@example.org", encoding="utf-8")
    (at / "skip.py").write_text("x")
    (at / ".hidden.md").write_text("x")
    return at


@pytest.fixture(scope="module")
def report(spark, folder):
    with pytest.warns(UserWarning, match="bad.json"):
        return analyze_path(folder, spark=spark)


def test_files(report):
    assert report.files_analyzed == 7
    files = {x.file for f in report.findings for x in f.locations}
    assert "_b.txt" in files and ".hidden.md" not in files
    rules = {f.rule_id for f in report.findings}
    assert {"CTX002", "CTX007", "CTX008"} <= rules
    pii = next(f for f in report.findings if f.rule_id == "CTX008")
    assert {x.file for x in pii.locations} == {"_b.txt"}  # g.md disables the rule
    ranks = [f.severity.rank for f in report.findings]
    assert ranks == sorted(ranks, reverse=True)
    assert worst_severity(report) is Severity.ERROR
    assert "abcdefghijklmnop1234" not in render(report, "json")


@pytest.mark.parametrize("fmt", FORMATS)
def test_reports(report, fmt):
    text = render(report, fmt)
    assert text
    if fmt in ("json", "sarif", "badge"):
        data = json.loads(text)
        if fmt == "sarif":
            run = data["runs"][0]
            assert {r["id"] for r in run["tool"]["driver"]["rules"]} >= {f"CTX{i:03}" for i in range(1, 11)}
            places = [p["physicalLocation"] for r in run["results"] for p in r.get("locations", [])]
            assert all(p["region"]["startLine"] >= 1 for p in places if "region" in p) and any("region" not in p for p in places)
            assert all(r["message"]["text"].endswith(f.recommendation) for r, f in zip(run["results"], report.findings))
        if fmt == "json":
            assert {f["rule"] for f in data["findings"]} == {f.rule_id for f in report.findings}
    if fmt == "html":
        assert "<script" not in text


def test_unknown_format(report):
    with pytest.raises(ValueError, match="Unknown report format"):
        render(report, "nope")


def test_baseline(spark, folder, report, tmp_path):
    path = tmp_path / "b.json"
    assert save_baseline(report, path) == len({fingerprint(f) for f in report.findings})
    stored = json.loads(path.read_text())
    assert (stored["tool"], stored["generated_at"], stored["count"]) == ("textloom", report.generated_at, len(stored["fingerprints"]))
    with pytest.warns(UserWarning):
        again = analyze_path(folder, baseline=load_baseline(path), spark=spark)
    assert again.findings == [] and again.health_score == 100 and again.baseline_suppressed == len(report.findings)
    assert compare(report, again)["health"] == 100 - report.health_score
    table = spark.createDataFrame([("CTX001", [("b", None, None, None), ("a", None, None, None), ("b", None, None, None)]), ("CTX006", [])], "rule_id string, locations array<struct<file:string,chunk_id:string,line:int,detail:string>>")
    want = [fingerprint(Finding("CTX001", Severity.INFO, "", locations=[Location("a"), Location("b")])), fingerprint(Finding("CTX006", Severity.INFO, ""))]
    assert [r[0] for r in table.select(postfilter.fingerprint()).collect()] == want


def test_chunk_lists_and_settings(spark):
    texts = ["x" * 500, {"text": "y" * 5}, {"page_content": "z" * 60}, {"no": 1}]
    cfg = Config(max_chunk_chars=100, min_chunk_chars=20, ignore=("CTX002",), severity={"CTX001": "info"})
    r = analyze_chunks(texts, cfg, spark=spark)
    assert r.total_chunks == 3 and [(f.rule_id, f.severity) for f in r.findings] == [("CTX001", Severity.INFO)]
    assert r.metrics["chunk_stats"]["oversized_count"] == 1 and r.metrics["chunk_stats"]["undersized_count"] == 1
    with pytest.raises(ValueError):
        analyze_chunks(["x"], Config(severity={"CTX001": "loud"}), spark=spark)


def test_empty_corpus(spark, tmp_path):
    r = analyze_path(tmp_path, spark=spark)
    assert (r.files_analyzed, r.total_chunks, r.findings, r.health_score) == (0, 0, [], 100)


def test_plugin(spark, tmp_path):
    file = tmp_path / "marker.py"
    file.write_text(
        "from pyspark.sql import functions as F\nfrom textloom.models import Severity\nfrom textloom.plans.analyzers import ChunkRuleAnalyzer\nfrom textloom.rules import Rule, register_rule\n"
        "register_rule(Rule('PLG001', 'marker', 'plugin', Severity.WARNING, 'a marker', 'remove it'))\n"
        "class Marker(ChunkRuleAnalyzer):\n    name = 'marker'\n    rule_id = 'PLG001'\n    def predicate(self):\n        return F.contains('text', F.lit('MARK'))\n"
    )
    with pytest.warns(UserWarning, match="absent"):
        r = analyze_chunks(["here is a MARK " * 20, "nothing at all " * 20], Config(plugins=(str(file), "absent_module")), spark=spark)
    assert [f.rule_id for f in r.findings] == ["PLG001"] and r.metrics["marker"] == {"chunks": 1}


def test_rules_and_score():
    assert not register_rule(Rule("CTX001", "x", "y", Severity.INFO, "", ""))
    assert get_rule("NEW9").category == "plugin"
    f = lambda s: Finding("R", s, "")
    assert compute_health([]).score == 100 and (compute_health([]).grade, compute_health([]).label) == ("A+", "pristine")
    assert compute_health([f(Severity.ERROR)] + [f(Severity.WARNING)] * 5).score == 69
    assert compute_health([f(Severity.ERROR), f(Severity.WARNING)]).grade == "B"


def test_formats():
    assert formats.html_to_text("<head><p>x</p></head><p>a &amp; b</p><style>s</style>c") == "a & b\nc"
    assert formats.json_texts(["a", {"text": "b"}, {"text": " "}]) == ["a", "b"]
    assert formats.json_texts({"documents": [{"chunks": ["x", {"body": "y"}]}]}) == ["x", "y"]
    assert formats.json_texts({"content": "z"}) == ["z"] and formats.json_texts([[1]]) == []
    page = "<!doctype html><HEAD><title>t</title></HEAD>\n<body>one<br/>two  \t<div>three</div>\n\n\n<ul><li>a</li><li>b &lt;c&gt;</ul><svg>no<p>no</p></svg><script>if (a < b) {}</script> end"
    assert formats.html_to_text(page) == "one\n\ntwo\nthree\n\na\n\nb <c>\n\n end"
    assert formats.html_to_text("") == formats.html_to_text("<script>x") == formats.html_to_text(" <p> \n</p> ") == ""
    assert formats.html_to_text("</svg>a<template>b<template>c</template>d</template>e") == "ae"
    assert formats.csv_texts("") == formats.csv_texts("\n , \n") == []
    assert formats.csv_texts('a\tb\n"x\ty"\t\n', "\t") == ["a: x\ty"]
    assert formats.csv_texts("name,role\nAda,engineer,extra\n,\n") == ["name: Ada\nrole: engineer\ncol3: extra"]
    assert formats.csv_texts("only, row\n") == ["only | row"]
    assert formats.jsonl_texts('{"text":"a"}\nx\n\n{"n":1}\n') == ["a"]
    assert formats.disabled_rules("textloom: disable=ctx007, CTX003; TEXTLOOM:disable-all") == ["*", "CTX003", "CTX007"]
    assert formats.disabled_rules("textloom: disable") == ["*"] and formats.disabled_rules("none") == []
    assert pasted("one\n\n two ") == ["one", "two"] and pasted('["a", {"text": "b"}]') == ["a", "b"]


def test_html_references_without_a_semicolon(spark):
    from textloom.sources.files import html_column

    page = "<h1>and&amp</h1>&amp;amp &#65; &#x41; &#65 &notit; &bogus; & &amp;\ue000<xmp>&amp</xmp>"
    assert formats.html_to_text("<h1>and&amp</h1>") == "and&"  # as browsers read it
    assert formats.html_to_text(page, closed=True) == "and&amp\n&amp A A &#65 &notit; &bogus; & &\ue000&amp"
    assert spark.createDataFrame([(page,)], "h string").select(html_column("h", closed=True)).first()[0] == formats.html_to_text(page, closed=True)


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.textloom]\nchunk_size = 7\nselect = ["A"]\nunknown = 1\n')
    inner = tmp_path / "in"
    inner.mkdir()
    assert Config.discover(inner).chunk_size == 7 and Config.discover(inner).select == ("A",)
    (tmp_path / ".textloom.json").write_text('{"chunk_size": 9}')
    assert Config.discover(inner).chunk_size == 9


def test_cli(spark, folder, tmp_path, capsys):
    from textloom.cli import main

    assert main(["analyze", str(tmp_path / "absent")]) == 2
    out = tmp_path / "r.json"
    with pytest.warns(UserWarning):
        assert main(["analyze", str(folder), "-f", "json", "-o", str(out), "--fail-on", "error"]) == 1
    assert json.loads(out.read_text())["summary"]["files_analyzed"] == 7
    assert main(["rules"]) == 0 and "CTX010" in capsys.readouterr().out


def test_a_store_that_spark_reads(spark, folder, report):
    """The same by a path with a scheme; Spark passes over names with _ at the start."""
    with pytest.warns(UserWarning, match="bad.json"):
        stored = analyze_path(folder.as_uri(), spark=spark)
    assert stored.files_analyzed == report.files_analyzed - 1
    files = [{x.file for f in r.findings for x in f.locations} for r in (report, stored)]
    assert files[1] <= files[0] and files[0] - files[1] <= {"_b.txt"}
    one = analyze_path((folder / "d.csv").as_uri(), spark=spark)
    assert (one.files_analyzed, one.total_chunks) == (1, 2)


def test_chunks_of_documents_with_any_key(spark):
    rows = [("b", 1, "second of b, TODO"), ("a", 0, "only of a"), ("b", 0, "first of b"), (None, 0, "of nobody"), ("c", 0, None), (None, 1, "of nobody too")]
    df = spark.createDataFrame(rows, "doc string, pos long, text string")
    report = analyze_chunks(df, Config(min_chunk_chars=1000), doc_col="doc", order_col="pos", spark=spark)
    assert (report.files_analyzed, report.total_chunks) == (3, 5)
    (small,) = report.findings
    assert [x.chunk_id for x in small.locations] == ["chunks-#0", "chunks-#1", "chunks-a#0", "chunks-b#0", "chunks-b#1"]


def test_findings_stay_a_table(spark):
    from textloom.engine import analyze_corpus
    from textloom.sources.frames import chunk_list

    documents, chunks = chunk_list(spark, ["same words here", "same words here", "| a | b |\n|--|--|", "| c | d |"])
    found = analyze_corpus("here", documents, chunks, Config())
    report = found.report()
    assert found.findings.count() == len(report.findings) and found.health() == compute_health(report.findings)
