import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names():
    e = entry()
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["chunk_size_distribution", "chunk_documents_indexed", "exact_duplicate_groups", "pii_chunks", "entity_fragmentation", "table_boundary_splits", "chunk_multiblock", "chunk_fences", "table_separators", "detector_kinds", "section_spans", "html_to_text_pages", "pragma_directives", "near_duplicate_pairs", "top_near_pairs", "findings_sizes", "findings_duplicates", "findings_no_duplicates", "findings_tables", "findings_headings", "findings_content", "findings_fragmentation", "findings_ordered"])
def test_oracle(spark, name):
    import duckdb

    e = entry()
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "nation", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(e.oracle_sql()[name])
    at = [rel.columns.index(n) for n in names]
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([rounded(r[n]) for n in names]) for r in df.collect())
    assert got == sorted(repr([rounded(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name, scans", [("health_score", 0), ("pragma_filter", 1), ("baseline_antijoin", 1)])
def test_findings_of_rules_come_from_one_pass(spark, name, scans):
    """Their table is made before the query is put together; what is left to read is directives and sources."""
    assert entry().queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == scans


@pytest.fixture
def bare(tmp_path):
    """The repository without the training-data operators."""
    import shutil

    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "textloom"), tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    return tmp_path


def run(at, *args):
    return subprocess.run([sys.executable, *args], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(at)})


def test_imports_without_the_training_data_operators(bare):
    out = run(bare, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(q.startswith('op') for q in e.queries()); assert 'pipeline' not in e.queries(); print('fine')")
    assert out.stdout.strip() == "fine", out.stderr


def test_tests_of_the_rest_run_without_them(bare):
    out = run(bare, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_chunking.py", "tests/test_detectors.py", "tests/test_text_functions.py", "tests/test_operators.py", "tests/test_streaming.py")
    assert out.returncode == 0, out.stdout[-2000:]


def test_a_broken_operator_is_no_absent_one(bare):
    (bare / "textloom" / "llm").mkdir()
    (bare / "textloom" / "llm" / "__init__.py").write_text("import nothing_of_that_name\n")
    out = run(bare, "-c", "import __spark_entry__")
    assert out.returncode and "nothing_of_that_name" in out.stderr
