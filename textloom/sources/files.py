"""Files of many formats as documents and chunks.

Paths of the driver's own disk are listed there, and read by tasks of a local session. Paths with a scheme (hdfs://,
s3a://, file:// ...) are listed and read by Spark, in parallel, wherever it can read; names that begin with "_" are passed
over there, as Spark does with them.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.models import DOCUMENTS
from textloom.operators.chunking import chunk_documents, given_chunks, indexed, numbered, piece_counts
from textloom.session import cut, ship
from textloom.sources import formats

_PARSED = "doc_key long, path string, kind string, raw string, pre_chunked boolean, disabled_rules array<string>, texts array<string>, error string"


def discover(path: str | Path, config: Config) -> list[tuple[str, str]]:
    """(file, path shown) in order; a file is taken as it is, a folder is searched for known suffixes outside hidden parts."""
    root = Path(path)
    if root.is_file():
        return [(str(root), root.name)]
    if not root.is_dir():
        raise FileNotFoundError(str(path))
    wanted, found = {e.lower() for e in config.extensions}, []
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".")]
        found += [Path(folder) / n for n in names if not n.startswith(".") and Path(n).suffix.lower() in wanted]
    found.sort(key=lambda p: (str(p).lower(), str(p)))
    return [(str(p), p.relative_to(root).as_posix()) for p in found]


def _parsed(rows: Iterable[tuple], read, keywords: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """rows: key, file, path shown and what read() makes bytes of; a file at a time."""
    names = [c.split(" ")[0] for c in _PARSED.split(", ")]
    for key, file, path, content in rows:
        try:
            kind, raw, texts, off = formats.parse(Path(file).suffix, read(content), keywords)
            row = (key, path, kind, raw, texts is not None, off, texts, None)
        except Exception as e:  # one unreadable file doesn't end a run
            row = (key, path, None, None, False, [], None, f"{type(e).__name__}: {e}")
        yield pd.DataFrame([row], columns=names)


def parsed_files(spark: SparkSession, files: list[tuple[str, str]], keywords: tuple[str, ...]) -> DataFrame:
    """One row a file of the local disk, in the order given; files that can't be read have an error.

    Only the list of names is made on the driver: contents are read and parsed in tasks.
    """
    ship(spark)
    listed = spark.createDataFrame([(i, f, shown, f) for i, (f, shown) in enumerate(files)], "doc_key long, file string, path string, content string")
    width = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _parsed(batch.itertuples(index=False), lambda f: Path(f).read_bytes(), keywords)

    return listed.repartition(width, "doc_key").mapInPandas(read, _PARSED)


def parsed_store(spark: SparkSession, roots: list[str], config: Config) -> DataFrame:
    """The same for files that Spark lists and reads: in order of roots, then of names without regard to case."""
    ship(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = None
    for i, root in enumerate(roots):
        at = hadoop(root)
        whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        single = F.col("path") == whole
        shown = F.when(single, F.element_at(F.split("path", "/"), -1)).otherwise(F.substr("path", F.lit(len(whole.rstrip("/")) + 2)))
        named = files.select(F.struct(F.lit(i).alias("root"), F.lower(shown).alias("low"), shown.alias("shown")).alias("key"), F.col("path").alias("file"), single.alias("single"), "content")
        ends = F.lower(F.regexp_extract("key.shown", r"\.[^./]*$", 0)).isin(*[e.lower() for e in config.extensions])
        hidden = F.exists(F.split("key.shown", "/"), lambda part: F.startswith(part, F.lit(".")))
        part = named.where(F.col("single") | (ends & ~hidden)).drop("single")
        found = part if found is None else found.unionByName(part)
    firsts = numbered(found.select("key", F.lit(1).cast("long").alias("n")), "key")
    rows = found.join(firsts, "key").select(F.col("first").alias("doc_key"), "file", F.col("key.shown").alias("path"), "content")
    keywords = tuple(config.pragma_keywords)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _parsed(batch.itertuples(index=False), bytes, keywords)

    return rows.mapInPandas(read, _PARSED)


def load(spark: SparkSession, paths: Iterable[str | Path], config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of files and folders as one corpus; files that can't be read are left out with a warning."""
    config, paths = config or Config(), [*map(str, paths)]
    if any("://" in p for p in paths):
        parsed = parsed_store(spark, [p if "://" in p else Path(p).resolve().as_uri() for p in paths], config)
    else:
        parsed = parsed_files(spark, [f for p in paths for f in discover(p, config)], tuple(config.pragma_keywords))
    parsed = cut(parsed)  # read once
    for r in parsed.where("error is not null").select("path", "error").orderBy("path").collect():
        warnings.warn(f"skipped '{r.path}': {r.error}", stacklevel=2)
    good = parsed.where("error is null")
    documents = good.select(*DOCUMENTS.names)
    return documents, indexed(document_chunks(good, config), piece_counts(good, config.chunk_size, config.chunk_overlap))


def document_chunks(documents: DataFrame, config: Config) -> DataFrame:
    """Chunks of documents; those with a column texts that isn't null are chunked already."""
    cut = chunk_documents(documents.where("not pre_chunked"), config.chunk_size, config.chunk_overlap)
    if "texts" not in documents.columns:
        return cut
    given = documents.where("pre_chunked").select("doc_key", F.col("path").alias("source_file"), F.posexplode("texts").alias("doc_index", "text"))
    return cut.unionByName(given_chunks(given))


def html_column(html, closed: bool = False) -> F.Column:
    """Readable text of an HTML column, by the standard library's parser in Arrow batches; closed as for html_to_text()."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else formats.html_to_text(v, closed))

    return read(html)


def directive_column(text, keywords: tuple[str, ...] = ("textloom",)) -> F.Column:
    """array<string>: sorted rule ids that directives in a text disable, "*" for all; the same as formats.disabled_rules()."""
    shape = F.lit("(?i)" + formats.pragma_shape(keywords, r"[\s\x1c-\x1f\x85\xa0]"))
    ids = F.transform(F.regexp_extract_all(text, shape, F.lit(2)), lambda x: F.split(F.upper(x), r"[,\s]+"))
    every = F.zip_with(F.regexp_extract_all(text, shape, F.lit(1)), F.regexp_extract_all(text, shape, F.lit(2)), lambda a, b: (a != "") | (b == ""))
    named = F.flatten(F.zip_with(ids, every, lambda x, e: F.when(e, F.array(F.lit("*"))).otherwise(F.filter(x, lambda y: y != ""))))
    return F.array_sort(F.array_distinct(named))


def json_column(value) -> F.Column:
    """array<string>: texts of a JSON document; null if it can't be parsed."""
    import json

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else formats.json_texts(json.loads(v))
            except ValueError:
                return None

        return values.map(one)

    return read(value)


def csv_column(value, delimiter: str = ",") -> F.Column:
    """array<string>: rows of a CSV document as texts."""

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else formats.csv_texts(v, delimiter))

    return read(value)
