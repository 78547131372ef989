"""A training-data pipeline of five stages, each written as Parquet before the next one reads it.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents, others that
came with them included. A document is a row; rows that repeat an id are judged alike and stay or go together, except
that the near-duplicate stage keeps one row of each group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, linededup, simhash, toxicity
from textloom.llm.common import NULL_ID
from textloom.llm.queries import table, vocabulary
from textloom.session import checkpoint_dir


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names, which docs doesn't have: the id without null and a hash of the text, as operators key rows."""
    names = []
    for name in ("__row_id", "__row_text"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(names[0])
    row_text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(names[1])
    return docs.select("*", row_id, row_text), *names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 8 predicts to be toxic go."""
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.scored(docs, scorer, keep=tuple(docs.columns))
    return judged.where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that operator 3 drops; n_chars follows the text. Documents whose every line went go too."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = linededup.kept_lines(docs, extra=others)
    left = kept.where((F.col("n_dropped") < F.col("n_lines")))
    rows = left.select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"), *others)
    return rows.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of operator 4, the document with the smallest id stays; of rows with that id, one."""
    groups = simhash.near_duplicates(docs)
    marked, row_id, row_text = _keyed(docs)
    stays = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).groupBy(F.col("__id").alias(row_id)).agg(F.min("__th").alias(row_text))
    return marked.join(stays, [row_id, row_text]).dropDuplicates([row_id]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item, by operator 10, go."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    marked, row_id, row_text = _keyed(docs)
    gone = found.where(F.size("spans") > 0).select(F.col("__id").alias(row_id), F.col("__th").alias(row_text)).distinct()
    return marked.join(gone, [row_id, row_text], "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of operator 1."""
    return bpe.digests(bpe.encode(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has neither the classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next.

    folder: where stages are kept, if a run that fails is to be gone on with: a stage that is complete there isn't run
    again. It belongs to one sf_dir. A stage's rows go when the next stage's are complete, so one copy stays.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = folder or f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    written = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    first = max((k + 1 for k, at in enumerate(written) if files.exists(hadoop(f"{at}/_SUCCESS"))), default=0)
    docs = spark.read.parquet(written[first - 1]) if first else table(spark, sf_dir, "documents")
    for k in range(first, len(written)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(written[k])
        docs = spark.read.parquet(written[k])
        if k:
            files.delete(hadoop(written[k - 1]), True)
    return STAGES[-1][1](spark, docs, sf_dir)
