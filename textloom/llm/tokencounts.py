"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document's counts, a delete
takes them away, a revision takes the old and adds the new. A batch of changes is summed by key before it is stored.

The store is a folder that only ever gains files:
  deltas/<folder>          the sums of one attempt at a batch, or of several batches folded into one
  commits/<batch>@<folder> an empty file, created at once or not at all: the batch counts, by this folder
  folds/<number>@<folder>  the same for a fold; deltas/<folder>-batches lists the batches that it stands for
An attempt that fails before its file is there leaves nothing that counts. A batch counts once: if several attempts get
as far, the first folder by name counts, and as attempts at a batch carry the same rows, it doesn't matter which. Totals
are the latest fold and the batches that it doesn't stand for. As no file is moved or changed, readers, writers and folds
at once don't harm each other, and a fold that fails or is beaten by another costs nothing but its folder.

Defined results: null texts count as empty documents; null sources, languages and versions are keys of their own.
Repeated rows each count. A key whose sums are all zero has no row. An empty store has no totals.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import SPACE
from textloom.session import checkpoint_dir

KEYS = ("source", "lang", "tokenizer_version")
MEASURES = ("n_docs", "n_tokens", "n_chars")
INSERT, DELETE = 1, -1


def space_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def words_and_marks(text: Column) -> Column:
    """Runs of ASCII letters and digits and of non-ASCII characters, and each other visible character."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]")).cast("long")


#: Tokenizer version: how it counts a text.
TOKENIZERS = {"space-1": space_words, "marks-2": words_and_marks}


def changes(docs: DataFrame, version: str, sign: int = INSERT, text_col: str = "text") -> DataFrame:
    """Signed rows of documents: source, lang, tokenizer_version, n_docs, n_tokens, n_chars."""
    text = F.col(text_col)
    return docs.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (TOKENIZERS[version](text) * sign).alias("n_tokens"), (F.length(F.coalesce(text, F.lit(""))) * sign).cast("long").alias("n_chars"))


def summed(rows: DataFrame) -> DataFrame:
    """Sums by key; a hot source is summed in every task before anything is shuffled."""
    return rows.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES]).where(" or ".join(f"{m} <> 0" for m in MEASURES))


class Rollup:
    """A store of deltas in a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop("/".join([self.path, *names]))

    def _marks(self, kind: str) -> list[tuple[str, str]]:
        """(name, folder) of the files under commits or folds, in order of folders from the last."""
        root = self._at(kind)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted((tuple(n.split("@", 1)) for n in names if "@" in n and not n.startswith(".")), key=lambda x: x[1], reverse=True)

    def _mark(self, kind: str, name: str, folder: str) -> None:
        self._fs.mkdirs(self._at(kind))
        self._fs.createNewFile(self._at(kind, f"{name}@{folder}"))

    def committed(self) -> dict[str, str]:
        """Batch id: folder of the deltas that count."""
        return dict(self._marks("commits"))

    def folded(self) -> tuple[int, str | None, set[str]]:
        """(number, folder, batch ids) of the latest fold."""
        number, folder = max(((int(n), f) for n, f in self._marks("folds")), default=(0, None))
        if folder is None:
            return 0, None, set()
        return number, folder, {r[0] for r in self.spark.read.schema("batch string").text(f"{self.path}/deltas/{folder}-batches").collect()}

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Store a batch of signed rows; False, and no change, if that batch counts already."""
        if not batch or set("@/\n") & set(batch) or batch.startswith("."):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        folder = uuid.uuid4().hex
        summed(rows).write.parquet(f"{self.path}/deltas/{folder}")
        self._mark("commits", batch, folder)
        return self.committed()[batch] == folder

    def _read(self, known: dict[str, str], fold: str | None, within: set[str]) -> DataFrame:
        folders = [f for b, f in sorted(known.items()) if b not in within] + ([fold] if fold else [])
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return summed(self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/deltas/{f}" for f in folders]))

    def totals(self) -> DataFrame:
        _, fold, within = self.folded()
        return self._read(self.committed(), fold, within)

    def compact(self) -> None:
        """Fold all batches that count now into one folder; batch ids stay known, and batches to come count beside it."""
        number, fold, within = self.folded()
        known = self.committed()
        if len(known.keys() - within) < 1 + (fold is None):
            return
        folder = uuid.uuid4().hex
        self._read(known, fold, within).write.parquet(f"{self.path}/deltas/{folder}")
        self.spark.createDataFrame([(b,) for b in sorted(known)], "batch string").coalesce(1).write.text(f"{self.path}/deltas/{folder}-batches")
        self._mark("folds", str(number + 1), folder)


#: Withdrawn are texts of fewer words; revised are those with an e-mail address, which is masked.
LEAST_WORDS = 20
ADDRESS, MASK = r"[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+", "[masked address]"


def maintained(docs: DataFrame, store: str | None = None) -> DataFrame:
    """Totals of a corpus that changes: the batches of its life, some of them sent twice.

    All documents are inserted, by the counts of two tokenizers. Texts of fewer than LEAST_WORDS words are deleted. Texts
    with e-mail addresses are revised: their old counts go and those of the masked text come.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, store or f"{checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}")

    def counted(rows: DataFrame, sign: int = INSERT, text_col: str = "text") -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [changes(rows, version, sign, text_col) for version in TOKENIZERS])

    short = docs.where(space_words(F.col("text")) < LEAST_WORDS)
    revised = docs.where(F.contains("text", F.lit("@")) & (space_words(F.col("text")) >= LEAST_WORDS)).withColumn("masked text", F.regexp_replace("text", ADDRESS, MASK)).where(F.col("masked text") != F.col("text"))
    life = [(f"insert-{version}", changes(docs, version)) for version in TOKENIZERS]
    life += [("withdrawn", counted(short, DELETE)), ("masked", counted(revised, DELETE).unionByName(counted(revised, INSERT, "masked text")))]
    for at, (batch, rows) in enumerate(life):
        rollup.commit(batch, rows)
        rollup.commit(*life[at // 2])  # sent again: changes nothing
        if at == 1:
            rollup.compact()
    return rollup.totals()
