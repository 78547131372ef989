"""Session helpers shared by every operator that runs Python on executors."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold when the session leaves Spark's default; whole texts can be long.
BATCH_ROWS = 500
_SHIPPED = "_textloom_shipped"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, and keep Arrow batches of texts small.

    The package travels once per SparkContext as a zip through Spark's own file server, so neither a shared
    folder nor a PYTHONPATH on the workers is needed.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="textloom-"))) / "textloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session that names none gets a temporary one of its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), f"textloom-checkpoints-{uuid.uuid4().hex}")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a string column, measured: estimates of a scan are of compressed files, and other plans have none."""
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def width_for(spark: SparkSession, total: int, each: int) -> int:
    """Partitions so that each holds about `each` of total; never fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(spark), math.ceil(total / each))
