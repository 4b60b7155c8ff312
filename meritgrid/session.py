"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: Sequence[Sequence], **columns: str) -> DataFrame:
    """Hand-kept rows as one literal, so that the optimizer sees how small they are.

    ``columns`` maps names to SQL types, in the order of the row values.
    """
    text = json.dumps([dict(zip(columns, row)) for row in rows])
    fields = ",".join(f"{name}:{kind}" for name, kind in columns.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def local_session(cores: int | str = 8, app: str = "meritgrid", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def _shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local run without that setting gets a scratch folder; on a cluster a missing setting is an
    error, because executors do not share a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="meritgrid-ckpt-")
    return _LOCAL_FOLDERS[app]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt evenly over the shuffle partitions, rows with equal values of ``by`` together.

    Narrow rows of a small file reach a single task otherwise, which then does all the work on them. The
    partitions of an ordinary shuffle are put together to about one for each core, so that what a task
    sorts grows with the table; these stay as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and it survives lost executors.

    A reliable checkpoint would compute its rows twice, once for the count that triggers it.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/meritgrid-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
