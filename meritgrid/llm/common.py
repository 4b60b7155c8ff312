"""Helpers of the training-data operators: the shared folder, stored tables, Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local run without that setting gets a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="meritgrid-llm-")
        folder = "file://" + _LOCAL_FOLDERS[app]
    return f"{folder.rstrip('/')}/meritgrid-llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cut lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that are replaced later (see ``remove``)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application stored; call it when its results are written."""
    remove(spark, shared_folder(spark))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in the shared folder (a compiled lexicon)."""
    system, where = _file_system(spark, path)
    out = system.create(where, True)
    try:
        for start in range(0, len(data), 1 << 22):
            out.write(data[start : start + (1 << 22)])
    finally:
        out.close()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def filled(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(*columns: str) -> Column:
    """64-bit key of a row's values; equal rows share it and have equal results."""
    return F.xxhash64(*columns)


def small_batches(
    batches: Iterator[pa.RecordBatch], limit: int = 1 << 22, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def text_slices(texts: list, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` holding about ``limit`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
