"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds decoded at once.
SLICE_CHARS = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode is a temporary one made where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paperglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: the rows are fixed and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` through a reliable checkpoint, for small frames of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about SLICE_CHARS characters with their texts, null as the empty text."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS or i + 1 == len(texts):
            yield lo, i + 1, texts[lo : i + 1]
            lo, size = i + 1, 0


#: Rows of (id, hash) keys up to which they are broadcast; beyond, they join by shuffle.
BROADCAST_ROWS = 1_000_000


def by_size(df: DataFrame) -> DataFrame:
    """A written frame of narrow rows, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
