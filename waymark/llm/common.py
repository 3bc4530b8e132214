"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured rows fit this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent in a session on one machine (tests) a temporary folder takes its place; elsewhere executors
    would not see each other's files, so its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, of rows of known width, with a broadcast hint if its counted rows fit the limit; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged df with a broadcast hint if its summed values and counted rows fit the limit; otherwise as it is.

    A value counts with the bytes of its JSON text, a row with 64 more, so arrays and texts of any length count in full.
    """
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()
    return F.broadcast(df) if (size or 0) + 64 * n <= limit else df


def utf8(col: str | Column) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def in_fold(doc_id: str | Column, folds: int = 5) -> Column:
    """True for rows held out of training: crc32 of the id's text is divisible by folds. A null id trains."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))
