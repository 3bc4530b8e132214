"""Exact deduplication with keyed streaming state that never expires.

Arriving rows are written to a ledger (digest, identifier, text; the locator is a row's place in it). A Structured Streaming
query groups the ledger's rows, without their texts, by digest in RocksDB state, kept on disk and checkpointed to the shared folder: per digest the number of
rows and the smallest identifier with its locator. Partial aggregation collapses copies before the shuffle, so that a
digest shared by a third of all rows reaches its state as one row a task. There is no watermark: state lives on, and a
later run over the same folder (``run_dir``) meets every digest seen before.

A digest hit is only a candidate. The text at the state's locator is read from the ledger and compared in full with the texts
of all rows behind the digest, those of earlier runs too; where they differ, the rows are grouped by the text itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import measured, scratch, stage, utf8

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no files are reserved ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text_col: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(utf8(text_col), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The ledger's rows: doc_id, digest, locator, t (the normalised text); and sha with other digests.

    The locator (run, row) names the row in the ledger, which keeps the content: what reads by it finds the text there.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    more = [] if digest is sha256 else [sha256(F.col("t")).alias("sha")]
    locator = F.struct(F.lit(uuid.uuid4().hex).alias("run"), F.monotonically_increasing_id().alias("row"))
    return slim.select("doc_id", digest(F.col("t")).alias("digest"), locator.alias("locator"), "t", *more)


def stream_groups(spark: SparkSession, ledger: str, schema, run_dir: str, files_per_batch: int | None = None) -> str:
    """Run the stateful query over all ledger files not yet seen in run_dir; returns the folder of its updates.

    Each micro-batch writes what changed to a folder of its own, by batch number, so that a repeated batch replaces itself.
    """
    out = f"{run_dir}/updates"
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = (
        source.parquet(ledger)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("first"))
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _conf(spark, STATE):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{run_dir}/state").foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def latest_groups(spark: SparkSession, updates: str) -> DataFrame:
    """digest, n, keep_id, locator (of keep_id's row): the last state of each digest (its count only grows)."""
    last = spark.read.parquet(updates).groupBy("digest").agg(F.max(F.struct("n", "first")).alias("x"))
    return last.select("digest", F.col("x.n").alias("n"), F.col("x.first.doc_id").alias("keep_id"), F.col("x.first.locator").alias("locator"))


def false_hits(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests behind which the ledger's texts differ.

    The text at each group's locator is read from the ledger and compared with all texts of the digest: with their smallest
    and largest, which are aggregated per task first, so that a large group meets as one row a task.
    """
    hit = measured(groups.filter("n > 1").select("digest", "locator"))
    ends = rows.join(hit.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    kept = rows.select("locator", F.col("t").alias("kept")).join(hit, "locator").select("digest", "kept")
    return ends.join(kept, "digest").filter("lo <> kept OR hi <> kept").select("digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, run_dir: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after white-space runs become one space; null counts as empty, and all empty texts are one
    group. The smallest id of a group stays. Rows that repeat an id and text count in group_size, and all rows of the
    smallest id are kept; null ids come after all others. Other columns are ignored. An empty table gives no rows.
    ``digest`` may be any function of the text: a weak one costs time, never a wrong result. With the run_dir of an earlier
    run (with the same digest), its rows take part, by their texts in its ledger, and are returned too.
    """
    spark = docs.sparkSession
    run_dir = run_dir or scratch(spark, "dedup")
    ledger = f"{run_dir}/ledger"
    fingerprint_rows(docs, id_col, text_col, digest).write.mode("append").parquet(ledger)
    rows = spark.read.parquet(ledger)
    updates = stream_groups(spark, ledger, rows.schema, run_dir, files_per_batch)
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    groups = stage(latest_groups(spark, updates), "dedup-groups")

    wrong = measured(stage(false_hits(rows, groups), "dedup-false"))
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    slim = rows.select("doc_id", "digest", sha.alias("sha"))
    same = slim.join(groups.select("digest", "keep_id", F.col("n").alias("group_size")), "digest").select("doc_id", "digest", "keep_id", "group_size", "sha")
    if not wrong.isEmpty():
        same = same.join(wrong, "digest", "left_anti")
        apart = rows.join(wrong, "digest", "left_semi").select("doc_id", "t", sha.alias("sha"))
        by_text = apart.groupBy("t").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(by_text, "t").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", "sha")
        same = same.drop("digest").unionByName(apart)
    return same.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def number_rows(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """docs with __key, which names each row and sorts by id, null ids after all others; staged, so that it stays the same."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    return stage(docs.withColumn("__key", key), name)


def keep_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """number_rows' rows without those that ``gone`` names by key, and without the key."""
    gone = gone.select(F.col("doc_id.row").alias("__gone"))
    return rows.join(gone, F.col("__key.row") == F.col("__gone"), "left_anti").drop("__key")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of docs that deduplicate() keeps, with all their columns.

    Rows are decided one by one: rows that share an id, or have none, don't follow each other. Rows that repeat both id and
    text all stay; without ``repeats`` one of them does.
    """
    rows = number_rows(docs, id_col, "dedup-rows")
    out = deduplicate(rows, "__key", text_col)
    kept = F.col("doc_id.id").eqNullSafe(F.col("keep_id.id")) if repeats else F.col("kept")
    return keep_rows(rows, out.filter(~kept))
