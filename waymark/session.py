"""Sessions, the folder for intermediate tables, and the driver's tables with the positions that the queries give them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which all executors share.

    Without that setting a session on one machine uses a temporary folder; any other raises an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write df to a shared folder and read it back: lineage ends, the plan starts anew."""
    spark = df.sparkSession
    path = shared_folder(spark, "waymark")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(key: str) -> Column:
    """A synthetic longitude from an integer key."""
    return F.lit(139.0) + (F.col(key) * 7919 % 10000) / F.lit(10000.0)


def lat_of(key: str) -> Column:
    return F.lit(35.0) + (F.col(key) * 104729 % 10000) / F.lit(10000.0)


def placed(df: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the synthetic position of a keyed row."""
    return df.withColumn(lon, lon_of(key)).withColumn(lat, lat_of(key))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations: station, operator, name, lon, lat."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").cast("long").alias("operator"), F.col("s_name").alias("name"))
    return placed(s, "station")


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points of interest: poi, category, name, lon, lat."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("poi"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"))
    return placed(p, "poi")
