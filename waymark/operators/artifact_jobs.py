"""The three artifacts of a region - boundaries, measuring lines, transit - built once for each content of their inputs.

An artifact's folder is named by a digest of all its input rows and of the settings. A run that finds the folder complete reads it
back and writes nothing; a run that was cut off leaves a folder without its mark of success, which the next run overwrites. So
a lost executor costs its tasks, a lost driver the artifact it was at, and an unchanged region nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import rings
from waymark.operators import measuring
from waymark.operators.line_builder import build_lines


def content_digest(tables: dict[str, DataFrame], settings: str = "") -> str:
    """A digest of all rows of the named tables, whatever their order and partitions, of their columns and of the settings."""
    parts = []
    for name, df in sorted(tables.items()):
        row = F.struct(*sorted(df.columns))
        h = F.xxhash64(F.to_json(row), F.lit(name))  # maps have no hash of their own
        n, a, b = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(h))).first()
        parts.append(f"{name}:{sorted(df.dtypes)}:{n}:{a}:{b}")
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(F.sha2(F.lit("|".join([settings, *parts])), 256)).first()[0][:32]


def resumed(folder: str, kind: str, tables: dict[str, DataFrame], build: Callable[[], DataFrame], settings: str = "") -> tuple[DataFrame, bool]:
    """The artifact of a kind for these inputs, and whether this call wrote it.

    The folder must be one that all executors and later drivers share.
    """
    spark = next(iter(tables.values())).sparkSession
    path = f"{folder.rstrip('/')}/{kind}-{content_digest(tables, settings)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    written = not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if written:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), written


def boundaries(areas: DataFrame, least_points: int = 4, scale: float = 1e5) -> DataFrame:
    """(level, area, name, code, points, w, s, e, n): boundaries with rings of ``least_points`` or more, delta-coded, by level.

    Repeated points go; areas of which no ring is left, and null shapes, have no row. areas: area, area_name, level, multi.
    """
    clean = F.filter(F.transform("multi", lambda p: rings.clean_polygon(p, least_points)), lambda p: p.isNotNull())
    a = areas.withColumn("multi", clean).filter(F.size("multi") > 0).withColumn("box", rings.bounds(F.flatten(F.flatten("multi"))))
    return a.select("level", "area", F.col("area_name").alias("name"), rings.delta_encode(F.col("multi"), scale).alias("code"), rings.count_points(F.col("multi")).alias("points"), "box.*")


def measuring_lines(areas: DataFrame, lines: DataFrame, window: Column | None = None, window_m: float = measuring.WINDOW_M) -> DataFrame:
    """(category, id, code, points): lines by category and the borders of each level as category admin-<level>, compactly coded, within the window of a play area.

    areas as for ``boundaries``; lines: category, id (string), line. Lines of fewer than two points go.
    """
    border = areas.select(F.concat(F.lit("admin-"), F.col("level").cast("string")).alias("category"), F.col("area").cast("string").alias("area"), F.posexplode(F.flatten("multi")).alias("ring", "line"))
    every = lines.select("category", "id", "line").unionByName(border.select("category", F.concat_ws(":", "area", "ring").alias("id"), "line"))
    every = every.withColumn("line", rings.drop_repeats(F.col("line"))).filter(F.size("line") > 1).withColumn("box", rings.bounds(F.col("line")))
    if window is not None:
        every = measuring.in_window(every, window, window_m)
    return every.select("category", "id", rings.compact_line(F.col("line")).alias("code"), F.size("line").alias("points"))


def transit(**tables) -> DataFrame:
    """Lines of ``build_lines`` that have no reason against them: line, name, operator, stations, codes (a compact line each part)."""
    out = build_lines(**tables).filter("reason IS NULL")
    return out.select("line", "name", "operator", "stations", F.transform("geometry", lambda part: rings.compact_line(part)).alias("codes"))


def build_region(folder: str, areas: DataFrame, lines: DataFrame, relations: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, bool]]:
    """All three artifacts of a region by kind, each with whether it was written now. relations: the tables of ``build_lines``."""
    return {
        "boundaries": resumed(folder, "boundaries", {"areas": areas}, lambda: boundaries(areas)),
        "measuring": resumed(folder, "measuring", {"areas": areas, "lines": lines}, lambda: measuring_lines(areas, lines)),
        "transit": resumed(folder, "transit", relations, lambda: transit(**relations)),
    }


def report(spark: SparkSession, built: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """(kind, rows, written) of each artifact."""
    out = None
    for kind, (df, written) in sorted(built.items()):
        part = df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.lit(written).alias("written"))
        out = part if out is None else out.unionByName(part)
    return out
