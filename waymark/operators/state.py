"""Questions and application state: answers, migration of stored rows, edits, sharing. One row a question, in explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import text as tx

#: Question types, what each may answer, and the radar presets in metres.
TYPES = ("radar", "matching", "measuring", "thermometer", "tentacles", "transit-line")
ANSWERS = ("positive", "negative", "unanswered", "hotter", "colder", "closer", "further")
RADAR_PRESETS = {"500m": 500.0, "1km": 1000.0, "2km": 2000.0, "5km": 5000.0, "10km": 10000.0, "15km": 15000.0, "40km": 40000.0, "80km": 80000.0, "150km": 150000.0}

QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("distance", T.DoubleType()),
        T.StructField("unit", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("selected", T.LongType()), T.StructField("line", T.StringType()),
    ]
)


def parse_questions(rows: DataFrame, col: str = "json") -> DataFrame:
    """Each stored JSON array as question rows with their place; rows that break a rule are dropped one by one, the rest stay.

    The former type name ``radius`` becomes radar; a missing answer is unanswered. Text that is no array gives no rows.
    """
    raw = rows.withColumn("__items", F.from_json(F.col(col), T.ArrayType(T.StringType())))
    q = raw.select(*(c for c in rows.columns if c != col), F.posexplode("__items").alias("ord", "__item")).withColumn("q", F.from_json("__item", QUESTION))
    q = q.select(*(c for c in q.columns if c not in ("q", "__item")), "q.*")
    q = q.withColumn("type", F.when(F.col("type") == "radius", "radar").otherwise(F.col("type"))).withColumn("answer", F.coalesce("answer", F.lit("unanswered")))
    valid = (F.length("id") > 0) & F.col("type").isin(*TYPES) & F.col("answer").isin(*ANSWERS)
    valid = valid & ((F.col("type") != "radar") | ((F.col("distance") > 0) & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)))
    return q.filter(F.coalesce(valid, F.lit(False)))


def poi_answer(selected: Column) -> Column:
    return F.when(selected.isNotNull(), "positive").otherwise("unanswered")


def normalise_poi_answer(answer: Column, selected: Column) -> Column:
    """An explicit no stays; all else follows from the selection."""
    return F.when((answer == "negative") & selected.isNull(), "negative").otherwise(poi_answer(selected))


def answer_status(kind: Column, answer: Column, selected: Column) -> Column:
    poi = kind.isin("matching", "tentacles")
    done = F.when(poi, selected.isNotNull() | (answer == "negative")).otherwise(answer != "unanswered")
    return F.when(F.coalesce(done, F.lit(False)), "answered").otherwise("unanswered")


def last_question(questions: DataFrame) -> DataFrame:
    """Of questions that repeat an id the last, in the place of the first."""
    cols = [c for c in questions.columns if c not in ("id", "ord")]
    out = questions.groupBy("id").agg(F.max_by(F.struct(*cols), "ord").alias("q"), F.min("ord").alias("ord"))
    return out.select("id", "ord", "q.*")


def set_radar_preset(option: Column, distance: Column, unit: Column) -> tuple[Column, Column]:
    """(distance, unit) after a choice: a preset gives its metres, anything else keeps what was there."""
    presets = F.create_map(*(F.lit(x) for k, v in RADAR_PRESETS.items() for x in (k, v)))
    metres = F.try_element_at(presets, option)
    return F.coalesce(metres, distance), F.when(metres.isNotNull(), "m").otherwise(unit)


def set_distance(text: Column, unit: Column, distance: Column) -> Column:
    """A typed distance in the current unit; text that is no positive number leaves the distance as it was."""
    from waymark.functions.geo import to_metres

    return F.coalesce(to_metres(text, unit), distance)


def normalise_line(line: Column, answer: Column) -> tuple[Column, Column]:
    """(line, answer): a line id that isn't canonical resets both."""
    ok = tx.is_route_id(line)
    return F.when(ok, line), F.when(ok, answer).otherwise("unanswered")


def reconcile_line(line: Column, answer: Column, offered: Column) -> tuple[Column, Column]:
    """(line, answer) once other lines are offered: kept if still there; a sole offer is taken, with the answer; else reset."""
    kept, sole = F.array_contains(offered, line), F.size(offered) == 1
    kept = F.coalesce(kept, F.lit(False))
    return F.when(kept, line).when(sole, F.get(offered, F.lit(0))), F.when(kept | sole, answer).otherwise("unanswered")


def fill_centres(questions: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """Matching rows without a place get the play area's centre."""
    blank = (F.col("type") == "matching") & F.col("lon").isNull()
    return questions.withColumn("__b", blank).withColumn("lon", F.when(F.col("__b"), lon).otherwise(F.col("lon"))).withColumn("lat", F.when(F.col("__b"), lat).otherwise(F.col("lat"))).drop("__b")


def select_poi(questions: DataFrame, chosen: Column) -> DataFrame:
    """Selection and answer at once; an id that isn't positive raises an error, null is an explicit no."""
    ok = F.when(chosen.isNull() | (chosen > 0), chosen).otherwise(F.raise_error(F.lit("an id is not positive")).cast("long"))
    return questions.withColumn("selected", ok).withColumn("answer", F.when(F.col("selected").isNull(), "negative").otherwise("positive"))


def imported(questions: DataFrame, stamp: Column) -> DataFrame:
    """Imported questions: fresh ids, no selection, no answer but an explicit no."""
    q = questions.withColumn("answer", F.when(F.col("answer") == "negative", "negative").otherwise("unanswered")).withColumn("selected", F.lit(None).cast("long"))
    return q.withColumn("id", F.concat_ws("-", F.lit("imported"), stamp, "ord"))


def migrate_state(rows: DataFrame, col: str = "json") -> DataFrame:
    """Adds ``version``, ``play_area``, ``units``, ``questions`` (JSON): slices that don't parse take their defaults; a state that isn't an object of version 1 is null."""
    j = F.col(col)
    version = F.get_json_object(j, "$.version").try_cast("int")
    ok = F.coalesce(version == 1, F.lit(False))
    area, units, questions = (F.get_json_object(j, f"$.{k}") for k in ("playArea.osmId", "units", "questions"))
    return rows.select(
        *(c for c in rows.columns if c != col), F.when(ok, version).alias("version"), F.when(ok, F.coalesce(area.try_cast("long"), F.lit(0))).alias("play_area"),
        F.when(ok, F.when(units.isin("metric", "imperial"), units).otherwise("metric")).alias("units"), F.when(ok, F.when(F.startswith(questions, F.lit("[")), questions).otherwise("[]")).alias("questions"),
    )


def summary(questions: Column, stations: Column, radius_m: Column) -> Column:
    from waymark.functions.geo import format_station_distance

    return F.concat_ws(", ", tx.plural(questions, "question"), tx.plural(stations, "station"), F.concat(format_station_distance(radius_m), F.lit(" radius")))
