"""Short-keyed share texts: typed states and single questions in, compact JSON out, and back.

One description of the fields (``STATE``, ``QUESTION``) drives all four directions: the typed schema, the short schema, the
rewrite into short keys and the rewrite back. Values that equal their default are left out; places become whole millionths of
a degree. Everything is Column expressions, so it runs in generated code and on any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short key of each field, codes of question types and answers, the version written, and steps a degree.
KEYS = {
    "adminDivisions": "ad", "adminLevels": "al", "adminPack": "ap", "answer": "e", "candidates": "cd", "category": "b", "center": "n", "createdAt": "c", "distanceUnit": "du",
    "gameId": "g", "hidingZones": "h", "id": "i", "kind": "k", "label": "l", "metadata": "m", "osmId": "o", "payload": "p", "playArea": "a", "previousPosition": "pp",
    "currentPosition": "cp", "questions": "q", "question": "qq", "requestId": "rq", "radiusMeters": "r", "radiusOption": "d", "questionType": "t", "lineId": "x", "lineName": "y",
    "selectedName": "sn", "selectedOsmId": "f", "selectedOsmType": "j", "selectedPresetIds": "s", "targetName": "u", "targetOsmId": "w", "targetOsmType": "z", "version": "v",
}
TYPES = {"radar": "r", "measuring": "g", "thermometer": "h", "tentacles": "c", "matching": "m"}
ANSWERS = {"positive": "p", "negative": "n"}
VERSION, STEPS = 1, 1e6

#: Fields by name: text, number (long), metres (double), place, texts, or one of the coded kinds; a dict is a nested object, a
#: list of one dict an array of objects.
QUESTION = {
    "id": "text", "questionType": "type", "answer": "answer", "category": "text", "center": "place", "previousPosition": "place", "currentPosition": "place", "radiusMeters": "metres", "radiusOption": "text",
    "distanceUnit": "unit", "lineId": "text", "lineName": "text", "selectedOsmId": "number", "selectedOsmType": "text", "selectedName": "text", "targetName": "text", "targetOsmId": "number", "targetOsmType": "text",
}
STATE = {
    "gameId": "text", "metadata": {"createdAt": "text"}, "hidingZones": {"radiusMeters": "metres", "selectedPresetIds": "texts"},
    "playArea": {"center": "place", "label": "text", "osmId": "number"}, "questions": [QUESTION], "adminDivisions": {"adminPack": "text", "adminLevels": "texts"},
}
REQUEST = {"createdAt": "text", "requestId": "text", "question": QUESTION}

PLACE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LONG = {"text": T.StringType(), "number": T.LongType(), "metres": T.DoubleType(), "place": PLACE, "texts": T.ArrayType(T.StringType())}
SHORT = LONG | {"place": T.ArrayType(T.LongType())}


def _of(kind, leaves: dict, key) -> T.DataType:
    if isinstance(kind, dict):
        return T.StructType([T.StructField(key(name), _of(k, leaves, key)) for name, k in _ordered(kind, key)])
    if isinstance(kind, list):
        return T.ArrayType(_of(kind[0], leaves, key))
    return leaves.get(kind, T.StringType())


def _ordered(kind: dict, key) -> list[tuple[str, object]]:
    return sorted(kind.items(), key=lambda x: key(x[0]))


def long_schema(kind=STATE) -> T.StructType:
    """The typed form of a payload; fields by name."""
    return _of(kind, LONG, lambda name: name)


def short_schema(kind=STATE) -> T.StructType:
    return _of(kind, SHORT, KEYS.__getitem__)


def _coded(value: Column, codes: dict[str, str], other: Column) -> Column:
    return F.coalesce(*(F.when(value == a, F.lit(b)) for a, b in codes.items()), other)


def _pack(value: Column, kind) -> Column:
    none = F.lit(None).cast("string")
    if isinstance(kind, dict):
        return F.when(value.isNotNull(), F.struct(*(_pack(value[name], k).alias(KEYS[name]) for name, k in _ordered(kind, KEYS.__getitem__))))
    if isinstance(kind, list):
        return F.when(F.size(value) > 0, F.transform(value, lambda v: _pack(v, kind[0])))
    if kind == "place":
        return F.when(value.isNotNull(), F.array(*(F.floor(value[k] * STEPS + 0.5).cast("long") for k in "xy")))
    if kind == "type":
        return _coded(value, TYPES, value)
    if kind == "answer":
        return _coded(value, ANSWERS, none)
    if kind == "unit":
        return F.when(value != "m", value)
    return value


def _unpack(value: Column, kind) -> Column:
    if isinstance(kind, dict):
        return F.when(value.isNotNull(), F.struct(*(_unpack(value[KEYS[name]], k).alias(name) for name, k in _ordered(kind, lambda name: name))))
    if isinstance(kind, list):
        return F.coalesce(F.transform(value, lambda v: _unpack(v, kind[0])), F.array().cast(T.ArrayType(long_schema(kind[0]))))
    if kind == "place":
        return F.when(value.isNotNull(), F.struct((value[0] / STEPS).alias("x"), (value[1] / STEPS).alias("y")))
    if kind == "type":
        return F.coalesce(_coded(value, {b: a for a, b in TYPES.items()}, value), F.lit("radar"))
    if kind == "answer":
        return _coded(value, {b: a for a, b in ANSWERS.items()}, F.lit("unanswered"))
    if kind == "unit":
        return F.coalesce(value, F.lit("m"))
    return value


def minify(payload: Column, kind: str = "app-state") -> Column:
    """The short text of a typed payload (``long_schema`` of STATE, or of REQUEST for kind question-request): keys in order, defaults and nulls left out. Null stays null."""
    spec = REQUEST if kind == "question-request" else STATE
    whole = F.struct(F.lit(kind).alias(KEYS["kind"]), _pack(payload, spec).alias(KEYS["payload"]), F.lit(VERSION).alias(KEYS["version"]))
    return F.when(payload.isNotNull(), F.to_json(whole))


def _objects(kind: dict, path: str = "$.p") -> Iterator[tuple[str, dict, bool]]:
    """Where objects stand in a short text: path, fields, and whether in an array."""
    yield path, kind, False
    for name, k in kind.items():
        if isinstance(k, dict):
            yield from _objects(k, f"{path}.{KEYS[name]}")
        elif isinstance(k, list):
            yield f"{path}.{KEYS[name]}", k[0], True


def unknown_keys(text: Column, kind=STATE) -> Column:
    """Keys of a short text that no field has, sorted and once each."""
    found = [F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))]
    known = [[KEYS[k] for k in ("kind", "payload", "version")]]
    for path, fields, many in _objects(kind):
        part = F.get_json_object(text, path)
        keys = F.flatten(F.transform(F.from_json(part, T.ArrayType(T.MapType(T.StringType(), T.StringType()))), F.map_keys)) if many else F.json_object_keys(part)
        found.append(F.coalesce(keys, F.array().cast("array<string>")))
        known.append([KEYS[name] for name in fields])
    odd = [F.array_except(keys, F.array(*map(F.lit, own))) for keys, own in zip(found, known, strict=True)]
    return F.array_sort(F.array_distinct(F.concat(*odd)))


def unminify(rows: DataFrame, col: str, kind: str = "app-state") -> DataFrame:
    """rows without ``col`` and with status, unknown (keys that were passed over) and the typed payload.

    status is ok, invalid-json, other-kind or unsupported-version; the payload is null unless ok. Missing answers are
    unanswered, missing units metres, a missing type radar, missing questions an empty array.
    """
    spec = REQUEST if kind == "question-request" else STATE
    text = F.col(col)
    version, says = F.get_json_object(text, f"$.{KEYS['version']}"), F.get_json_object(text, f"$.{KEYS['kind']}")
    payload = F.from_json(F.get_json_object(text, f"$.{KEYS['payload']}"), short_schema(spec))
    status = F.when(F.json_object_keys(text).isNull(), "invalid-json").when(~F.coalesce(version == str(VERSION), F.lit(False)), "unsupported-version").when(~F.coalesce(says == kind, F.lit(False)), "other-kind").when(payload.isNull(), "invalid-json").otherwise("ok")
    out = rows.withColumn("status", status).withColumn("unknown", F.when(F.col("status") == "ok", unknown_keys(text, spec))).withColumn("payload", F.when(F.col("status") == "ok", _unpack(payload, spec)))
    return out.drop(col)
