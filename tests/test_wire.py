"""Short-keyed texts: every kind of question, requests, defaults, odd input."""

import json

from pyspark.sql import functions as F

from waymark.operators import wire

QUESTIONS = [
    {"id": "a", "questionType": "radar", "answer": "positive", "center": (139.1, 35.2), "radiusMeters": 500.0, "radiusOption": "500m", "distanceUnit": "m"},
    {"id": "b", "questionType": "measuring", "answer": "unanswered", "center": (-0.0000004, -35.2000004), "category": "park", "distanceUnit": "mi"},
    {"id": "c", "questionType": "thermometer", "answer": "negative", "previousPosition": (1.0, 2.0), "currentPosition": (3.5, 4.25), "distanceUnit": "m"},
    {"id": "d", "questionType": "tentacles", "answer": "unanswered", "center": (5.0, 6.0), "category": "zoo", "selectedOsmId": 7, "selectedOsmType": "node", "selectedName": "é \"x\"", "distanceUnit": "m"},
    {"id": "e", "questionType": "matching", "answer": "positive", "center": (5.0, 6.0), "lineId": "osm:1", "lineName": "L", "targetName": "T", "targetOsmId": 9, "targetOsmType": "way", "distanceUnit": "m"},
]


def row(values, schema):
    return tuple(values.get(f.name) for f in schema)


def test_round_trip_of_all_kinds(spark):
    q = wire.long_schema(wire.QUESTION)
    values = {"gameId": "g", "metadata": ("2024",), "hidingZones": (600.0, ["p"]), "playArea": row({"center": (139.5, 35.5), "label": "Area", "osmId": 1}, wire.long_schema(wire.STATE["playArea"])), "questions": [row(x, q) for x in QUESTIONS], "adminDivisions": (["1", "2", "3", "4"], "japan")}
    df = spark.createDataFrame([(row(values, wire.long_schema()),), (row({"gameId": "h", "metadata": ("2025",), "questions": []}, wire.long_schema()),), (None,)], wire.T.StructType([wire.T.StructField("state", wire.long_schema())]))
    df = df.withColumn("short", wire.minify(F.col("state")))
    texts = [r["short"] for r in df.collect()]
    first = json.loads(texts[0])
    assert [x["t"] for x in first["p"]["q"]] == ["r", "g", "h", "c", "m"] and [x.get("e") for x in first["p"]["q"]] == ["p", None, "n", None, "p"] and [x.get("du") for x in first["p"]["q"]] == [None, "mi", None, None, None]
    assert first["p"]["q"][1]["n"] == [0, -35200000] and list(first["p"]) == sorted(first["p"]) and texts[1] == '{"k":"app-state","p":{"g":"h","m":{"c":"2025"}},"v":1}' and texts[2] is None
    back = wire.unminify(df, "short").collect()
    assert [r["status"] for r in back] == ["ok", "ok", "invalid-json"] and back[1]["payload"] == back[1]["state"] and back[0]["unknown"] == []
    a, b = back[0]["payload"].asDict(True), back[0]["state"].asDict(True)
    b["questions"][1]["center"] = {"x": 0.0, "y": -35.2}
    assert a == b


def test_requests_and_odd_texts(spark):
    q = {"k": "question-request", "v": 1, "p": {"c": "2024", "rq": "r1", "qq": {"i": "q", "n": [1, 2], "t": "r", "r": 5, "new": 1}}}
    texts = [json.dumps(q), json.dumps(q | {"v": 2}), "{torn", "[]", None, json.dumps(q | {"k": "app-state"}), json.dumps(q | {"extra": True}), json.dumps({"k": "question-request", "v": 1})]
    out = wire.unminify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "question-request").orderBy("i").collect()
    assert [r["status"] for r in out] == ["ok", "unsupported-version", "invalid-json", "invalid-json", "invalid-json", "other-kind", "ok", "invalid-json"]
    assert out[0]["unknown"] == ["new"] and out[6]["unknown"] == ["extra", "new"]
    p = out[0]["payload"]
    assert p["requestId"] == "r1" and p["question"]["answer"] == "unanswered" and p["question"]["center"]["x"] == 1e-6 and p["question"]["distanceUnit"] == "m"
