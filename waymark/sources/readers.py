"""Readers: captured map data, place searches, columnar bundles, timetables, route relations, and packed artifacts.

All of them go through Spark's own readers with explicit schemas, so any store that Spark reads will do, and files are read
where they lie. Nothing is fetched from a network: captured responses are files.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text as tx

ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
PLACES = "struct<features:array<struct<properties:struct<osm_type:string,osm_id:bigint,name:string,country:string,state:string,extent:array<double>>,geometry:struct<coordinates:array<double>>>>>"
BUNDLE = "struct<schemaVersion:int,region:string,bbox:array<double>,categories:map<string,struct<count:int,lon:array<double>,lat:array<double>,name:array<string>,osmId:array<bigint>>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text: path, json."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def parse_elements(rows: DataFrame, json_col: str = "json", category: str | None = None) -> DataFrame:
    """Elements of captured responses as points: type, osm_id, lon, lat, name, name_length, iata, tags, place.

    Nodes, ways and relations only; the place is the element's own, else its centre; rows without name or place go. For
    stations the name is the English one if there is one, and its length is given; airports give their trimmed code.
    """
    keep = [c for c in rows.columns if c != json_col]
    e = rows.select(*keep, F.posexplode(F.from_json(json_col, ELEMENTS)["elements"]).alias("place", "e")).filter(F.col("e.type").isin("node", "way", "relation"))
    tag = lambda k: F.nullif(F.trim(F.try_element_at("e.tags", F.lit(k))), F.lit(""))
    station = category == "station-name-length"
    name = F.coalesce(tag("name:en"), tag("name")) if station else tag("name")
    e = e.select(
        *keep, "place", F.col("e.type").alias("type"), F.col("e.id").alias("osm_id"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), name.alias("name"),
        (tx.utf16_length(name) if station else F.lit(None).cast("int")).alias("name_length"), (tag("iata") if category == "commercial-airport" else F.lit(None).cast("string")).alias("iata"), F.col("e.tags").alias("tags"),
    )
    return e.filter("name IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")


def parse_places(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Relations of a captured place search with numeric id and name, the first of each id: osm_id, name, ord."""
    p = rows.select(F.posexplode(F.from_json(json_col, PLACES)["features"]).alias("ord", "f")).select("ord", "f.properties.*")
    p = p.filter("osm_type = 'R' AND osm_id IS NOT NULL AND length(trim(name)) > 0")
    from waymark.operators.transit import first_by

    return first_by(p, ["osm_id"], F.col("ord")).select("osm_id", "name", "ord")


def read_bundles(rows: DataFrame, json_col: str = "json", version: int = 1) -> DataFrame:
    """Columnar region bundles as rows (region, category, count, osm_id, lon, lat, name); bundles of another version give none."""
    b = rows.select(F.from_json(json_col, BUNDLE).alias("b")).filter(F.col("b.schemaVersion") == version)
    c = b.select(F.col("b.region").alias("region"), F.explode("b.categories").alias("category", "c"))
    return c.select("region", "category", "c.count", F.col("c.osmId").alias("osm_id"), "c.lon", "c.lat", "c.name")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON text sequence (record separators allowed): id, tags, kind, geometry (as JSON)."""
    line = F.regexp_replace("value", "^\\x1e", "")
    f = spark.read.text(path).select(F.from_json(line, "struct<id:string,properties:map<string,string>,geometry:string>").alias("f")).filter("f.geometry IS NOT NULL")
    return f.select("f.id", F.col("f.properties").alias("tags"), F.get_json_object("f.geometry", "$.type").alias("kind"), F.col("f.geometry").alias("geometry"))


GTFS = {
    "routes": "route_id string, route_long_name string, route_short_name string, route_desc string, route_color string",
    "trips": "trip_id string, route_id string, shape_id string",
    "stops": "stop_id string, stop_lat string, stop_lon string, stop_name string",
    "stop_times": "trip_id string, stop_id string, stop_sequence string",
    "shapes": "shape_id string, shape_pt_lat string, shape_pt_lon string, shape_pt_sequence string",
}


def read_gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a timetable folder as text columns; columns may stand in any order, missing ones and values are ''."""
    raw = spark.read.csv(f"{folder}/*{name}.txt", header=True, quote='"', escape='"', multiLine=True)
    want = [c.split()[0] for c in GTFS[name].split(", ")]
    out = raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in want))
    return out.filter(F.length(F.concat(*want)) > 0)


def read_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of an OSM XML file: (id, lon, lat, tags), (id, nodes, tags), (id, members, tags)."""
    tag = "tag array<struct<_k:string,_v:string>>"
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    tags = F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>")).alias("tags")
    n = read("node", f"_id bigint, _lat double, _lon double, {tag}").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags)
    w = read("way", f"_id bigint, nd array<struct<_ref:bigint>>, {tag}").select(F.col("_id").alias("id"), F.transform("nd", lambda x: x["_ref"]).alias("nodes"), tags)
    r = read("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {tag}")
    r = r.select(F.col("_id").alias("id"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), tags)
    return n, w, r


def without_members(nodes: DataFrame, groups: DataFrame, usages: list[str]) -> DataFrame:
    """Nodes that belong to no way or relation with one of the usages. groups: (id, refs array, tags)."""
    gone = groups.filter(F.try_element_at("tags", F.lit("usage")).isin(usages)).select(F.explode("refs").alias("id")).distinct()
    return nodes.join(gone, "id", "left_anti")


def sniff(json_col: Column) -> Column:
    """What a JSON payload is by the shape of its keys: poi, measuring, boundaries, transit, meta, else null."""
    has = lambda path: F.get_json_object(json_col, path).isNotNull()
    return F.when(has("$.categories"), "poi").when(has("$.features"), "measuring").when(has("$.polygons") | has("$.index"), "boundaries").when(has("$.presets"), "transit").when(has("$.artifacts") | has("$.hashes"), "meta")


#: Limits on what an artifact may inflate to.
INFLATE_MOST, INFLATE_TIMES = 100_000_000, 20


def install(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, status, json) of gzipped artifacts checked against their manifest: size, MD5, inflate limit, SHA-256, version.

    files: (file, content); manifest: (file, bytes, md5, sha256, schema_version). Checks run in that order; the first that
    fails names the status, ok otherwise; json is null unless ok.
    """

    def check(frames):
        for pdf in frames:
            out = []
            for raw, size, md5, sha, version in zip(pdf["content"], pdf["bytes"], pdf["md5"], pdf["sha256"], pdf["schema_version"], strict=True):
                raw = bytes(raw)
                status, text = "ok", None
                if len(raw) != size:
                    status = "size"
                elif hashlib.md5(raw, usedforsecurity=False).hexdigest() != md5:
                    status = "md5"
                else:
                    most = min(INFLATE_MOST, INFLATE_TIMES * len(raw))
                    try:
                        z = zlib.decompressobj(31)
                        body = z.decompress(raw, most)
                        if not z.eof:
                            status = "inflate-limit"
                        elif hashlib.sha256(body).hexdigest() != sha:
                            status = "sha256"
                        else:
                            found = re.search(rb'"schemaVersion"\s*:\s*(\d+)', body[:4096])
                            if (int(found[1]) if found else 1) != version:
                                status = "schema-version"
                            else:
                                json.loads(body)
                                text = body.decode()
                    except zlib.error:
                        status = "inflate"
                    except ValueError:
                        status = "json"
                out.append((status, text if status == "ok" else None))
            yield pd.DataFrame({"file": pdf["file"], "status": [s for s, _ in out], "json": [t for _, t in out]})

    return files.join(manifest, "file").mapInPandas(check, "file string, status string, json string")


def to_geojson(records: DataFrame) -> DataFrame:
    """Records (lon, lat, others) as one JSON point feature a row."""
    props = F.struct(*[c for c in records.columns if c not in ("lon", "lat")])
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return records.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("json"))


def write_columnar(records: DataFrame, path: str, by: tuple[str, ...] = ("category",)) -> None:
    """Records as Parquet folders by category, so that later reads prune both columns and categories."""
    records.write.mode("overwrite").partitionBy(*by).parquet(path)


def snapshot_date(files: DataFrame) -> DataFrame:
    """Adds ``snapshot``: the file's modification date."""
    return files.withColumn("snapshot", F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd"))


