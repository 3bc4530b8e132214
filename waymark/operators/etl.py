"""Points of interest, boundaries, catalogues and play areas: reduction, de-duplication, columnar bundles, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, rings
from waymark.functions import text as tx
from waymark.operators.transit import first_by

#: A selector: (category, all of these (key, value or None for presence), none of these).
Selector = tuple[str, tuple[tuple[str, str | None], ...], tuple[tuple[str, str | None], ...]]

#: Categories in the order in which they are tried, and the tags that select them.
SELECTORS: tuple[Selector, ...] = (
    ("commercial-airport", (("aeroway", "aerodrome"), ("iata", None)), (("military", "airfield"), ("landuse", "military"))),
    ("mountain", (("natural", "peak"),), ()),
    ("landmark", (("tourism", "attraction"),), ()),
    ("park", (("leisure", "park"),), ()),
    ("amusement-park", (("tourism", "theme_park"),), ()),
    ("zoo", (("tourism", "zoo"),), ()),
    ("aquarium", (("tourism", "aquarium"),), ()),
    ("golf-course", (("leisure", "golf_course"),), ()),
    ("museum", (("tourism", "museum"),), ()),
    ("movie-theater", (("amenity", "cinema"),), ()),
    ("hospital", (("amenity", "hospital"),), ()),
    ("library", (("amenity", "library"),), ()),
    ("foreign-consulate", (("diplomatic", "embassy"),), ()),
    ("station-name-length", (("railway", "station"),), ()),
)


def tag_is(tags: Column, key: str, value: str | None) -> Column:
    have = F.try_element_at(tags, F.lit(key))
    return F.coalesce(have.isNotNull() if value is None else have == value, F.lit(False))


def matches(tags: Column, selector: Selector) -> Column:
    ok = F.lit(True)
    for k, v in selector[1]:
        ok = ok & tag_is(tags, k, v)
    for k, v in selector[2]:
        ok = ok & ~tag_is(tags, k, v)
    return ok


def category_of(tags: Column, selectors: tuple[Selector, ...] = SELECTORS) -> Column:
    """The first category whose selector holds; null if none does. Values match exactly."""
    return F.coalesce(*(F.when(matches(tags, s), s[0]) for s in selectors))


def is_bundleable(category: Column, selectors: tuple[Selector, ...] = SELECTORS) -> Column:
    return category.isin([s[0] for s in selectors])


def is_admin_category(category: Column) -> Column:
    return category.isin("admin-1st", "admin-2nd", "admin-3rd", "admin-4th")


def filter_arguments(selectors: DataFrame) -> DataFrame:
    """key and its values, sorted and comma-joined: a superset that a tag filter can take. Bare keys are left out."""
    return selectors.filter("value IS NOT NULL").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))


def high_speed(tags: Column) -> Column:
    g = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    fast = (g("highspeed") == "yes") | (g("service") == "high_speed") | (F.coalesce(tx.leading_int(g("maxspeed")), F.lit(0)) >= 200)
    return (g("railway") != "linear_motor") & fast


def at_admin_level(tags: Column, level: int | None) -> Column:
    g = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    ok = g("boundary") == "administrative"
    return ok if level is None else ok & (g("admin_level") == str(level))


def post_filter(name: str | None, tags: Column) -> Column:
    """A named filter: high-speed, admin-all, admin-<level>; anything else lets all through."""
    if name == "high-speed":
        return high_speed(tags)
    if name and name.startswith("admin-") and (name == "admin-all" or name[6:].isdigit()):
        return at_admin_level(tags, None if name == "admin-all" else int(name[6:]))
    return F.lit(True)


#: Tags of routes that aren't in service.
UNOPENED_KEYS, UNOPENED_ROUTES, UNOPENED_STATES = ("construction:route", "proposed:route", "disused:route"), ("construction", "proposed", "disused"), ("construction", "proposed")


def is_unopened(tags: Column) -> Column:
    """Under construction, proposed or disused."""
    has = [tag_is(tags, k, None) for k in UNOPENED_KEYS]
    has += [tag_is(tags, "route", v) for v in UNOPENED_ROUTES] + [tag_is(tags, "state", v) for v in UNOPENED_STATES]
    out = F.lit(False)
    for h in has:
        out = out | h
    return out


def reduce_features(features: DataFrame, selectors: tuple[Selector, ...] = SELECTORS) -> DataFrame:
    """Tagged points as compact records: category, lon, lat (6 decimals), name, osm_id, osm_type, name_length, iata, name_en.

    Features without category, name or place go. features: (id text such as n123, tags, lon, lat, ord).
    """
    t = F.col("tags")
    g = lambda k: F.nullif(F.trim(F.try_element_at(t, F.lit(k))), F.lit(""))
    f = features.withColumn("category", category_of(t, selectors)).withColumn("name", tx.shorter_name(g("name"), g("alt_name")))
    f = f.filter("category IS NOT NULL AND name IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    station = F.col("category") == "station-name-length"
    return f.select(
        "category", (geo.js_round(F.col("lon") * 1e6) / 1e6).alias("lon"), (geo.js_round(F.col("lat") * 1e6) / 1e6).alias("lat"), "name",
        F.regexp_extract("id", r"(\d+)$", 1).try_cast("long").alias("osm_id"), tx.osm_type(F.col("id")).alias("osm_type"),
        F.when(station, tx.utf16_length(F.coalesce(g("name:en"), F.col("name")))).alias("name_length"), F.when(F.col("category") == "commercial-airport", g("iata")).alias("iata"),
        F.when(g("name:en") != F.col("name"), g("name:en")).alias("name_en"), "ord",
    )


def dedupe_records(records: DataFrame) -> DataFrame:
    """One record a key: airports with a code by it, others by name and 4-decimal place; the lowest id stays."""
    near = lambda c: geo.js_round(F.col(c) * 1e4).cast("long").cast("string")
    key = F.when((F.col("category") == "commercial-airport") & F.col("iata").isNotNull(), F.concat_ws("|", "category", "iata")).otherwise(F.concat_ws("|", F.col("category"), F.col("name"), near("lat"), near("lon")))
    return first_by(records.withColumn("__key", key), ["__key"], F.col("osm_id"), F.col("ord")).drop("__key")


def columnar(records: DataFrame) -> DataFrame:
    """A row a category with parallel arrays, ordered by id: count, osm_id, lon, lat, name."""
    rows = F.array_sort(F.collect_list(F.struct("osm_id", "lon", "lat", "name")))
    out = records.groupBy("category").agg(F.count(F.lit(1)).alias("count"), rows.alias("r"))
    return out.select("category", "count", *(F.col(f"r.{k}").alias(k) for k in ("osm_id", "lon", "lat", "name")))  # a field of an array of structs is an array


def from_columnar(bundles: DataFrame) -> DataFrame:
    """Columnar rows back to one row a point, with ``place``; bundles whose arrays differ from their count give none."""
    ok = (F.size("lon") == F.col("count")) & (F.size("lat") == F.col("count")) & (F.size("name") == F.col("count")) & (F.size("osm_id") == F.col("count"))
    p = bundles.filter(ok).select("category", F.posexplode(F.arrays_zip("osm_id", "lon", "lat", "name")).alias("place", "r"))
    return p.select("category", "place", "r.*")


# --- catalogues and hashes


def merge_catalogue(current: DataFrame, rebuilt: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are not rebuilt, and the rebuilt ones."""
    return current.join(rebuilt.select(key), key, "left_anti").unionByName(rebuilt)


def artifacts(hashes: DataFrame) -> DataFrame:
    """(id, kind, category, bytes, schema_version) from a map of file name to size; measuring-x is kind measuring, category x."""
    a = hashes.select("id", F.explode("files").alias("file", "bytes"))
    parts = F.regexp_extract("file", r"^(measuring)-(.+)$", 2)
    return a.select("id", F.when(parts != "", "measuring").otherwise(F.col("file")).alias("kind"), F.nullif(parts, F.lit("")).alias("category"), "bytes", F.lit(1).alias("schema_version"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """file, problem: missing, unexpected, or bytes/digest that differ. Both have (file, bytes, sha256)."""
    m, f = manifest.alias("m"), files.alias("f")
    both = m.join(f, F.col("m.file") == F.col("f.file"), "full_outer")
    problem = (
        F.when(F.col("f.file").isNull(), "missing").when(F.col("m.file").isNull(), "unexpected").when(F.col("m.bytes") != F.col("f.bytes"), "bytes").when(F.col("m.sha256") != F.col("f.sha256"), "sha256")
    )
    return both.select(F.coalesce("m.file", "f.file").alias("file"), problem.alias("problem")).filter("problem IS NOT NULL")


def lint(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is a condition that must hold, null breaks it."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


#: What a boundary row must satisfy: name, id, level, a box in order that holds the centroid, an area.
def boundary_rules() -> dict[str, Column]:
    b = F.col("box")
    return {
        "name": F.length("name") > 0, "relation-id": F.col("relation_id") > 0, "admin-level": F.col("level").between(2, 11), "box": (b["w"] <= b["e"]) & (b["s"] <= b["n"]),
        "centroid": geo.box_has_point(b, "lon", "lat"), "area": F.col("area_km2") > 0,
    }


def line_rules(infra: bool = False) -> dict[str, Column]:
    return {
        "route-id": tx.is_route_id(F.col("route_id")), "colour": F.rlike(F.col("colour"), F.lit("^#[0-9a-fA-F]{6}$")), "stations": F.size("stations") >= 2,
        "routes": F.col("operator_routes") <= (50 if infra else 250),
    }


# --- play areas


def union_search(local: DataFrame, remote: DataFrame, key: str = "osm_id") -> DataFrame:
    """Local results, then remote ones whose id isn't local; the first of each id."""
    both = local.withColumn("src", F.lit(0)).unionByName(remote.withColumn("src", F.lit(1)))
    return first_by(both, [key], F.col("src"), F.col("ord")).drop("src")


def enclosing_areas(rows: DataFrame) -> DataFrame:
    """Relation areas (ids from 3,600,000,000) with their own id, the first of each; others go."""
    r = rows.filter(F.col("area_id") > 3_600_000_000).withColumn("relation", F.col("area_id") - 3_600_000_000)
    return first_by(r, ["place", "relation"], F.col("ord"))


def suggestions(enclosing: DataFrame, most: int = 4) -> DataFrame:
    """place, label, context: areas of levels 4 to 9 from the narrowest on, each with the next three broader names; at most 4 a place."""
    e = enclosing.filter(F.col("level").between(4, 9))
    w = Window.partitionBy("place").orderBy(F.desc("level"), "relation")
    # the next three names after a row, nulls left out: each row has the place of its name among the names
    named = e.withColumn("n", F.row_number().over(w)).withColumn("k", F.count("label").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    names = named.filter(F.col("label").isNotNull() & (F.col("k") <= most + 3)).select("place", F.col("k").alias("at"), F.col("label").alias("name"))
    some = named.filter(F.col("n") <= most)
    after = some.select("place", "n", "k").join(names, "place").filter((F.col("at") > F.col("k")) & (F.col("at") <= F.col("k") + 3))
    context = after.groupBy("place", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ").alias("context"))
    return some.join(context, ["place", "n"], "left").select("place", "relation", "label", F.coalesce("context", F.lit("")).alias("context"), "n")


def level_counts(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def play_area(boundary: DataFrame, multi: str = "multi") -> DataFrame:
    """Adds box, centre and label to boundaries (id, names, multi): the first name that isn't blank, else "OSM relation id"."""
    points = F.flatten(F.flatten(F.col(multi)))
    b = boundary.withColumn("__p", points).withColumn("box", rings.bounds(F.col("__p"))).drop("__p")
    x, y = geo.box_centre(F.col("box"))
    names = F.filter(F.col("names"), lambda n: F.length(F.trim(n)) > 0)
    return b.withColumn("centre_lon", x).withColumn("centre_lat", y).withColumn("label", F.coalesce(F.get(names, F.lit(0)), F.concat(F.lit("OSM relation "), F.col("id").cast("string"))))
