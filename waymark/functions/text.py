"""Names, identifiers, colours, JSON and links. Column expressions where Spark has the pieces; Arrow UDFs for Unicode forms."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- Unicode forms (Spark SQL has no normalisation function)


@F.pandas_udf(T.StringType())
def search_key(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks U+0300-U+036F, in lower case. Null stays null."""
    return names.map(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFKD", s) if not "̀" <= x <= "ͯ").lower())


@F.pandas_udf(T.StringType())
def nfkc_lower(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def one_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip_affixes(col: Column, suffixes: list[str]) -> Column:
    """Listed suffixes go from the end, one after the other, with the space before them; a name that is nothing else becomes empty."""
    for s in suffixes:
        col = F.regexp_replace(col, rf"\s*\Q{s.lower()}\E$", "")
    return F.trim(col)


def station_key(col: Column, suffixes: list[str]) -> Column:
    """The form in which station names are compared."""
    return strip_affixes(one_space(nfkc_lower(col)), suffixes)


#: Words that name a direction of travel, endings that do after a dash, and prefixes of a route's type.
DIRECTIONS_CJK = ("順向", "逆向", "上り", "下り", "往程", "返程", "西向", "東向", "北向", "南向", "順行", "逆行")
DIRECTIONS = ("inbound", "outbound")
DASH_ENDINGS = ("north", "south", "east", "west", "inbound", "outbound", "北", "南", "東", "西")
TYPE_PREFIXES = ("列車", "train")


def line_name(col: Column) -> Column:
    """A route name without what tells its variants apart: type prefix, parentheses, arrow tails, directions, lone numbers."""
    arrow = "(?:[→⇒←⇐↔]|->)"
    for pattern in (
        rf"(?iu)^(?:{'|'.join(TYPE_PREFIXES)})[ \u3000]+", r"[(（][^)）]+[)）]", rf"\s+\S*?{arrow}.*$", rf"{arrow}.*$", "|".join(DIRECTIONS_CJK), rf"(?iU)\b(?:{'|'.join(DIRECTIONS)})\b",
        rf"(?iu)\s*-\s*(?:{'|'.join(DASH_ENDINGS)})$", r"\b\d+\b", r"^\s*-\s*|\s+-\s*$",
    ):
        col = F.trim(F.regexp_replace(col, pattern, "" if pattern.startswith("(?iu)^") else " "))
    return one_space(col)


def line_key(col: Column) -> Column:
    return F.lower(line_name(nfkc_lower(col)))


def normalise_operator(col: Column, variants: dict[str, list[str]]) -> Column:
    """An operator's canonical name: an exact variant's, else that of the first variant contained in the text, else the text."""
    pairs = [(v, k) for k, vs in variants.items() for v in (k, *vs)]
    exact = F.create_map(*(F.lit(x) for v, k in dict(pairs).items() for x in (v, k))) if pairs else F.lit(None)
    out = F.try_element_at(exact, col) if pairs else F.lit(None).cast("string")
    for v, k in pairs:
        out = F.coalesce(out, F.when(F.contains(col, F.lit(v)), F.lit(k)))
    return F.coalesce(out, col)


def split_operators(col: Column, variants: dict[str, list[str]]) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ";"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: normalise_operator(x, variants))


def name_variants(tags: Column, keys: list[str]) -> Column:
    """Distinct non-empty names under the keys, in their order; alternatives are split at semicolons."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")), ";") for k in keys)))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def shorter_name(name: Column, alternatives: Column) -> Column:
    """The shortest of the ``;``-separated alternatives if it is shorter than the name; the name wins ties."""
    alts = F.filter(F.transform(F.split(F.coalesce(alternatives, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    best = F.array_min(F.transform(alts, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.when(best.isNotNull() & (name.isNull() | (best["n"] < F.length(name))), best["x"]).otherwise(name)


def utf16_length(col: Column) -> Column:
    """UTF-16 code units: code points, and one more for each beyond U+FFFF (4 bytes in UTF-8)."""
    return F.length(col) + F.regexp_count(col, F.lit("[\\x{10000}-\\x{10FFFF}]"))


# --- identifiers


def uri_component(col: Column) -> Column:
    """Percent-encoding of all but A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(col)
    for a, b in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def gtfs_id(kind: str, namespace: Column, own: Column) -> Column:
    """gtfs:namespace:kind:id; an empty part raises an error."""
    ok = (F.length(namespace) > 0) & (F.length(own) > 0)
    return F.when(ok, F.concat(F.lit("gtfs:"), uri_component(namespace), F.lit(f":{kind}:"), uri_component(own))).otherwise(F.raise_error(F.lit("an id has an empty part")).cast("string"))


def osm_id(kind: Column, own: Column) -> Column:
    """osm:type:id for positive ids; others raise an error."""
    return F.when(own > 0, F.concat_ws(":", F.lit("osm"), kind, own)).otherwise(F.raise_error(F.lit("an id is not positive")).cast("string"))


def osm_key(kind: Column, own: Column) -> Column:
    return F.concat_ws("/", kind, own)


def is_route_id(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(r"^(gtfs:[^:]+:route:[^:]+|osm:relation:[1-9]\d*)$")), F.lit(False))


def is_station_id(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(r"^(gtfs:[^:]+:stop:[^:]+|osm:(node|way|relation):[1-9]\d*)$")), F.lit(False))


def relation_id(col: Column) -> Column:
    """Digits of a positive, exactly representable integer; else null."""
    n = F.when(F.rlike(col, F.lit(r"^\d{1,17}$")), col).try_cast("long")
    return F.when((n > 0) & (n <= 2**53 - 1), n)


def osm_type(prefix: Column) -> Column:
    """0 node, 1 way, 2 relation, from the first letter of an id; unknown ones count as nodes."""
    p = F.lower(F.substring(prefix, 1, 1))
    return F.when(p == "w", 1).when(p == "r", 2).otherwise(0).cast("int")


# --- colours


@F.pandas_udf(T.IntegerType())
def hash_hue(names: pd.Series) -> pd.Series:
    """A hue from a name: the 32-bit times-33 hash over UTF-16 code units, its absolute value modulo 360."""

    def hue(s: str) -> int:
        h = _times33(s)
        return (h if h < 1 << 31 else (1 << 32) - h) % 360

    return names.map(lambda s: None if s is None else hue(s)).astype("Int32")


def hsl_hex(h: Column, s: float = 0.65, light: float = 0.45) -> Column:
    """#rrggbb of a hue in degrees at fixed saturation and lightness."""
    a = s * min(light, 1 - light)

    def channel(n: int) -> Column:
        k = (F.lit(float(n)) + h / 30) % 12
        v = F.lit(light) - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lower(F.lpad(F.hex(F.floor(v * 255 + 0.5).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def line_colour(tag: Column, configured: Column, operator: Column, key: Column) -> Column:
    """The tag's colour, the configured one, the operator's, or one from the key's hash."""
    return F.coalesce(normalise_colour(tag), normalise_colour(configured), normalise_colour(operator), hsl_hex(hash_hue(key)))


def normalise_colour(col: Column, fallback: str | None = None) -> Column:
    return F.when(F.length(F.trim(col)) > 0, F.when(F.startswith(F.trim(col), F.lit("#")), F.trim(col)).otherwise(F.concat(F.lit("#"), F.trim(col)))).otherwise(F.lit(fallback))


def _times33(s: str) -> int:
    """The times-33 hash over UTF-16 code units, as 32 bits without sign."""
    h, raw = 5381, s.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = (h * 33 + int.from_bytes(raw[k : k + 2], "little")) & 0xFFFFFFFF
    return h


def _base36(n: int) -> str:
    out = ""
    while n or not out:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


@F.pandas_udf(T.StringType())
def slug(names: pd.Series) -> pd.Series:
    """Lower-case ASCII words joined by dashes if 5 characters or more come out; else with a base-36 hash that tells names apart."""

    def one(s: str) -> str:
        plain = re.sub(r"[^a-z0-9]+", "-", s.lower())
        plain = plain.removeprefix("-").removesuffix("-")
        return plain if len(plain) >= 5 else f"{plain}-{_base36(_times33(s))}" if plain else f"op{_base36(_times33(s))}"

    return names.map(lambda s: None if s is None else one(s))


# --- text of queries, candidates and summaries


def tag_filter(tags: Column) -> Column:
    """["k"="v"]["k"] for an array of (key, value), value null for mere presence."""
    return F.array_join(F.transform(tags, lambda t: F.when(t["value"].isNull(), F.concat(F.lit('["'), t["key"], F.lit('"]'))).otherwise(F.concat(F.lit('["'), t["key"], F.lit('"="'), t["value"], F.lit('"]')))), "")


def around_query(filters: Column, lon: Column, lat: Column, radius: Column, kinds: tuple[str, ...] = ("node", "way", "relation")) -> Column:
    """The text of a request for all elements with tags within a radius."""
    at = F.concat(F.lit("(around:"), radius.cast("long"), F.lit(","), lat, F.lit(","), lon, F.lit(");"))
    return F.concat(F.lit("[out:json][timeout:25];("), *(F.concat(F.lit(k), filters, at) for k in kinds), F.lit(");out center tags qt;"))


def box_query(filters: Column, box: Column, kinds: tuple[str, ...] = ("node", "way", "relation")) -> Column:
    """The same within a box, given as south, west, north, east."""
    at = F.concat(F.lit("("), F.concat_ws(",", *(box[k] for k in "swne")), F.lit(");"))
    return F.concat(F.lit("[out:json][timeout:25];("), *(F.concat(F.lit(k), filters, at) for k in kinds), F.lit(");out center tags qt;"))


STATION_FILTERS = ('["railway"="station"]', '["station"="subway"]')


def station_query(lon: Column, lat: Column, radius: Column) -> Column:
    """Nodes and ways that are railway or subway stations within a radius: four branches."""
    at = F.concat(F.lit("(around:"), radius.cast("long"), F.lit(","), lat, F.lit(","), lon, F.lit(");"))
    return F.concat(F.lit("[out:json][timeout:25];("), *(F.concat(F.lit(k + f), at) for f in STATION_FILTERS for k in ("node", "way")), F.lit(");out center tags qt;"))


def station_box_query(box: Column) -> Column:
    at = F.concat(F.lit("("), F.concat_ws(",", *(box[k] for k in "swne")), F.lit(");"))
    return F.concat(F.lit("[out:json][timeout:25];("), *(F.concat(F.lit(k + f), at) for f in STATION_FILTERS for k in ("node", "way")), F.lit(");out center tags qt;"))


def candidate_name(name: Column, name_length: Column, iata: Column) -> Column:
    """name, then its length and its airport code in parentheses where there are any."""
    p = lambda v: F.when(v.isNotNull(), F.concat(F.lit("("), v.cast("string"), F.lit(")")))
    return F.concat_ws(" ", name, p(name_length), p(iata))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def leading_int(col: Column) -> Column:
    """The integer a text begins with, after white space; null if none."""
    return F.nullif(F.regexp_extract(col, r"^\s*([+-]?\d{1,15})", 1), F.lit("")).try_cast("long")


def decode_entities(col: Column) -> Column:
    """Numeric and the five named XML references; &amp; last, so that nothing is decoded twice."""

    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return F.replace(_numeric(col), F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(T.StringType())
def _numeric(texts: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 else m[0]

    return texts.map(lambda s: None if s is None else re.sub(r"&#[xX]([0-9A-Fa-f]{1,6});|&#(\d{1,7});", one, s))


# --- share links: canonical JSON, raw deflate, unpadded base64url


def base64url(col: Column) -> Column:
    """Bytes as unpadded base64url."""
    return F.regexp_replace(F.translate(F.base64(col), "+/\r\n", "-_"), "=+$", "")


def canonical(value):
    """Keys in order at every level, nulls of objects dropped."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value) if value[k] is not None}
    return [canonical(x) for x in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null for text that isn't JSON."""

    def one(s):
        try:
            return json.dumps(canonical(json.loads(s)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


@F.pandas_udf(T.BinaryType())
def deflate(texts: pd.Series) -> pd.Series:
    """UTF-8, raw deflate."""

    def one(s):
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        return None if s is None else z.compress(s.encode()) + z.flush()

    return texts.map(one)


#: The largest payload that is inflated, and the version that is read.
INFLATE_LIMIT, ENVELOPE_VERSION = 1 << 20, 1


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("payload", T.StringType())]))
def decode_envelope(texts: pd.Series) -> pd.DataFrame:
    """status (ok, invalid-base64url, inflate-failed, invalid-json, unsupported-version, schema-invalid) and the payload."""

    def one(s):
        if not s or not re.fullmatch(r"[A-Za-z0-9_-]+", s) or len(s) % 4 == 1:
            return "invalid-base64url", None
        raw = base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))
        try:
            z = zlib.decompressobj(-15)
            text = z.decompress(raw, INFLATE_LIMIT)
            if not z.eof:
                return "inflate-failed", None
            value = json.loads(text.decode())
        except zlib.error:
            return "inflate-failed", None
        except (UnicodeDecodeError, ValueError):
            return "invalid-json", None
        if not isinstance(value, dict):
            return "schema-invalid", None
        if value.get("v") != ENVELOPE_VERSION:
            return "unsupported-version", None
        return "ok", json.dumps(canonical(value), separators=(",", ":"), ensure_ascii=False)

    return pd.DataFrame([one(s) for s in texts], columns=["status", "payload"])


def encode_envelope(payload: Column) -> Column:
    return base64url(deflate(canonical_json(payload)))


def link_payload(url: Column) -> Column:
    """The ``d`` parameter of a link; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"[?&#]d=([A-Za-z0-9_-]+)", 1), F.lit(""))
