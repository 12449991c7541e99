"""String expressions: coordinates in text, numbers, names, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?"


def numbers(text: Column) -> Column:
    """All decimal numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))


def parse_coordinates(text: Column) -> Column:
    """struct kind, a, b, c, d: a box of four numbers or a point of two (lat, lon), or null.

    Four numbers are read as west, south, east, north if that is a box, else as two
    lat, lon pairs.  Of two numbers the first is the latitude unless only the second can be.
    """
    n = numbers(text)
    v = [F.get(n, i) for i in range(4)]
    ok = lambda w, s, e, t: (w < e) & (s < t) & w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & t.between(-90, 90)
    box = lambda w, s, e, t: F.struct(F.lit("box").alias("kind"), w.alias("a"), s.alias("b"), e.alias("c"), t.alias("d"))
    native = box(v[0], v[1], v[2], v[3])
    low, high = (lambda x, y: F.least(x, y)), (lambda x, y: F.greatest(x, y))
    pairs = [low(v[1], v[3]), low(v[0], v[2]), high(v[1], v[3]), high(v[0], v[2])]
    none = F.lit(None).cast("double")
    point = lambda lat, lon: F.struct(F.lit("point").alias("kind"), lat.alias("a"), lon.alias("b"), none.alias("c"), none.alias("d"))
    is_point = lambda lat, lon: lat.between(-90, 90) & lon.between(-180, 180)
    return (
        F.when((F.size(n) == 4) & ok(*v), native)
        .when((F.size(n) == 4) & ok(*pairs), box(*pairs))
        .when((F.size(n) == 2) & is_point(v[0], v[1]), point(v[0], v[1]))
        .when((F.size(n) == 2) & is_point(v[1], v[0]), point(v[1], v[0]))
    )


def fold_name(name: Column) -> Column:
    """Without regard to case and to the commoner diacritics."""
    return F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def file_stem(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def svg_id(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("layer_"), clean)).otherwise(clean)


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def thousands(number: Column) -> Column:
    """A space every three digits, from five digits on."""
    text = number.cast("string")
    return F.when(F.abs(number) > 9999, F.regexp_replace(text, r"(?<=\d)(?=(\d{3})+$)", " ")).otherwise(text)


def compact_number(value: Column, places: int = 6) -> Column:
    """Fixed places without trailing zeros; 0 for what isn't finite and for negative zero."""
    fixed = F.format_string(f"%.{places}f", value)
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, "0").when(short == "-0", "0").otherwise(short)


def format_distance(value: Column, crs: Column) -> Column:
    metric = F.when(value >= 1000, F.format_string("%.1f km", value / 1000)).otherwise(F.format_string("%.0f m", value))
    return F.when(crs == "EPSG:4326", F.format_string("%.3f°", value)).when(crs.isin("EPSG:3857", "EQUAL_EARTH", "LOCAL_AZIMUTHAL_EQUIRECTANGULAR"), metric).otherwise(F.format_string("%.2f units", value))


def humanise(text: Column) -> Column:
    words = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def detail_text(display_name: Column, name: Column) -> Column:
    """A display name's parts without a leading name."""
    parts = F.transform(F.split(display_name, ","), lambda p: F.trim(p))
    rest = F.when(F.get(parts, 0) == name, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.array_join(F.filter(rest, lambda p: p != ""), ", ")


def quadrant(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("west")
    for q in ("west", "east", "south", "north"):
        out = F.when(low.contains(q), q).otherwise(out)
    return out


def safe_name(text: Column) -> Column:
    return (F.length(text) > 0) & ~text.rlike(r"[/\\\x00]") & ~text.contains("..") & ~text.startswith(".")


def cache_key(box: list[Column], layers: Column) -> Column:
    return F.sha2(F.concat(F.format_string("%.6f,%.6f,%.6f,%.6f|", *box), F.array_join(F.array_sort(layers), ",")), 256)


def iso_from_millis(ms: Column) -> Column:
    """UTC; '' where the time is missing."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def split_last_dot(key: Column) -> Column:
    """struct source, key of 'source.key', split at the last dot."""
    return F.struct(F.regexp_extract(key, r"^(.*)\.[^.]*$", 1).alias("source"), F.substring_index(key, ".", -1).alias("key"))
