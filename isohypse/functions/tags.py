"""Map features' tags to layers: ordered rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nautical mark types by layer, and prefixes for types not named.
SEAMARK_TYPES = {
    "seamark_lights": ("landmark",),
    "seamark_buoys": ("mooring",),
    "seamark_beacons": ("daymark", "pile", "cairn", "topmark"),
    "seamark_hazards": ("wreck", "rock", "obstruction", "foul_ground", "cable_submarine", "pipeline_submarine"),
    "seamark_harbours": ("harbour", "harbour_basin", "anchorage", "anchor_berth", "berth", "mooring_area", "pilot_boarding_place", "small_craft_facility", "distance_mark"),
}
SEAMARK_AREAS = ("restricted_area", "caution_area", "precautionary_area", "military_area", "cable_area", "pipeline_area", "dredged_area", "fairway", "navigation_line", "recommended_track", "deep_water_route", "inshore_traffic_zone")
SEAMARK_PREFIXES = (("buoy_", "seamark_buoys"), ("beacon_", "seamark_beacons"), ("light", "seamark_lights"), ("separation_", "seamark_areas"))

#: Tag values of the land-cover layers.
PARK_LEISURE = ("park", "garden", "nature_reserve", "playground", "sports_centre", "pitch")
PARK_LANDUSE = ("grass", "recreation_ground", "village_green", "park", "allotments")
FIELD_LANDUSE = ("farmland", "meadow", "orchard", "vineyard", "farmyard", "greenhouse_horticulture")
NATURAL_KINDS = ("beach", "cliff", "scrub", "heath", "wetland", "grassland", "fell", "moor")
AREA_KEYS = ("building", "landuse", "leisure", "natural", "water", "area")

#: Road classes by the highway tag.
ROAD_CLASSES = {
    "motorway": ("motorway", "motorway_link"),
    "trunk": ("trunk", "trunk_link"),
    "primary": ("primary", "primary_link"),
    "secondary": ("secondary", "secondary_link"),
    "tertiary": ("tertiary", "tertiary_link"),
    "residential": ("residential", "living_street", "unclassified"),
    "service": ("service", "track", "path", "footway", "cycleway", "pedestrian"),
}


def seamark_layer(kind: Column) -> Column:
    """The layer of a mark's type: exact types first, then prefixes, then areas; null if blank."""
    value = F.lower(F.trim(kind))
    out = F.when(kind.isNull() | (value == ""), None)
    for layer, types in SEAMARK_TYPES.items():
        out = out.when(value.isin(*types), layer)
    out = out.when(value.isin(*SEAMARK_AREAS), "seamark_areas")
    for prefix, layer in SEAMARK_PREFIXES:
        out = out.when(value.startswith(prefix), layer)
    return out.otherwise("seamark_areas")


def is_route(tags: Column) -> Column:
    tag = lambda k: F.element_at(tags, k)
    return F.coalesce(tag("route") == "ferry", F.lit(False)) | F.coalesce(tag("waterway").isin("seaway", "fairway"), F.lit(False))


def classify(tags: Column) -> Column:
    """The layer of a feature's tags, or null; the first rule that fits counts."""
    has = lambda k: F.element_at(tags, k).isNotNull()
    tag = lambda k: F.coalesce(F.element_at(tags, k), F.lit(""))
    natural, landuse, place = tag("natural"), tag("landuse"), tag("place")
    rules = (
        (has("railway"), "railways"),
        (has("highway"), "roads"),
        (has("building"), "buildings"),
        (has("shop"), "shops"),
        (has("amenity"), "amenities"),
        ((natural == "coastline") | place.isin("sea", "ocean"), "coastline"),
        (seamark_layer(F.element_at(tags, "seamark:type")).isNotNull(), seamark_layer(F.element_at(tags, "seamark:type"))),
        (is_route(tags), "ferry_routes"),
        ((natural == "water") | has("waterway") | has("water") | landuse.isin("reservoir", "basin"), "water"),
        ((place != "") | (tag("name") != ""), "places"),
        (tag("leisure").isin(*PARK_LEISURE) | landuse.isin(*PARK_LANDUSE), "parks"),
        ((landuse == "forest") | natural.isin("wood", "tree_row"), "forests"),
        (landuse.isin(*FIELD_LANDUSE), "fields"),
        (natural.isin(*NATURAL_KINDS) | landuse.isin("brownfield", "quarry"), "natural"),
        (tag("barrier") != "", "barriers"),
        (tag("power") != "", "power"),
        (landuse != "", "landuse"),
    )
    out = F.when(tags.isNull(), None)
    for fits, layer in rules:
        out = out.when(fits, layer)
    return out


def can_be_polygon(tags: Column) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in AREA_KEYS]))


def road_class(highway: Column) -> Column:
    out = F.when(highway.isNull(), "roads_other")
    for name, values in ROAD_CLASSES.items():
        out = out.when(highway.isin(*values), f"roads_{name}")
    return out.otherwise("roads_other")


def name_of(props: Column) -> Column:
    """First name that isn't blank, by aliases, whatever the keys' case."""
    low = F.transform_keys(props, lambda k, v: F.lower(k))
    keys = ("name", "name_en", "nameascii", "name_long", "admin")
    return F.coalesce(*[F.when(F.trim(F.element_at(low, k)) != "", F.trim(F.element_at(low, k))) for k in keys])
