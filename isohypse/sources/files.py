"""What kind of file a path is, and the reader for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import Box
from ..operators.tiles import tile_range
from ..session import cut
from . import binary, geojson, registered
from .model import in_box, with_extent

#: Formats by ending.
ENDINGS = {"geojson": ".geojson .json", "ndjson": ".ndjson .geojsonl", "shapefile": ".shp", "mbtiles": ".mbtiles", "pmtiles": ".pmtiles", "osm_pbf": ".pbf", "parquet": ".parquet"}


#: Formats that a folder is taken for, in order, by the files in it.
FOLDERS = ("geojson", "shapefile")


def sniff(path: str) -> str:
    """The format of a path by its ending; of a folder by the files in it and, for shapefiles, in its folders; or unknown."""
    low = path.lower().rstrip("/")
    kind = next((kind for kind, ends in ENDINGS.items() if low.endswith(tuple(ends.split()))), "unknown")
    if kind != "unknown":
        return kind
    try:
        inside = registered.found(path, ("",))
    except (FileNotFoundError, OSError, ValueError):
        return "unknown"
    near = {kind for x in inside if x.count("/") == path.rstrip("/").count("/") + 1 for kind, ends in ENDINGS.items() if x.lower().endswith(tuple(ends.split()))}
    if any(x.count("/") == path.rstrip("/").count("/") + 2 and x.lower().endswith(".shp") for x in inside):
        near.add("shapefile")
    return next((k for k in (*FOLDERS, *(k for k in ENDINGS if k not in FOLDERS)) if k in near), "unknown")


def read(spark: SparkSession, path: str, box: Box | None = None, kind: str | None = None, source: str = "file", zoom: int = 14) -> DataFrame:
    """Features of files in any of the feature formats, within the box.

    Vector tiles are read at the zoom that is nearest to the given one, and only those that
    the box covers.
    """
    kind = kind or sniff(path)
    if kind == "geojson":
        out = geojson.read(spark, registered.found(path, ENDINGS["geojson"].split(), deep=False), source)
    elif kind == "ndjson":
        out = geojson.read_lines(spark, path, source)
    elif kind == "shapefile":
        out = with_extent(binary.read_shapefiles(spark, path, source))
    elif kind == "osm_pbf":
        out = registered.pbf_features(cut(registered.load(spark, "osm_pbf", path)), source)
    elif kind in ("mbtiles", "pmtiles"):
        tiles = None
        for archive in registered.found(path, (f".{kind}",)):
            z = registered.held_zoom(archive, zoom)
            if z is None:  # an archive without tiles
                continue
            x0, x1, y0, y1 = tile_range(box, z) if box else (0, (1 << z) - 1, 0, (1 << z) - 1)
            own = registered.load(spark, "vector_tiles", archive, z=z, x=(x0, x1), y=(y0, y1))
            tiles = own if tiles is None else tiles.unionByName(own)
        if tiles is None:
            raise ValueError(f"no tiles in {path}")
        out = with_extent(binary.tile_features(tiles, source))
    elif kind == "parquet":
        out = spark.read.parquet(path)
    else:
        raise ValueError(f"no features in {kind} files of {path}")
    return in_box(out, box) if box else out
