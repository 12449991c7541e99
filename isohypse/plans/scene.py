"""From sources to a scene: plan, merge, rank, cap, simplify, label, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Box, refused, smooth_line, vertex_mean
from ..functions.tags import road_class
from ..operators.ordered import capped
from ..operators.vector import simplified
from ..sources.model import LAYERS, in_box

Reader = Callable[[SparkSession, Box], DataFrame]


@dataclass
class Registry:
    """Readers by source id; the first registration of an id counts."""

    readers: dict[str, Reader] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def register(self, name: str, reader: Reader) -> bool:
        if name in self.readers:
            self.notes.append(f"{name}: already registered")
            return False
        self.readers[name] = reader
        return True


@dataclass(frozen=True)
class Plan:
    """The sources to read, the base first."""

    base: str
    extras: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.base, *self.extras)


def plan(enabled: list[str], known: list[str], box: Box, heavy: str = "osm") -> Plan | None:
    """The heavy source is the base if enabled, else the first in the known order; it is left out of oversize areas."""
    own = [s for s in known if s in enabled and not (s == heavy and refused(box))]
    if not own:
        return None
    base = heavy if heavy in own else own[0]
    return Plan(base, tuple(s for s in own if s != base))


def fetch(spark: SparkSession, registry: Registry, sources: Plan, box: Box) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources' features in plan order with `plan_pos`, and the errors of those that failed."""
    out, errors = None, {}
    for pos, name in enumerate(sources.order):
        reader = registry.readers.get(name)
        if reader is None:
            errors[name] = "not registered"
            continue
        try:
            part = in_box(reader(spark, box), box).withColumn("plan_pos", F.lit(pos))
        except Exception as e:  # one source's failure leaves the others
            errors[name] = str(e).splitlines()[0]
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, errors


def ordered_layers(features: DataFrame) -> DataFrame:
    """Adds layer_rank: known layers in drawing order, then others by name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return features.withColumn("layer_rank", F.when(rank > 0, rank).otherwise(len(LAYERS) + 1))


def classified_roads(features: DataFrame) -> DataFrame:
    """Roads by class; the plain layer of roads is left empty."""
    own = F.when(F.col("layer") == "roads", road_class(F.element_at("props", "highway"))).otherwise(F.col("layer"))
    return features.withColumn("layer", own)


#: Layers whose lines are smoothed, and those never simplified below a share of their size.
SMOOTHED = ("bathymetry", "contours", "currents", "isotherms")
AREAS = {"buildings": 0.08, "water": 0.2, "parks": 0.2, "forests": 0.2, "fields": 0.2, "natural": 0.2, "landuse": 0.2}


def shaped(features: DataFrame, tolerance: float) -> DataFrame:
    """Simplified and smoothed geometries; an area's tolerance is capped by its smaller side."""
    side = F.least(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    cap = F.lit(float(tolerance))
    for layer, share in AREAS.items():
        cap = F.when(F.col("layer") == layer, F.least(F.lit(float(tolerance)), side * share)).otherwise(cap)
    exploded = features.select("id", "layer", cap.alias("_t"), F.posexplode("geom.parts").alias("part", "rings")).select("id", "layer", "_t", "part", F.posexplode("rings").alias("ring", "line"))
    thin = exploded.withColumn("line", simplified("line", "_t"))
    thin = thin.withColumn("line", F.when(F.col("layer").isin(*SMOOTHED), smooth_line(F.col("line"))).otherwise(F.col("line")))
    rings = thin.groupBy("id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "line"))), lambda r: r.line).alias("rings"))
    parts = rings.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p.rings).alias("parts"))
    return features.join(parts, "id").withColumn("geom", F.struct(F.col("geom.kind").alias("kind"), F.col("parts").alias("parts"))).drop("parts")


def labels(features: DataFrame) -> DataFrame:
    """layer, name, x, y, seq: a label for each named feature, in the order of layers and arrival."""
    at = vertex_mean(F.get(F.get("geom.parts", 0), 0))
    named = features.where(F.element_at("props", "name").isNotNull())
    return named.select("layer", F.element_at("props", "name").alias("name"), at.x.alias("x"), at.y.alias("y"), F.row_number().over(Window.partitionBy("layer").orderBy("plan_pos", "id")).alias("seq"))


def build(features: DataFrame, caps: dict[str, int], default_cap: int = 4000, tolerance: float = 0.0) -> DataFrame:
    """The scene: ranked layers, roads by class, caps by arrival, simplified shapes.

    Named points become labels only, unless they are nautical marks.
    """
    drawn = features.where(~((F.col("geom.kind") == "Point") & ~F.col("layer").startswith("seamark")))
    ranked = ordered_layers(classified_roads(drawn))
    cap = F.lit(default_cap)
    for layer, n in caps.items():
        cap = F.when(F.col("layer") == layer, max(1, n)).otherwise(cap)
    kept = capped(ranked, "layer", ["plan_pos", "id"], cap)
    return shaped(kept, tolerance) if tolerance > 0 else kept


def attribution(credits: list[tuple[str, str]], sources: list[str]) -> list[str]:
    """Statements of the wanted sources in the registry's order, each once."""
    wanted = {s.strip() for text in sources for s in text.replace("+", ",").split(",") if s.strip() and s.strip() != "none"}
    return list(dict.fromkeys(statement for name, statement in credits if name in wanted))
