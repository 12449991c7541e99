"""The driver's tables read as points, ways, fields, tags and logs.

Every view is defined twice with the same integer arithmetic: as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("layer"),
        ((F.col("event_id") * 7919 % 36000) / 100.0 - 180.0).alias("lon"),
        ((F.col("event_id") * 104729 % 16000) / 100.0 - 80.0).alias("lat"),
        (F.col("value") / 50.0).alias("mag"),
        (F.col("user_id") * 37 % 700).alias("depth"),
        "value",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("node_id"), ((key * 7919 % 3600) / 10.0 - 180.0).alias("x"), ((key * 104729 % 1600) / 10.0 - 80.0).alias("y"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("tie"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import assemble_ways

    return assemble_ways(refs(spark, sf_dir), nodes(spark, sf_dir), "pos", "node_id", "tie")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    return e.select(F.lit("field").alias("field_id"), F.col("vec_id").cast("int").alias("row"), "col", (F.col("v").cast("double") * 1000.0).alias("value"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("place_id"), F.concat(F.lit("Place "), (key % 20).cast("string")).alias("name"), ((key * 7919 % 400) / 100.0).alias("x"), ((key * 104729 % 300) / 100.0).alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each customer: ids and sides by integer arithmetic."""
    key = F.col("c_custkey")
    x, y = (key * 7919 % 36000) / 100.0 - 180.0, (key * 104729 % 16000) / 100.0 - 80.0
    return table(spark, sf_dir, "customer").select(key.alias("id"), x.alias("min_x"), y.alias("min_y"), (x + (key % 7 + 1) / 10.0).alias("max_x"), (y + (key % 5 + 1) / 10.0).alias("max_y"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with one tag each, out of a list by the part's key, and some with a name."""
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in TAG_KINDS])
    kind = F.get(kinds, (key % len(TAG_KINDS)).cast("int"))
    tag = F.map_from_arrays(F.array(F.split(kind, "=")[0]), F.array(F.split(kind, "=")[1]))
    named = F.map_from_arrays(F.array(F.split(kind, "=")[0], F.lit("name")), F.array(F.split(kind, "=")[1], F.col("p_name")))
    return table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 11 == 0, named).otherwise(tag).alias("tags"), kind.alias("kind"), (key % 11 == 0).alias("named"))


TAG_KINDS = tuple(
    "highway=primary highway=track highway=living_street railway=rail building=yes shop=bakery amenity=cafe natural=coastline place=sea seamark:type=buoy_lateral "
    "seamark:type=wreck seamark:type=light_major seamark:type=gate route=ferry waterway=seaway waterway=river natural=water landuse=basin place=town "
    "leisure=park landuse=grass landuse=forest natural=wood landuse=orchard natural=scrub landuse=quarry barrier=wall power=line landuse=industrial colour=red".split()
)

_KINDS_SQL = "[" + ",".join(f"'{k}'" for k in TAG_KINDS) + "]"

SQL = {
    "v_points": "SELECT event_id, ts, user_id, event_type AS layer, (event_id*7919%36000)/1e2-180 AS lon, (event_id*104729%16000)/1e2-80 AS lat, value/50.0::DOUBLE AS mag, user_id*37%700 AS depth, value FROM events",
    "v_nodes": "SELECT p_partkey AS node_id, (p_partkey*7919%3600)/1e1-180 AS x, (p_partkey*104729%1600)/1e1-80 AS y FROM part",
    "v_refs": "SELECT l_orderkey AS way_id, l_partkey AS node_id, l_linenumber AS pos, l_suppkey AS tie FROM lineitem",
    "v_field": "SELECT 'field' AS field_id, vec_id::INT AS row, (i-1)::INT AS col, embedding[i]::DOUBLE*1000 AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)",
    "v_places": "SELECT s_suppkey AS place_id, 'Place ' || (s_suppkey%20)::VARCHAR AS name, (s_suppkey*7919%400)/1e2 AS x, (s_suppkey*104729%300)/1e2 AS y FROM supplier",
    "v_boxes": "SELECT id, min_x, min_y, min_x+(id%7+1)/1e1 AS max_x, min_y+(id%5+1)/1e1 AS max_y FROM (SELECT c_custkey AS id, (c_custkey*7919%36000)/1e2-180 AS min_x, (c_custkey*104729%16000)/1e2-80 AS min_y FROM customer)",
    "v_tags": f"SELECT p_partkey AS id, {_KINDS_SQL}[(p_partkey%{len(TAG_KINDS)})::INT+1] AS kind, p_partkey%11=0 AS named, p_name FROM part",
}


def with_views(sql: str) -> str:
    """The SQL with the views it names in front."""
    used = ", ".join(f"{k} AS ({v})" for k, v in SQL.items() if k in sql)
    if not used:
        return sql
    return f"WITH {used}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {used} {sql}"
