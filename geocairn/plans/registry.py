"""Where the queries register themselves, and what several of them share: tables and places derived from keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-30"


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader t(name); sql is what DuckDB answers alike."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def place(key: str | Column) -> list[Column]:
    """lng and lat of a place derived from a whole-number key, within two degrees of (10, 59)."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    return [(10 + (k * 7919 % 10007).cast("double") / 10007.0 * 2).alias("lng"), (59 + (k * 104729 % 10007).cast("double") / 10007.0 * 2).alias("lat")]


def lng_sql(k: str) -> str:
    return f"(10 + ({k} * 7919 % 10007)::DOUBLE / 10007.0::DOUBLE * 2)"


def lat_sql(k: str) -> str:
    return f"(59 + ({k} * 104729 % 10007)::DOUBLE / 10007.0::DOUBLE * 2)"


def metres_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"


def tile_x_sql(lng: str, zoom: int) -> str:
    return f"cast(floor(({lng} + 180) / 360.0::DOUBLE * {1 << zoom}) as INTEGER)"


def tile_y_sql(lat: str, zoom: int) -> str:
    return f"cast(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {1 << zoom}) as INTEGER)"


def routes(t) -> DataFrame:
    """route_id (a user) and line: the places of the user's events in time order."""
    e = t("events").where("user_id is not null").select(F.col("user_id").alias("route_id"), "ts", "event_id", *place("event_id"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lng", "lat"))), lambda p: geo.point(p["lng"], p["lat"]))
    return e.groupBy("route_id").agg(line.alias("line"))


def boxes(t) -> DataFrame:
    """polygon_id (a nation) and rings: one closed rectangle."""
    n = F.col("n_nationkey")
    x, y = 10.013 + (n % 5) * 0.4, 59.017 + F.floor(n / 5) * 0.4
    ring = F.array(geo.point(x, y), geo.point(x + 0.35, y), geo.point(x + 0.35, y + 0.35), geo.point(x, y + 0.35), geo.point(x, y))
    return t("nation").select(n.alias("polygon_id"), F.array(ring).alias("rings"))


BOX_SQL = "select n_nationkey as polygon_id, 10.013::DOUBLE + (n_nationkey % 5) * 0.4::DOUBLE as x0, 59.017::DOUBLE + (n_nationkey // 5) * 0.4::DOUBLE as y0 from nation"


def visits(t) -> DataFrame:
    """Facts with evidence: user_id (a customer), feature_id (a part) and activity_ids, the customer's orders that hold it."""
    pairs = t("orders").select("o_orderkey", F.col("o_custkey").alias("user_id")).join(t("lineitem").select("l_orderkey", F.col("l_partkey").alias("feature_id")), F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.groupBy("user_id", "feature_id").agg(F.array_sort(F.collect_set("o_orderkey")).alias("activity_ids"))


VISITS_SQL = "select o_custkey as user_id, l_partkey as feature_id, list_sort(list(distinct o_orderkey)) as activity_ids from orders join lineitem on o_orderkey = l_orderkey group by all"
