"""Stored map features: composed tile fetches, deletes, boundaries that changes make due, countries of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, kernels, text
from . import spatial


def element_geometry(elements: DataFrame) -> DataFrame:
    """elements (type, line, outers: the lines of a relation's outer members) with rings, closed outer rings, or null.

    A way of three points or more is closed if it isn't, and needs four points then; a relation's outer members are joined end to end.
    """
    closed = F.when(F.col("line")[0] == F.element_at("line", -1), F.col("line")).otherwise(F.concat("line", F.slice("line", 1, 1)))
    way = F.when((F.size("line") >= 3) & (F.size(closed) >= 4), F.array(closed))
    relation = kernels.assemble_rings("outers")
    rings = F.when(F.col("type") == "relation", F.when(F.size(relation) > 0, relation)).when(F.col("type") == "way", way)
    return elements.withColumn("rings", rings)


def fetch_tiles(features: DataFrame, tiles: DataFrame, kind: str) -> DataFrame:
    """The features of a kind on tiles (x, y): markers of empty tiles left out, pointers (stored_id) followed to what they point to wherever
    that is stored, each id once, from its least tile (of several rows of one id there, the least by their other columns).

    features: id, kind, x, y, stored_id, is_empty and more. Filters by kind and columns reach the scan; the pointers are few and meet
    the stored rows in a semi-join.
    """
    of_kind = features.where((F.col("kind") == kind) & ~F.coalesce("is_empty", F.lit(False)))
    here = of_kind.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi")
    pointed = here.where("stored_id is not null").select(F.col("stored_id").alias("id")).distinct()
    stored = of_kind.where("stored_id is null").join(pointed, "id", "left_semi")
    both = here.where("stored_id is null").select(*features.columns).unionByName(stored.select(*features.columns))
    plain = [f.name for f in features.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in ("id", "x", "y")]
    first = F.min_by(F.struct(*features.columns), F.struct("x", "y", *plain))
    return both.groupBy("id").agg(first.alias("f")).select("f.*")


def missing_tiles(features: DataFrame, tiles: DataFrame, kind: str) -> DataFrame:
    """Tiles on which nothing of the kind is stored, not even the marker of an empty tile."""
    return tiles.select("x", "y").distinct().join(features.where(F.col("kind") == kind).select("x", "y"), ["x", "y"], "left_anti")


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys are among gone's; null keys are equal to each other."""
    marked = gone.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(marked, same, "left_anti")


def delete_accounts(tables: dict[str, tuple[DataFrame, str]], users: DataFrame) -> dict[str, DataFrame]:
    """Each table (rows, name of its user column) without the rows of users (user_id)."""
    return {name: delete_by_key(rows, users.select(F.col("user_id").alias(column)), [column]) for name, (rows, column) in tables.items()}


def retract_deleted(facts: DataFrame, deleted: DataFrame, ids: str = "activity_ids", activity: str = "activity_id") -> DataFrame:
    """facts (user_id, feature_id, ids) that deletions (user_id, activity) touch: the ids left, each once, and action, delete or patch.

    Deletions are folded by user before they meet the facts, and only facts that hold one go on.
    """
    by_user = deleted.groupBy("user_id").agg(F.collect_set(activity).alias("__gone"))
    hit = facts.join(by_user, "user_id").where(F.arrays_overlap(ids, "__gone"))
    left = hit.withColumn(ids, F.array_distinct(F.array_except(ids, "__gone"))).drop("__gone")
    return left.withColumn("action", F.when(F.size(ids) == 0, "delete").otherwise("patch"))


def should_enrich(kind: Column, feature_id: Column, stored_id: Column, version: Column, current: int) -> Column:
    """Whether a boundary's metrics are due: stored itself, and made by no version, an unreadable one or an older one."""
    stored = (kind == "adminBoundary") & ~feature_id.startswith("empty-") & stored_id.isNull()
    return F.coalesce(stored, F.lit(False)) & F.coalesce(version.try_cast("int") < current, F.lit(True))


def triggers_enrichment(kind: Column, feature_id: Column, stored_id: Column, centroid: Column) -> Column:
    """Whether a changed feature makes the boundaries about it due: a stored peak or protected area with a centroid."""
    return F.coalesce(kind.isin("peak", "protectedArea") & ~feature_id.startswith("empty-") & stored_id.isNull() & centroid.isNotNull(), F.lit(False))


def due_boundaries(changed: DataFrame, boundaries: DataFrame, zoom: int = 8) -> DataFrame:
    """polygon_id of each boundary that holds the centroid of a changed feature (feature_id, kind, stored_id, centroid), once."""
    due = changed.where(triggers_enrichment(F.col("kind"), F.col("feature_id"), F.col("stored_id"), F.col("centroid")))
    points = due.select(F.col("feature_id").alias("point_id"), "centroid.lng", "centroid.lat")
    return spatial.points_in_polygons(points, boundaries, zoom).select("polygon_id").distinct()


def boundary_countries(boundaries: DataFrame, countries: DataFrame, zoom: int = 6) -> DataFrame:
    """boundaries (polygon_id, centroid, tags) with country_id and country_code: of the countries (polygon_id, rings, country_code) that hold
    the centroid the least id; where none does, or it has no code, the code in the boundary's own tags."""
    points = boundaries.where("centroid is not null").select(F.col("polygon_id").alias("point_id"), "centroid.lng", "centroid.lat")
    found = spatial.points_in_polygons(points, countries.select("polygon_id", "rings"), zoom).groupBy("point_id").agg(F.min("polygon_id").alias("country_id"))
    named = found.join(countries.select(F.col("polygon_id").alias("country_id"), "country_code"), "country_id").withColumnRenamed("point_id", "polygon_id")
    out = boundaries.join(named, "polygon_id", "left")
    return out.withColumn("country_code", F.coalesce("country_code", text.country_of_tags(F.col("tags"))))


def with_country_names(rows: DataFrame, code: str, countries: DataFrame, name: str = "country") -> DataFrame:
    """rows with the name of their country: of the countries (country_code, name) of that code without case (of several the least name), else the code itself."""
    named = countries.where("country_code is not null and name is not null").groupBy(F.upper(F.trim("country_code")).alias("__code")).agg(F.min("name").alias("__name"))
    return rows.withColumn("__code", F.upper(F.trim(F.col(code)))).join(named, "__code", "left").withColumn(name, F.coalesce("__name", F.col(code))).drop("__code", "__name")


def has_code(tags: Column, names: list[str], codes: list[str]) -> Column:
    """Whether any of the tags holds one of the codes, without case."""
    held = F.filter(F.array(*[F.upper(F.try_element_at(tags, F.lit(n))) for n in names]), lambda v: v.isNotNull())
    return F.coalesce(F.arrays_overlap(held, F.array(*[F.lit(c.upper()) for c in codes])), F.lit(False))


def containing_with_level(points: DataFrame, boundaries: DataFrame, level: int, zoom: int = 8) -> DataFrame:
    """Boundaries (polygon_id, admin_level, rings) of a level that hold any of the points (point_id, lng, lat), each once."""
    return spatial.points_in_polygons(points, boundaries.where(F.col("admin_level") == level), zoom).select("polygon_id").distinct()


def route_regions(routes: DataFrame, boundaries: DataFrame, zoom: int = 8, at_most: int | None = 120) -> DataFrame:
    """Pairs route_id, polygon_id: boundaries that hold one of the route's vertices, of which every so many are tested, at most as said (a sample, as
    the rule has it; with at_most None all are, and the answer is exact); a route whose tiles meet one boundary alone is in it without a test, and one in none of those its tiles meet counts for all of them."""
    step = F.greatest(F.lit(1), F.ceil(F.size("line") / (at_most or 1)).cast("int"))
    sampled = F.col("line") if at_most is None else F.when(F.size("line") <= at_most, F.col("line")).otherwise(F.filter("line", lambda p, i: (i % step == 0) | (i == F.size("line") - 1)))
    vertices = routes.select("route_id", F.explode(sampled).alias("v")).select("route_id", "v.lng", "v.lat", geo.tile_x(F.col("v.lng"), zoom).alias("x"), geo.tile_y(F.col("v.lat"), zoom).alias("y"))
    cover = spatial.polygon_tiles(boundaries.select("polygon_id", "rings"), zoom).select("polygon_id", "x", "y")
    near = vertices.select("route_id", "x", "y").distinct().join(cover, ["x", "y"]).select("route_id", "polygon_id").distinct()
    inside = spatial.points_in_polygons(vertices.select(F.col("route_id").alias("point_id"), "lng", "lat"), boundaries, zoom).withColumnRenamed("point_id", "route_id")
    marked = near.join(inside.withColumn("__in", F.lit(True)), ["route_id", "polygon_id"], "left")
    by_route = marked.groupBy("route_id").agg(F.count("*").alias("__n"), F.count("__in").alias("__k"))
    return marked.join(by_route, "route_id").where("__in or __n = 1 or __k = 0").select("route_id", "polygon_id")
