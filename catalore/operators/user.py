"""Bookmarks and boards: lists, rankings, versions, associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.fts import prefix_terms
from catalore.plans.compile import item_set
from catalore.plans.ranks import row_numbers
from catalore.sources.catalog import Catalog

#: Seconds and weights of the activity order.
DEBOUNCE, FRECENCY_HALF, RECENT_HALF, RECENT_WEIGHT, STRIP, NEW_BOARD = 7200, 604800.0, 21600.0, 4.0, 5, 3.0


def _users(user: str, include_wildcard: bool) -> list[str]:
    return [user] + (["*"] if include_wildcard else [])


def bookmarks(cat: Catalog, namespace: str | None = None, user: str = "user", page: int = 1, page_size: int = 100, order_by: str = "time_added", order: str | None = None, include_wildcard: bool = True) -> DataFrame:
    """(sha256, path, last_modified, time_added, namespace): bookmarked contents with a path, an available one if any.

    ``namespace`` None or ``*`` means all.
    """
    marks = cat["bookmarks"].where(F.col("user").isin(*_users(user, include_wildcard)))
    if namespace and namespace != "*":
        marks = marks.where(F.col("namespace") == namespace)
    each = marks.groupBy("sha256").agg(F.max("time_added").alias("time_added"), F.min("namespace").alias("namespace"))
    files = cat["files"].join(each.select("sha256"), "sha256", "left_semi").groupBy("sha256")
    places = files.agg(F.min(F.when(F.col("available"), F.col("path"))).alias("_here"), F.min("path").alias("_any"), F.max("last_modified").alias("last_modified"))
    out = each.join(places, "sha256").select("sha256", F.coalesce("_here", "_any").alias("path"), "last_modified", "time_added", "namespace")
    direction = order or ("asc" if order_by == "path" else "desc")
    key = F.col(order_by).asc_nulls_last() if direction == "asc" else F.col(order_by).desc_nulls_last()
    return out.orderBy(key, "sha256").offset((max(page, 1) - 1) * page_size).limit(page_size)


def bookmark_total(cat: Catalog, namespace: str | None = None, user: str = "user", include_wildcard: bool = True) -> DataFrame:
    """(total): distinct bookmarked contents that have a file."""
    marks = cat["bookmarks"].where(F.col("user").isin(*_users(user, include_wildcard)))
    if namespace and namespace != "*":
        marks = marks.where(F.col("namespace") == namespace)
    return marks.join(cat["files"].select("sha256"), "sha256", "left_semi").agg(F.count_distinct("sha256").alias("total"))


def bookmark_namespaces(cat: Catalog, user: str = "user", include_wildcard: bool = False) -> DataFrame:
    """(namespace) of a user's bookmarks."""
    return cat["bookmarks"].where(F.col("user").isin(*_users(user, include_wildcard))).select("namespace").distinct().orderBy("namespace")


def bookmark_users(cat: Catalog) -> DataFrame:
    """(user) that have bookmarks."""
    return cat["bookmarks"].select("user").distinct().orderBy("user")


def item_bookmarks(cat: Catalog, sha256: str, user: str = "user", include_wildcard: bool = True) -> DataFrame:
    """(namespace, time_added, metadata) of one content's bookmarks."""
    own = cat["bookmarks"].where((F.col("sha256") == sha256) & F.col("user").isin(*_users(user, include_wildcard)))
    return own.select("user", "namespace", "time_added", "metadata").orderBy("namespace", "user")


def keep_last(cat: Catalog, n: int, namespace: str, user: str = "user") -> DataFrame:
    """The bookmarks table after keeping only the newest n of a user's namespace."""
    own = (F.col("user") == user) & (F.col("namespace") == namespace)
    newest = cat["bookmarks"].where(own).orderBy(F.desc_nulls_last("time_added"), "sha256").limit(n)
    return cat["bookmarks"].where(~F.coalesce(own, F.lit(False))).unionByName(newest)


def annotate(results: DataFrame, cat: Catalog, namespace: str = "*", user: str = "user") -> DataFrame:
    """``results`` with ``bookmarked``; null where there is no sha256 to look up."""
    marks = cat["bookmarks"].where(F.col("user").isin(user, "*"))
    if namespace != "*":
        marks = marks.where(F.col("namespace") == namespace)
    known = marks.select("sha256").distinct().withColumn("_marked", F.lit(True))
    return results.join(known, "sha256", "left").withColumn("bookmarked", F.when(F.col("sha256").isNotNull(), F.coalesce("_marked", F.lit(False)))).drop("_marked")


def decay(at: Column, now: int, half_life: float) -> Column:
    """2^(-age / half-life); times ahead of the clock count as now, never stamped ones as nothing."""
    return F.coalesce(F.pow(F.lit(2.0), -F.greatest(F.lit(now) - at, F.lit(0)) / F.lit(half_life)), F.lit(0.0))


def activity_score(now: int) -> Column:
    """What boards below the strip are ranked by: recent use and frequent use, both fading."""
    return F.lit(RECENT_WEIGHT) * decay(F.col("last_seen"), now, RECENT_HALF) + F.col("frecency") * decay(F.col("frecency_at"), now, FRECENCY_HALF)


def opened(boards: DataFrame, ids: list[int], now: int) -> DataFrame:
    """The boards table after some were opened: counted once per debounce window."""
    due = F.col("id").isin(*ids) & (F.col("frecency_at").isNull() | (F.lit(now) - F.col("frecency_at") >= DEBOUNCE))
    grown = F.col("frecency") * decay(F.col("frecency_at"), now, FRECENCY_HALF) + 1.0
    return boards.withColumns({"frecency": F.when(due, grown).otherwise(F.col("frecency")), "frecency_at": F.when(due, F.lit(now)).otherwise(F.col("frecency_at")), "last_seen": F.when(F.col("id").isin(*ids), F.lit(now)).otherwise(F.col("last_seen"))})


def board_counts(cat: Catalog, boards: DataFrame) -> DataFrame:
    """``boards`` with item_count and present_count of the current version and version_count."""
    pins = cat["pinboard_version_items"]
    heads = boards.select(F.col("head_version_id").alias("version_id"))
    own = pins.join(heads, "version_id", "left_semi")
    here = own.join(cat["items"].select("sha256"), "sha256", "left_semi").groupBy(F.col("version_id").alias("head_version_id")).agg(F.count(F.lit(1)).alias("present_count"))
    items = own.groupBy(F.col("version_id").alias("head_version_id")).agg(F.count(F.lit(1)).alias("item_count"))
    versions = cat["pinboard_versions"].groupBy(F.col("pinboard_id").alias("id")).agg(F.count(F.lit(1)).alias("version_count"))
    out = boards.join(items, "head_version_id", "left").join(here, "head_version_id", "left").join(versions, "id", "left")
    return out.fillna(0, ["item_count", "present_count", "version_count"])


def boards(cat: Catalog, user: str = "user", name_query: str | None = None, order: str = "activity", now: int = 0) -> DataFrame:
    """A user's boards with counts, by activity or latest update; ``at`` is the place.

    By activity: a strip of the five most recently touched, then all others by
    score, ties by last use and id.
    """
    own = cat["pinboards"].where(F.col("user") == user)
    if name_query:
        own = own.where(prefix_terms(F.col("name"), name_query))
    out = board_counts(cat, own)
    if order == "updated":
        return row_numbers(out, [F.desc_nulls_last("time_updated"), F.desc("id")], "at")
    recent = [F.desc_nulls_last("last_seen"), F.desc("id")]
    strip = own.orderBy(*recent).limit(STRIP).select("id", F.row_number().over(Window.orderBy(*recent)).alias("_strip"))
    out = out.join(F.broadcast(strip), "id", "left")
    ahead = F.col("_strip").isNotNull()
    out = out.withColumn("_place", F.coalesce("_strip", F.lit(STRIP + 1))).withColumn("_score", F.when(ahead, 0.0).otherwise(activity_score(now)))
    return row_numbers(out, [F.col("_place"), F.desc("_score"), *recent], "at").drop("_strip", "_place", "_score")


def associations(cat: Catalog, boards: DataFrame, db_uuid: str | None, db_name: str, instance: str | None, live: list[str]) -> DataFrame:
    """``boards`` with ``associated``: stamped with this database, with its lost namesake, or wholly present.

    ``live`` are the ids of databases that exist here; a stamp of this instance
    and name whose database is none of them counts as this one.
    """
    stamps = cat["pinboard_databases"]
    same = F.coalesce(F.col("db_uuid") == F.lit(db_uuid), F.lit(False))
    lost = F.coalesce((F.col("instance_uuid") == F.lit(instance)) & (F.col("db_name") == db_name) & ~F.col("db_uuid").isin(*live), F.lit(False))
    stamped = stamps.where(same | lost).select(F.col("pinboard_id").alias("id")).distinct().withColumn("_stamped", F.lit(True))
    whole = (F.col("item_count") > 0) & (F.col("present_count") == F.col("item_count"))
    return boards.join(stamped, "id", "left").withColumn("associated", whole | F.coalesce("_stamped", F.lit(False))).drop("_stamped")


def boards_search(cat: Catalog, query: dict, user: str = "user", now: int = 0) -> DataFrame:
    """Boards that hold results of a query: best key, share matched, count, activity, last use, id decide; ``at`` is the place."""
    found, direction = item_set(cat, query)
    per_item = found.groupBy("item_id").agg((F.max if direction == "desc" else F.min)("sort_key").alias("_best"))
    shas = per_item.join(cat["items"].select(F.col("id").alias("item_id"), "sha256"), "item_id").select("sha256", "_best")
    own = cat["pinboards"].where(F.col("user") == user)
    pins = cat["pinboard_version_items"].join(own.select(F.col("head_version_id").alias("version_id")), "version_id", "left_semi")
    hits = pins.join(shas, "sha256").groupBy(F.col("version_id").alias("head_version_id")).agg(F.count_distinct("sha256").alias("match_count"), (F.max if direction == "desc" else F.min)("_best").alias("best_key"))
    out = board_counts(cat, own.join(hits, "head_version_id"))
    best = F.col("best_key").desc_nulls_last() if direction == "desc" else F.col("best_key").asc_nulls_last()
    share = F.try_divide(F.col("match_count"), F.col("item_count"))
    out = out.withColumn("_share", share).withColumn("_score", activity_score(now))
    keys = ([best] if direction else []) + [F.desc_nulls_last("_share"), F.desc("match_count"), F.desc("_score"), F.desc_nulls_last("last_seen"), F.desc("id")]
    return row_numbers(out, keys, "at").drop("_share", "_score")


def append_version(cat: Catalog, version: DataFrame, pins: DataFrame, now: str) -> Catalog:
    """The catalogue after versions (with ids) were added: boards head to their newest version."""
    versions = cat["pinboard_versions"].unionByName(version, allowMissingColumns=True)
    items = cat["pinboard_version_items"].unionByName(pins.distinct())
    heads = version.groupBy(F.col("pinboard_id").alias("id")).agg(F.max("id").alias("_head"))
    boards = cat["pinboards"].join(heads, "id", "left")
    boards = boards.withColumns({"head_version_id": F.coalesce("_head", "head_version_id"), "time_updated": F.when(F.col("_head").isNotNull(), F.lit(now)).otherwise(F.col("time_updated"))}).drop("_head")
    return cat.but(pinboard_versions=versions, pinboard_version_items=items, pinboards=boards)


def delete_version(cat: Catalog, version_id: int) -> Catalog:
    """The catalogue without a version; its board heads to the newest remaining one, or has none."""
    versions = cat["pinboard_versions"].where(F.col("id") != version_id)
    heads = versions.groupBy(F.col("pinboard_id").alias("id")).agg(F.max("id").alias("_newest"))
    boards = cat["pinboards"].join(heads, "id", "left").withColumn("head_version_id", F.when(F.col("head_version_id") == version_id, F.col("_newest")).otherwise(F.col("head_version_id"))).drop("_newest")
    items = cat["pinboard_version_items"].where(F.col("version_id") != version_id)
    return cat.but(pinboard_versions=versions, pinboard_version_items=items, pinboards=boards)


def versions(cat: Catalog, board_id: int) -> DataFrame:
    """(id, time_added, items, head): a board's versions, newest first."""
    own = cat["pinboard_versions"].where(F.col("pinboard_id") == board_id)
    items = cat["pinboard_version_items"].join(own.select(F.col("id").alias("version_id")), "version_id", "left_semi").groupBy(F.col("version_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    heads = cat["pinboards"].where(F.col("id") == board_id).select(F.col("head_version_id").alias("id"), F.lit(True).alias("head"))
    return own.join(items, "id", "left").join(heads, "id", "left").select("id", "time_added", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("head", F.lit(False)).alias("head")).orderBy(F.desc("id"))


def rename(cat: Catalog, board_id: int, name: str, now: str) -> Catalog:
    """The catalogue with a board renamed."""
    own = F.col("id") == board_id
    return cat.but(pinboards=cat["pinboards"].withColumns({"name": F.when(own, F.lit(name)).otherwise(F.col("name")), "time_updated": F.when(own, F.lit(now)).otherwise(F.col("time_updated"))}))
