"""Failure ledgers: merging new failures, suppression, audit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.text import starts_in
from catalore.sources.catalog import Catalog


def _merge(old: DataFrame, new: DataFrame, keys: list[str], run: str, fresh: Column | None = None) -> DataFrame:
    """One row per key: the newest facts, attempts grown by one per distinct run.

    ``fresh`` tells, over columns ``old_*`` and the new ones, that a failure is
    of another thing and counts from one again. Several new rows of one key and
    run count once; of several runs each counts.
    """
    columns = [c for c in old.columns if c not in ("id", "attempts", "first_seen")]
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("last_seen"), F.desc_nulls_last(run))
    newest = new.withColumn("_at", F.row_number().over(last)).where("_at = 1")
    runs = new.groupBy(*keys).agg(F.collect_set(F.coalesce(F.col(run), F.lit(-1))).alias("_runs"), F.min("last_seen").alias("_first"))
    gained = newest.join(runs, keys)
    joined = gained.join(old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys]), keys, "left")
    known = F.col("old_attempts").isNotNull()
    again = known & ~fresh if fresh is not None else known
    added = F.size(F.array_except("_runs", F.array(F.coalesce(F.col(f"old_{run}"), F.lit(-1)))))
    attempts = F.when(again, F.col("old_attempts") + added).otherwise(F.size("_runs")).cast("long")
    merged = joined.select(F.col("old_id").alias("id"), *columns, attempts.alias("attempts"), F.when(again, F.col("old_first_seen")).otherwise(F.col("_first")).alias("first_seen"))
    rest = old.join(new.select(*keys).distinct(), keys, "left_anti").select("id", *columns, "attempts", "first_seen")
    return merged.unionByName(rest).select(*old.columns)


def record_extraction_errors(cat: Catalog, failures: DataFrame) -> DataFrame:
    """item_extraction_errors after new failures (item_id, setter_id, stage, ..., last_job_id, last_seen)."""
    return _merge(cat["item_extraction_errors"], failures, ["item_id", "setter_id"], "last_job_id")


def record_scan_errors(cat: Catalog, failures: DataFrame) -> DataFrame:
    """scan_errors after new failures; a file that has changed since counts from one again."""
    changed = ~(F.col("old_last_modified").eqNullSafe(F.col("last_modified")) & F.col("old_file_size").eqNullSafe(F.col("file_size")))
    return _merge(cat["scan_errors"], failures, ["path"], "last_scan_id", changed)


def suppressed(cat: Catalog, stats: DataFrame) -> DataFrame:
    """Those of ``stats`` (path, last_modified, file_size) that failed too often as they stand; decoding doesn't count."""
    blocked = cat["scan_errors"].where("stage <> 'decode' and attempts >= skip_after").select("path", "last_modified", "file_size")
    return stats.join(blocked, ["path", "last_modified", "file_size"], "left_semi")


def visuals_suppressed(cat: Catalog, wanted: DataFrame, version: int) -> DataFrame:
    """Those of ``wanted`` (item_sha256, kind) whose pictures failed too often at this or a later version."""
    blocked = cat["visual_attempts"].where((F.col("version") >= version) & (F.col("attempts") >= F.col("skip_after"))).select("item_sha256", "kind")
    return wanted.join(blocked, ["item_sha256", "kind"], "left_semi")


def extraction_audit(cat: Catalog, setter: str | None = None, error_class: str | None = None, stage: str | None = None, mime_prefix: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Recorded extraction failures, latest first, with the setter's name and a path of the item."""
    rows = cat["item_extraction_errors"]
    for column, value in (("error_class", error_class), ("stage", stage)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if mime_prefix:
        rows = rows.where(starts_in(F.col("mime_type"), mime_prefix))
    names = cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    rows = rows.join(F.broadcast(names.where(F.col("setter") == setter) if setter else names), "setter_id")
    page = rows.orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    # paths only for the page
    files = cat["files"].join(page.select("item_id"), "item_id", "left_semi")
    paths = files.groupBy("item_id").agg(F.min_by("path", F.struct(~F.coalesce("available", F.lit(False)), F.col("id"))).alias("path"))
    return page.join(paths, "item_id", "left").withColumn("active", F.col("attempts") >= F.col("skip_after"))


def scan_audit(cat: Catalog, error_class: str | None = None, stage: str | None = None, mime_prefix: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Recorded scan failures, latest first."""
    rows = cat["scan_errors"]
    for column, value in (("error_class", error_class), ("stage", stage)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if mime_prefix:
        rows = rows.where(starts_in(F.col("mime_type"), mime_prefix))
    page = rows.orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)
