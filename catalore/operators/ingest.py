"""From folder listings to the catalogue: decisions, upserts, availability, deletions, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.text import starts_in
from catalore.plans.compile import base, run, search, State
from catalore.plans.match import scanned
from catalore.plans.model import Group, Leaf, Match, element, prune
from catalore.plans.runtime import cut_lineage
from catalore.sources.catalog import Catalog


def dedupe_roots(roots: list[str]) -> list[str]:
    """Folder roots without those inside another; separators are unified, one closes each root."""
    plain = sorted({r.replace("\\", "/").rstrip("/") + "/" for r in roots if r})
    kept: list[str] = []
    for r in plain:
        if not kept or not r.startswith(kept[-1]):
            kept.append(r)
    return kept


def folder_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, included, change): folders (path, included) to add, remove or keep."""
    now = current.select("path", "included").withColumn("_now", F.lit(True))
    then = wanted.select("path", "included").withColumn("_then", F.lit(True))
    change = F.when(F.col("_now").isNull(), "add").when(F.col("_then").isNull(), "remove").otherwise("keep")
    return now.join(then, ["path", "included"], "full_outer").select("path", "included", change.alias("change"))


def scan_decisions(cat: Catalog, listing: DataFrame, rules: dict | None = None) -> DataFrame:
    """``listing`` (path, last_modified, file_size, type) with a decision for each file.

    In this order: suppressed (failed too often as it stands), unknown (no
    type), filtered (the rules, on what a listing knows), touch (unchanged
    time), hash (new or changed).
    """
    blocked = cat["scan_errors"].where("stage <> 'decode' and attempts >= skip_after").select("path", "last_modified", F.col("file_size"), F.lit(True).alias("_blocked"))
    known = cat["files"].select("path", F.col("last_modified").alias("_seen")).groupBy("path").agg(F.max("_seen").alias("_seen"))
    tree = prune(element(rules)) if rules else None
    fields = {"path", "filename", "size", "last_modified", "type"}
    rows = listing.withColumns({"filename": F.element_at(F.split("path", r"[/\\]"), -1), "size": F.col("file_size")})
    passes = _scanned(tree, fields) if tree is not None else F.lit(True)
    joined = rows.join(blocked, ["path", "last_modified", "file_size"], "left").join(known, "path", "left")
    decision = F.when(F.col("_blocked"), "suppressed").when(F.col("type").isNull(), "unknown").when(~passes, "filtered").when(F.col("_seen") == F.col("last_modified"), "touch").otherwise("hash")
    return joined.withColumn("decision", decision).drop("_blocked", "_seen", "filename", "size")


#: What is known of a file once it has been hashed and looked into.
MEDIA_FACTS = ("path", "filename", "size", "last_modified", "type", "sha256", "md5", "width", "height", "duration", "audio_tracks", "video_tracks", "subtitle_tracks")


def media_allowed(scanned_files: DataFrame, rules: dict | None = None) -> DataFrame:
    """The second look at scanned files, with ``allowed``: the rules on hashes and media facts, too.

    A fact that the scan does not deliver, or that is null for a file, is not
    judged, as in the first look.
    """
    tree = prune(element(rules)) if rules else None
    passes = _scanned(tree, set(MEDIA_FACTS) & set(scanned_files.columns)) if tree is not None else F.lit(True)
    return scanned_files.withColumn("allowed", passes)


def _scanned(node, fields: set[str]) -> Column:
    """A rule tree over scanned records; only attribute predicates can judge them."""
    if isinstance(node, Group):
        parts = [_scanned(p, fields) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "and" else out | p
        return ~out if node.kind == "not" else out
    return scanned(node, fields) if isinstance(node, Match) else F.lit(True)


def upsert(cat: Catalog, scanned_files: DataFrame, scan_id: int, time_added: str, first_file: int, first_item: int) -> Catalog:
    """The catalogue after scan results (path, sha256, md5, type, file_size, last_modified, new_hash).

    Contents not known yet become items; an unchanged file is only touched; a
    new or changed path replaces its row. Of several results for one path the
    latest counts.
    """
    from catalore.plans.ranks import row_numbers

    last = Window.partitionBy("path").orderBy(F.desc_nulls_last("last_modified"), "sha256")
    found = scanned_files.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")
    items, files = cat["items"], cat["files"]
    fresh = found.where("sha256 is not null").groupBy("sha256").agg(*[F.first(c, True).alias(c) for c in ("md5", "type")], F.max("file_size").alias("size"))
    fresh = row_numbers(fresh.join(items.select("sha256"), "sha256", "left_anti"), [F.col("sha256")], "_n")
    added = fresh.select((F.col("_n") + (first_item - 1)).alias("id"), "sha256", "md5", "type", "size", F.lit(time_added).alias("time_added"))
    items = items.unionByName(added, allowMissingColumns=True)
    touched = found.where(~F.col("new_hash")).select("path", F.col("last_modified").alias("_time"), F.lit(True).alias("_touched"))
    kept = files.join(found.where("new_hash").select("path"), "path", "left_anti").join(touched, "path", "left")
    kept = kept.withColumns({"scan_id": F.when(F.col("_touched"), F.lit(scan_id)).otherwise(F.col("scan_id")), "available": F.when(F.col("_touched"), F.lit(True)).otherwise(F.col("available")), "last_modified": F.coalesce("_time", "last_modified")}).select(*files.columns)
    new = found.where("new_hash").join(items.select("sha256", F.col("id").alias("item_id")).groupBy("sha256").agg(F.min("item_id").alias("item_id")), "sha256")
    numbered = row_numbers(new, [F.col("path")], "_n")
    rows = numbered.select((F.col("_n") + (first_file - 1)).alias("id"), "sha256", "item_id", "path", F.element_at(F.split("path", r"[/\\]"), -1).alias("filename"), "last_modified", F.lit(scan_id).cast("long").alias("scan_id"), F.lit(True).alias("available"))
    return cat.but(items=items, files=kept.unionByName(rows))


def mark_unavailable(cat: Catalog, scan_id: int, prefix: str, failed: DataFrame | None = None) -> DataFrame:
    """The files table after a scan of a prefix: what the scan did not see and did not fail on is unavailable."""
    files = cat["files"]
    gone = starts_in(F.col("path"), prefix) & (F.col("scan_id") != scan_id)
    if failed is None:
        return files.withColumn("available", F.when(gone, F.lit(False)).otherwise(F.col("available")))
    spared = failed.select("path").distinct().withColumn("_spared", F.lit(True))
    out = files.join(spared, "path", "left")
    return out.withColumn("available", F.when(gone & F.col("_spared").isNull(), F.lit(False)).otherwise(F.col("available"))).select(*files.columns)


def under(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files under one of the folders; each path meets its own ancestors in an equi-join, not every folder."""
    path = F.translate("path", "\\", "/")
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    roots = folders.select(F.rtrim(F.translate("path", "\\", "/"), F.lit("/")).alias("_root")).distinct()
    hits = files.select("id", F.explode(heads).alias("_root")).join(roots, "_root", "left_semi").select("id").distinct()
    return files.join(hits, "id", "left_semi")


def outside_folders(cat: Catalog) -> DataFrame:
    """Files to delete: under no included folder, or under an excluded one."""
    kept = under(cat["files"], cat["folders"].where("included"))
    kept = kept.join(under(kept, cat["folders"].where("not included")).select("id"), "id", "left_anti")
    return cat["files"].join(kept.select("id"), "id", "left_anti")


def not_allowed(cat: Catalog, rules: list[dict]) -> DataFrame:
    """(file_id, item_id) of files that break one of the rules."""
    state = State(cat, "file", counting=True)
    tree = prune(Group("not", [Group("and", [element(r) for r in rules])]))
    return run(tree, base(state), state) if tree is not None and rules else base(state).limit(0)


def orphan_items(cat: Catalog) -> DataFrame:
    """Items without any file."""
    return cat["items"].join(cat["files"].where("item_id is not null").select(F.col("item_id").alias("id")), "id", "left_anti")


def orphan_tags(cat: Catalog) -> DataFrame:
    """Tags without any row."""
    return cat["tags"].join(cat["tags_items"].select(F.col("tag_id").alias("id")), "id", "left_anti")


def cascade(cat: Catalog, items: DataFrame | None = None, data: DataFrame | None = None) -> Catalog:
    """The catalogue without some items (id) or data rows (id) and all that hangs on them.

    Data derived from deleted data goes too, along source_id, until nothing more
    is found; rows derived from each other end it, too.
    """
    rows = cat["item_data"].select("id", "item_id", "source_id")
    gone = rows.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("id") if items is not None else rows.limit(0).select("id")
    if data is not None:
        gone = gone.unionByName(data.select("id"))
    derived = rows.where("source_id is not null")
    frontier = gone = cut_lineage(gone.distinct())
    while True:
        frontier = derived.join(frontier.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id").distinct()
        frontier = cut_lineage(frontier.join(gone, "id", "left_anti"))
        if frontier.isEmpty():
            break
        gone = gone.unionByName(frontier)
    out = {
        "item_data": cat["item_data"].join(gone, "id", "left_anti"),
        "extracted_text": cat["extracted_text"].join(gone, "id", "left_anti"),
        "embeddings": cat["embeddings"].join(gone, "id", "left_anti"),
        "embedding_quants": cat["embedding_quants"].join(gone, "id", "left_anti"),
        "tags_items": cat["tags_items"].join(gone.select(F.col("id").alias("item_data_id")), "item_data_id", "left_anti"),
    }
    if items is not None:
        out["items"] = cat["items"].join(items.select("id"), "id", "left_anti")
        out["files"] = cat["files"].join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")
        out["item_extraction_errors"] = cat["item_extraction_errors"].join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")
    return cat.but(**out)


def folder_update(cat: Catalog, wanted: DataFrame, rules: list[dict] | None = None, drop_unavailable: bool = False) -> Catalog:
    """The catalogue under new folders (path, included), cleaned in the fixed order.

    Unavailable files (if wanted), files that break a rule, files outside the
    folders, items left without files with all their data, unused tags.
    """
    folders = wanted.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("time_added"), "path", "included")
    cat = cat.but(folders=folders)
    if drop_unavailable:
        cat = cat.but(files=cat["files"].where("coalesce(available, true)"))
    if rules:
        cat = cat.but(files=cat["files"].join(not_allowed(cat, rules).select(F.col("file_id").alias("id")), "id", "left_anti"))
    cat = cat.but(files=cat["files"].join(outside_folders(cat).select("id"), "id", "left_anti"))
    cat = cascade(cat, items=orphan_items(cat).select("id"))
    return cat.but(tags=cat["tags"].join(orphan_tags(cat).select("id"), "id", "left_anti"))


def inputs(cat: Catalog, keys: DataFrame, handler: str, most_frames: int = 4) -> DataFrame:
    """What a model reads of each work row, by handler.

    extracted_text: (data_id, item_id, text); md5: (item_id, md5); sha256_md5_path:
    (item_id, sha256, md5, path), an available path first; image_frames: (item_id,
    frame, path), one row a frame of up to ``most_frames`` slices of a video;
    md5_image: the same with the md5; audio_tracks and audio_files: (item_id, path,
    duration) of items that hold sound, one row each, as their tracks are mixed.
    """
    if handler == "extracted_text":
        return cat.texts.join(keys.select("data_id"), "data_id", "left_semi").select("data_id", "item_id", "text")
    items = cat["items"].join(keys.select(F.col("item_id").alias("id")), "id", "left_semi")
    if handler == "md5":
        return items.select(F.col("id").alias("item_id"), "md5")
    paths = cat["files"].groupBy(F.col("item_id").alias("id")).agg(F.min_by("path", F.struct(~F.coalesce("available", F.lit(False)), "id")).alias("path"))
    placed = items.join(paths, "id")
    if handler == "sha256_md5_path":
        return placed.select(F.col("id").alias("item_id"), "sha256", "md5", "path")
    if handler in ("audio_tracks", "audio_files"):
        sounding = (F.col("audio_tracks") > 0) | F.col("audio_tracks").isNull() & F.col("type").startswith("audio/")
        return placed.where(sounding).select(F.col("id").alias("item_id"), "path", "duration")
    if handler in ("image_frames", "md5_image"):
        frames = F.when(F.col("type").startswith("video/"), F.sequence(F.lit(0), F.lit(most_frames - 1))).otherwise(F.array(F.lit(0)))
        return placed.select(F.col("id").alias("item_id"), F.explode(frames).alias("frame"), "path", *(["md5"] if handler == "md5_image" else []))
    raise ValueError(f"unknown input handler {handler!r}")


def clean_incomplete(cat: Catalog, drop: bool = True) -> Catalog:
    """The catalogue after jobs that never ended: their data dropped, or the jobs marked abandoned."""
    open_jobs = cat["data_jobs"].where("completed = 0").select(F.col("id").alias("job_id"))
    if not drop:
        return cat.but(data_jobs=cat["data_jobs"].withColumn("completed", F.when(F.col("completed") == 0, -1).otherwise(F.col("completed"))))
    made = cat["item_data"].join(open_jobs, "job_id", "left_semi").select("id")
    logs = cat["data_log"].join(open_jobs.withColumn("_open", F.lit(True)), "job_id", "left")
    return cascade(cat, data=made).but(data_jobs=cat["data_jobs"].where("completed <> 0"), data_log=logs.withColumn("job_id", F.when(F.col("_open").isNull(), F.col("job_id"))).drop("_open"))


def work(cat: Catalog, setter: str, target: str = "items", mimes: list[str] | None = None, rules: list[dict] | None = None, data_types: list[str] | None = None) -> DataFrame:
    """The rows a setter still has to process: right type, not processed, not failed too often, all rules kept.

    Targets are items (one row an item), files or text (one row a text).
    """
    parts: list[dict] = []
    if mimes:
        parts.append({"match": {"startswith": {"type": list(mimes)}}})
    if data_types:
        parts.append({"has_data_unprocessed": {"setter_name": setter, "data_types": list(data_types)}})
    parts += [{"not_": {"processed_by": setter}}, {"not_": {"failed_for": setter}}, *(rules or [])]
    key = {"items": "item_id", "files": "file_id", "text": "data_id"}[target]
    return search(cat, {"query": {"and_": parts}, "entity": "text" if target == "text" else "file", "partition_by": [key], "order_by": [{"order_by": key}], "select": [key], "page_size": 0})
