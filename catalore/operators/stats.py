"""Statistics and lookups over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.text import first_segment, hex_prefix, mime_class, starts_in
from catalore.sources.catalog import Catalog


def tag_recount(cat: Catalog) -> DataFrame:
    """(id, namespace, name, item_count): distinct items of each tag, 0 for unused tags."""
    counts = cat["tags_items"].groupBy(F.col("tag_id").alias("id")).agg(F.count_distinct("item_id").alias("n"))
    return cat["tags"].select("id", "namespace", "name").join(counts, "id", "left").select("id", "namespace", "name", F.coalesce("n", F.lit(0)).alias("item_count"))


def tag_autocomplete(cat: Catalog, name: str, limit: int = 10, recount: bool = False) -> DataFrame:
    """(namespace, name, item_count) of the tags whose name holds the text as it stands, most used first."""
    tags = tag_recount(cat) if recount else cat["tags"]
    found = tags.where(F.col("name").contains(name))
    return found.orderBy(F.desc_nulls_last("item_count"), "namespace", "name").select("namespace", "name", "item_count").limit(limit)


def _of_setters(rows: DataFrame, cat: Catalog, setters: list[str] | None) -> DataFrame:
    """Tag rows of some setters; without a wish no join at all."""
    if not setters:
        return rows
    made = cat["item_data"].select(F.col("id").alias("item_data_id"), "setter_id")
    named = cat["setters"].where(F.col("name").isin(*setters)).select(F.col("id").alias("setter_id"))
    return rows.join(made, "item_data_id").join(F.broadcast(named), "setter_id").drop("setter_id")


def top_tags(cat: Catalog, namespace: str | None = None, setters: list[str] | None = None, confidence: float | None = None, limit: int = 10) -> DataFrame:
    """(namespace, name, count) of the most frequent tags under a namespace prefix."""
    rows = cat["tags_items"].select("item_data_id", "tag_id", "confidence")
    if confidence is not None and confidence > 0:
        rows = rows.where(F.col("confidence") >= confidence)
    # rows per tag first: the join with names then meets one row a tag
    counts = _of_setters(rows, cat, setters).groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    tags = cat["tags"].select("id", "namespace", "name")
    if namespace is not None:
        tags = tags.where(starts_in(F.col("namespace"), namespace))
    named = tags.join(counts, "id").groupBy("namespace", "name").agg(F.sum("n").alias("count"))
    return named.orderBy(F.desc("count"), "namespace", "name").limit(limit)


def tag_frequency(cat: Catalog, namespace: str | None = None, setters: list[str] | None = None, confidence: float | None = None, limit: int = 10) -> DataFrame:
    """Top tags with their share of all tagged (item, setter) pairs; only the setter wish bears on the total."""
    made = cat["item_data"].select(F.col("id").alias("item_data_id"), F.col("item_id").alias("_item"), F.col("setter_id").alias("_setter"))
    rows = _of_setters(cat["tags_items"].select("item_data_id").distinct(), cat, setters).join(made, "item_data_id")
    total = rows.agg(F.count_distinct("_item", "_setter").alias("total"))
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.lit(0.0))
    return top_tags(cat, namespace, setters, confidence, limit).crossJoin(F.broadcast(total)).select("namespace", "name", "count", share.alias("frequency"))


def tag_namespaces(cat: Catalog) -> DataFrame:
    """(namespace): all namespaces and the first segments of those that have several."""
    own = cat["tags"].select("namespace").where("namespace is not null").distinct()
    heads = own.where(F.col("namespace").contains(":")).select(first_segment(F.col("namespace")).alias("namespace"))
    return own.unionByName(heads.distinct()).orderBy("namespace")


def min_tag_confidence(cat: Catalog) -> DataFrame:
    """(min_confidence): the least confidence of any tag, 0 without tags."""
    return cat["tags_items"].agg(F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"))


def text_stats(cat: Catalog) -> DataFrame:
    """(languages, lowest_language_confidence, lowest_confidence)."""
    return cat["extracted_text"].agg(
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"),
        F.min("language_confidence").alias("lowest_language_confidence"),
        F.min("confidence").alias("lowest_confidence"),
    )


def file_stats(cat: Catalog) -> DataFrame:
    """(files, items): how many of each."""
    return cat["files"].agg(F.count(F.lit(1)).alias("files")).crossJoin(F.broadcast(cat["items"].agg(F.count(F.lit(1)).alias("items"))))


def mime_types(cat: Catalog) -> DataFrame:
    """(type): the types present and their classes."""
    types = cat["items"].select("type").where("type is not null").distinct()
    return types.unionByName(types.select(mime_class(F.col("type")).alias("type")).distinct()).orderBy("type")


def existing_setters(cat: Catalog) -> DataFrame:
    """(data_type, setter): which setter made which kind of data."""
    pairs = cat["item_data"].select("data_type", "setter_id").distinct()
    names = cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    return pairs.join(F.broadcast(names), "setter_id").select("data_type", "setter").distinct().orderBy("data_type", "setter")


def setter_totals(cat: Catalog) -> DataFrame:
    """(setter, total): data rows of each setter, placeholders left out."""
    counts = cat["item_data"].where("not coalesce(is_placeholder, false)").groupBy("setter_id").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))), "setter_id").select("setter", "total")


def search_stats(cat: Catalog, user: str = "user", include_wildcard: bool = True) -> dict[str, DataFrame]:
    """What a search form offers: setters, bookmark namespaces, files, tags, folders, texts."""
    users = [user] + (["*"] if include_wildcard else [])
    return {
        "setters": existing_setters(cat),
        "bookmarks": cat["bookmarks"].where(F.col("user").isin(*users)).select("namespace").distinct().orderBy("namespace"),
        "files": file_stats(cat),
        "mime_types": mime_types(cat),
        "tags": tag_namespaces(cat),
        "min_tag_confidence": min_tag_confidence(cat),
        "folders": cat["folders"].where("included").select("path").orderBy("path"),
        "text_stats": text_stats(cat),
    }


def job_history(cat: Catalog, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Extraction runs, newest first, with the data rows still in the catalogue, failure and status."""
    kept = cat["item_data"].where("job_id is not null and not is_placeholder").groupBy("job_id").agg(F.count_distinct("id").alias("items_in_db"))
    jobs = cat["data_jobs"].select(F.col("id").alias("job_id"), F.col("completed").alias("status"))
    failed = F.when(F.col("completed"), 0).when(F.col("job_id").isNull(), 1).otherwise(0)
    runs = cat["data_log"].join(kept, "job_id", "left").join(jobs, "job_id", "left")
    runs = runs.withColumn("items_in_db", F.coalesce("items_in_db", F.lit(0))).withColumn("failed", failed)
    return _paged(runs.orderBy(F.desc_nulls_last("start_time"), F.desc("id")), page, page_size)


def scan_history(cat: Catalog, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Folder scans, newest first."""
    return _paged(cat["file_scans"].orderBy(F.desc_nulls_last("start_time"), F.desc("id")), page, page_size)


def _paged(df: DataFrame, page: int, size: int | None) -> DataFrame:
    return df if size is None else df.offset((max(page, 1) - 1) * size).limit(size)


def item_tags(cat: Catalog, item_ids: DataFrame | list[int], setters: list[str] | None = None, confidence: float = 0, namespaces: list[str] | None = None, limit_per_namespace: int | None = None) -> DataFrame:
    """(item_id, setter, namespace, name, confidence): items' tags, the best of each setter and namespace."""
    made = cat["item_data"].where("data_type = 'tags'").select(F.col("id").alias("item_data_id"), "item_id", "setter_id")
    made = made.where(F.col("item_id").isin(*item_ids)) if isinstance(item_ids, list) else made.join(item_ids, "item_id", "left_semi")
    names = cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    made = made.join(F.broadcast(names.where(F.col("setter").isin(*setters)) if setters else names), "setter_id")
    rows = cat["tags_items"].select("item_data_id", "tag_id", "confidence").join(made, "item_data_id")
    if confidence > 0:
        rows = rows.where(F.col("confidence") >= confidence)
    tags = cat["tags"].select(F.col("id").alias("tag_id"), "namespace", "name")
    if namespaces:
        ok = F.lit(False)
        for ns in namespaces:
            ok = ok | starts_in(F.col("namespace"), ns)
        tags = tags.where(ok)
    out = rows.join(tags, "tag_id").select("item_id", "setter", "namespace", "name", "confidence")
    if limit_per_namespace is not None:
        best = Window.partitionBy("item_id", "setter", "namespace").orderBy(F.desc_nulls_last("confidence"), "name")
        out = out.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= limit_per_namespace).drop("_at")
    return out


def item_texts(cat: Catalog, item_ids: DataFrame | list[int], max_length: int | None = None) -> DataFrame:
    """(item_id, setter, data_id, source_id, idx, language, text, ...): items' texts, cut to a length."""
    rows = cat.texts.where(F.col("item_id").isin(*item_ids)) if isinstance(item_ids, list) else cat.texts.join(item_ids, "item_id", "left_semi")
    names = cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    text = F.col("text") if max_length is None else F.substring("text", 1, max_length)
    named = rows.join(F.broadcast(names), "setter_id").withColumn("full_length", F.length("text").cast("long")).withColumn("text", text)
    return named.select("item_id", "setter", "data_id", "source_id", "idx", "language", "language_confidence", "confidence", "text", "full_length").orderBy("setter", F.asc_nulls_first("source_id"), "idx", "data_id")


def texts_by_id(cat: Catalog, ids: list[int]) -> DataFrame:
    """(data_id, item_id, setter, language, text) of given text rows."""
    names = cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    return cat.texts.where(F.col("data_id").isin(*ids)).join(F.broadcast(names), "setter_id").select("data_id", "item_id", "setter", "language", "text").orderBy("data_id")


def item_metadata(cat: Catalog, id, id_type: str) -> DataFrame:
    """The item's columns with its files, available ones first; by item_id, file_id, data_id, path, sha256 (prefix) or md5."""
    items, files = cat["items"], cat["files"].select(F.col("id").alias("file_id"), "item_id", "path", "filename", "last_modified", "available")
    if id_type == "item_id":
        own = items.where(F.col("id") == int(id))
    elif id_type == "sha256":
        own = items.where(hex_prefix(F.col("sha256"), str(id)))
    elif id_type == "md5":
        own = items.where(F.col("md5") == id)
    elif id_type in ("file_id", "path"):
        hit = files.where(F.col("file_id") == int(id) if id_type == "file_id" else F.col("path") == id)
        own = items.join(hit.select(F.col("item_id").alias("id")), "id", "left_semi")
    elif id_type == "data_id":
        hit = cat["item_data"].where(F.col("id") == int(id)).select(F.col("item_id").alias("id"))
        own = items.join(hit, "id", "left_semi")
    else:
        raise ValueError(f"unknown id type {id_type!r}")
    wide = own.withColumnRenamed("id", "item_id").join(files, "item_id", "left")
    return wide.orderBy("item_id", F.desc_nulls_last("available"), "file_id")
