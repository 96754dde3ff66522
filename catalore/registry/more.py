"""Media, chunks, indexes, ledgers and the search service as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalore.operators import ingest, ledgers, media, outputs
from catalore.plans.compile import search
from catalore.plans.service import Engine
from catalore.registry.derived import catalog
from catalore.registry.searches import ALL, FILES, IMAGE, QUERY96, TEXT_MODEL, _distance, _literal
from catalore.sources.tables import table

CHUNK = 100
RULES = {"match": {"gte": {"width": 640}, "startswith": {"type": ["image/", "video/"]}}}


def _pictures(spark, d):
    """Every item as a picture of one colour, that of its hash."""
    items = table(spark, d, "items").where("sha256 is not null")
    return items.select(F.col("id").alias("item_id"), F.unhex(F.repeat(F.substring("sha256", 1, 6), 16)).alias("pixels"), F.lit(4).alias("height"), F.lit(4).alias("width"))


def _chunk_vectors(spark, d):
    c = catalog(spark, d)
    made = c["item_data"].join(c["setters"].where(F.col("name") == TEXT_MODEL).select(F.col("id").alias("setter_id")), "setter_id").select("id", "item_id")
    whole = c["embeddings"].where("size(embedding) = 128 and not exists(embedding, x -> isnan(x))").join(made, "id")
    rows = outputs.combined_vectors(whole.select(F.col("item_id").alias("source_id"), F.col("id").alias("chunk"), "embedding"), 2)
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("embedding", 1)), 5).alias("first"), F.round(F.sum(F.element_at("embedding", 128)), 5).alias("last"))


def _attempts(spark, d):
    """(wanted pictures, catalogue with a ledger of failed attempts) made from the items."""
    items = table(spark, d, "items").where("sha256 is not null")
    tried = items.where("id % 3 = 0").select(
        F.col("sha256").alias("item_sha256"), F.lit("thumbnail").alias("kind"), F.col("type").alias("item_mime_type"), (F.col("id") % 2 + 1).alias("version"), F.when(F.col("id") % 5 == 0, "ok").otherwise("failed").alias("outcome"),
        F.lit(None).cast("string").alias("blocker"), F.lit(2).cast("long").alias("skip_after"), (F.col("id") % 4).alias("attempts"), F.lit(1).cast("long").alias("last_scan_id"), F.lit(None).cast("string").alias("error"), F.lit("x").alias("first_seen"), F.lit("x").alias("last_attempt"),
    )
    return items.select(F.col("sha256").alias("item_sha256"), F.lit("thumbnail").alias("kind")), catalog(spark, d).but(visual_attempts=tried)


def _paged(spark, d):
    """Three pages of the search service, the later ones out of its cache."""
    engine = Engine(catalog(spark, d))
    rows = [r for page in (1, 2, 3) for r in engine.search({"select": ["path"], "page_size": 20, "page": page, "prefetch_rows": 60, "order_by": [{"order_by": "path"}]}).results]
    return spark.createDataFrame([(r["file_id"], r["path"], n) for n, r in enumerate(rows)], "file_id long, path string, n long")


def registered():
    """Name to (callable, SQL or None)."""
    out = {}
    digits = media.DIGITS.replace("'", "''")
    digit = lambda n: f"substr('{digits}', ((rgb // {83**n}) % 83 + 1)::int, 1)"
    out["blurhash_of_colours"] = (lambda spark, d: media.blurhashes(_pictures(spark, d), 1, 1)), f"""
        with c as (select id item_id, ('0x' || substr(sha256, 1, 6))::bigint rgb from items where sha256 is not null)
        select item_id, '00' || {digit(3)} || {digit(2)} || {digit(1)} || {digit(0)} blurhash from c"""

    words = lambda: F.split("text", " ", -1)
    out["text_chunks"] = (lambda spark, d: outputs.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), words().alias("tokens")), CHUNK).select("source_id", F.col("chunk").cast("long").alias("chunk"), F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("text"))), f"""
        with w as (select doc_id source_id, string_split("text", ' ') t from documents where "text" is not null), n as (select *, len(t) n, (len(t) - 1) // {CHUNK} k from w),
        l as (select *, case when k > 0 then greatest({CHUNK // 3} - (n - k * {CHUNK}), 0) else 0 end lack from n), c as (select *, unnest(range(0, k + 1)) chunk from l),
        b as (select *, chunk * {CHUNK} - case when chunk = k then lack else 0 end b, case when chunk = k then n else (chunk + 1) * {CHUNK} - case when chunk = k - 1 then lack else 0 end end e from c)
        select source_id, chunk, e - b n, array_to_string(t[b + 1 : e], ' ') "text" from b"""
    out["chunk_vectors"] = _chunk_vectors, f"""
        with r as (select d.item_id source_id, v.embedding::double[] x from vector_fixtures v join item_data d on d.id = v.id join setters s on s.id = d.setter_id
          where s.name = '{TEXT_MODEL}' and len(v.embedding) = 128 and list_aggregate(list_transform(v.embedding, lambda y: isnan(y)::int), 'max') = 0),
        g as (select source_id, count(*) n, sum(x[1]) a, sum(x[128]) b from r group by 1)
        select source_id, n + case when n >= 2 then 1 else 0 end n, round(a + case when n >= 2 then a / n else 0 end, 5) "first", round(b + case when n >= 2 then b / n else 0 end, 5) "last" from g"""

    def allowed(spark, d):
        c = catalog(spark, d)
        facts = c["items"].select(F.col("id").alias("item_id"), "md5", "type", "size", "width", "height", "duration")
        return ingest.media_allowed(c["files"].join(facts, "item_id"), RULES).select(F.col("id").alias("file_id"), "allowed")

    out["media_allowed"] = allowed, """
        select f.id file_id, coalesce(i.width >= 640, true) and coalesce(starts_with(i.type, 'image/') or starts_with(i.type, 'video/'), true) allowed from files f join items i on i.id = f.item_id"""
    paths = "p as (select item_id, arg_min(path, (case when available then 0 else 1 end) * 1000000000 + id) path from files where item_id is not null group by 1)"
    every = lambda c: c["items"].select(F.col("id").alias("item_id"))
    for name in ("audio_tracks", "audio_files"):
        out[f"inputs_of_{name}"] = (lambda spark, d, name=name: ingest.inputs(c := catalog(spark, d), every(c), name)), f"""
            with {paths} select i.id item_id, p.path, i.duration from items i join p on p.item_id = i.id where i.audio_tracks > 0 or (i.audio_tracks is null and starts_with(i.type, 'audio/'))"""
    out["inputs_of_md5_images"] = (lambda spark, d: ingest.inputs(c := catalog(spark, d), every(c), "md5_image").withColumn("frame", F.col("frame").cast("long"))), f"""
        with {paths} select i.id item_id, f.frame::bigint frame, p.path, i.md5 from items i join p on p.item_id = i.id, (select unnest([0, 1, 2, 3]) frame) f where f.frame = 0 or i.type like 'video/%'"""
    out["visuals_suppressed"] = (lambda spark, d: ledgers.visuals_suppressed((a := _attempts(spark, d))[1], a[0], 2)), """
        select sha256 item_sha256, 'thumbnail' kind from items i where sha256 is not null and exists (select 1 from items j where j.sha256 = i.sha256 and j.id % 3 = 0 and j.id % 2 + 1 >= 2 and j.id % 4 >= 2)"""
    out["search_paged"] = _paged, f"with {FILES}, r as (select file_id, path, row_number() over (order by path nulls last, file_id) - 1 n from std) select * from r where n < 60"
    l2 = lambda spark, d: search(catalog(spark, d), {"query": {"image_embeddings": {"query": QUERY96, "model": IMAGE}, "select_as": "dist"}, "select": [], "page_size": ALL}, metrics={IMAGE.split("/")[0]: "L2"})
    out["image_embeddings_l2"] = (lambda spark, d: l2(spark, d).withColumn("dist", F.round("dist", 6))), f"""
        with {FILES}, v as (select d.item_id, case when len(v.embedding) = 96 and list_aggregate(list_transform(v.embedding, lambda x: isnan(x)::int), 'max') = 0 then {_distance('L2', 'v.embedding', _literal(QUERY96))} end dist
          from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id where s.name = '{IMAGE}'), h as (select item_id, min(dist) dist from v group by 1)
        select file_id, std.item_id, round(dist, 6) dist from std join h on h.item_id = std.item_id"""
    return out
