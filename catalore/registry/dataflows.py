"""Model outputs, ingestion and event windows as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalore.functions.mixing import pk_mix
from catalore.functions.text import rounded
from catalore.operators import ingest, outputs
from catalore.plans.runtime import cut_lineage
from catalore.registry.derived import catalog, with_sql
from catalore.sources.tables import table
from catalore.streaming import changes


def _frames(spark, d):
    """Per-frame scores (item_id, frame, namespace, name, score) from the tag rows."""
    rows = table(spark, d, "tags_items").join(table(spark, d, "item_data").select(F.col("id").alias("item_data_id"), F.col("item_id").alias("item")), "item_data_id")
    tags = table(spark, d, "tags").select(F.col("id").alias("tag_id"), "namespace", "name")
    named = rows.join(tags, "tag_id").where("confidence is not null and confidence <= 1 and namespace in ('general', 'kind', 'meta')")
    space = F.when(F.col("namespace") == "kind", "rating").otherwise(F.col("namespace"))
    return named.select(F.col("item").alias("item_id"), F.col("item_data_id").alias("frame"), space.alias("namespace"), "name", F.col("confidence").alias("score"))


FRAMES = """fr as (select d.item_id, x.item_data_id frame, case when t.namespace = 'kind' then 'rating' else t.namespace end namespace, t.name, x.confidence score
  from tags_items x join item_data d on d.id = x.item_data_id join tags t on t.id = x.tag_id where x.confidence <= 1 and t.namespace in ('general', 'kind', 'meta'))"""
SEVERITY = ["photo", "line_art", "comic_strip"]
AGGREGATED = f"""{FRAMES}, bs as (select item_id, namespace, name, max(score) s from fr where namespace <> 'rating' group by all),
  vt as (select item_id, frame, name, score, row_number() over (partition by item_id, frame order by score desc, name desc) k from fr where namespace = 'rating'),
  vl as (select *, case name when 'line_art' then 1 when 'comic_strip' then 2 else 0 end lv from vt where k = 1),
  rt as (select item_id, 'rating' namespace, 'rating:' || name as name, score s, row_number() over (partition by item_id order by lv desc, score desc, name desc) k from vl),
  al as (select item_id, namespace, name, s from bs union all select item_id, namespace, name, s from rt where k = 1),
  fi as (select item_id, namespace, min(frame) f from fr group by all),
  ag as (select al.item_id, al.namespace, al.name, round(s * 10000) / 10000 confidence, row_number() over (partition by al.item_id order by f, al.namespace, s desc, al.name) "at" from al join fi using (item_id, namespace))"""


def _texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("item_id is not null").select("item_id", F.col("doc_id").alias("idx"), F.concat(F.lit("  "), F.col("text")).alias("text"))


def _listing(spark, d):
    """A new folder listing: some files changed, some new, some without a type."""
    files = table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max("last_modified").alias("last_modified"), F.max("id").alias("id"))
    seen = files.select(
        F.when(F.col("id") % 10 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("id") % 7 == 0, F.lit("2026-06-30T00:00:00")).otherwise(F.col("last_modified")).alias("last_modified"),
        (F.col("id") % 100).alias("file_size"), F.when(F.col("id") % 13 != 0, F.lit("image/png")).alias("type"), "id",
    )
    return seen


LISTING = """fl as (select path, max(last_modified) last_modified, max(id) id from files where path is not null group by 1),
  ls as (select case when id % 10 = 0 then path || '.new' else path end path, case when id % 7 = 0 then '2026-06-30T00:00:00' else last_modified end last_modified, id % 100 file_size,
    case when id % 13 <> 0 then 'image/png' end type, id from fl)"""
RULES = {"match": {"not_": {"startswith": {"path": ["/library/vol2/tapes", "\\library"]}}}}


def _decided(spark, d):
    return ingest.scan_decisions(catalog(spark, d), _listing(spark, d).drop("id"), RULES).select("path", "last_modified", "decision")


def _upserted(spark, d):
    c = catalog(spark, d)
    found = _listing(spark, d).select("path", "last_modified", "file_size", "type", F.sha2(F.concat(F.lit("new"), F.col("path")), 256).alias("sha256"), F.lit(None).cast("string").alias("md5"), (F.col("id") % 7 == 0).alias("new_hash"))
    return ingest.upsert(c, found, 999, "2026-06-30T00:00:00", 1_000_000, 2_000_000)


def _snapshot(spark, d, later: bool):
    files = table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max("id").alias("id"))
    base = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.lit(1).alias("last_modified"), (F.col("id") % 50).alias("size"), "id")
    if not later:
        return base.where("id % 9 <> 0").withColumn("size", F.when(F.col("id") % 5 != 0, F.col("size"))).drop("id")
    return base.where("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size"))).drop("id")


def registered():
    """Name to (callable, SQL or None)."""
    out = {}
    out["aggregate_tags"] = (lambda spark, d: outputs.aggregate_tags(_frames(spark, d), SEVERITY).withColumn("at", F.col("at").cast("long"))), f"with {AGGREGATED} select item_id, namespace, name, confidence, \"at\" from ag"
    gaps = """gs as (select item_id, confidence c, lead(confidence) over (partition by item_id order by confidence desc) nx, row_number() over (partition by item_id order by confidence desc) k from ag where namespace = 'general'),
        mc as (select item_id, coalesce(arg_max((c + nx) / 2, (c - nx, -k)) filter (where nx is not null), max(c)) m from gs group by 1)"""
    out["tag_texts"] = (lambda spark, d: outputs.tag_texts(cut_lineage(outputs.aggregate_tags(_frames(spark, d), SEVERITY)), "danbooru").withColumns({"confidence": F.round("confidence", 6), "idx": F.col("idx").cast("long")})), f"""
        with {AGGREGATED}, {gaps}
        select item_id, 0::bigint idx, string_agg(name, ', ' order by "at") "text", 'danbooru' as language, round(min(confidence), 6) confidence from ag group by 1
        union all select ag.item_id, 1::bigint, coalesce(string_agg(name, ', ' order by "at") filter (where namespace <> 'general' or confidence >= m), ''), 'danbooru-mcut', round(max(m), 6) from ag join mc using (item_id) group by ag.item_id"""
    out["clean_texts"] = (lambda spark, d: outputs.clean_texts(_texts(spark, d))), """
        with t as (select item_id, doc_id idx, trim('  ' || "text", ' ') "text" from documents where item_id is not null and "text" is not null),
        r as (select *, row_number() over (partition by item_id, lower("text") order by idx) k from t where strlen("text") >= 3) select item_id, idx, "text" from r where k = 1"""
    out["placeholders"] = (lambda spark, d: outputs.with_placeholders(outputs.clean_texts(_texts(spark, d)).select("item_id", "idx"), table(spark, d, "items").select(F.col("id").alias("item_id")))), """
        with t as (select item_id, doc_id idx, trim('  ' || "text", ' ') "text" from documents where item_id is not null and "text" is not null),
        r as (select *, row_number() over (partition by item_id, lower("text") order by idx) k from t where strlen("text") >= 3)
        select item_id, idx, false is_placeholder from r where k = 1 union all select id, null, true from items where id not in (select item_id from r)"""

    def rows(spark, d):
        made = outputs.clean_texts(_texts(spark, d)).select("item_id", "idx", F.col("idx").alias("source_id"))
        return outputs.item_data_rows(made, 7, 18, "text", 5000).select("id", "item_id", "idx", "source_id", "is_origin")

    out["item_data_rows"] = rows, """
        with t as (select item_id, doc_id idx, trim('  ' || "text", ' ') "text" from documents where item_id is not null and "text" is not null),
        r as (select *, row_number() over (partition by item_id, lower("text") order by idx) k from t where strlen("text") >= 3)
        select 4999 + row_number() over (order by item_id, idx) id, item_id, idx, idx source_id, null::boolean is_origin from r where k = 1"""

    def slots(spark, d):
        status = F.when(F.col("id") % 97 == 0, "error").when(F.col("id") % 5 == 0, "input_error").otherwise("ok")
        return outputs.survivors(table(spark, d, "item_data").where("item_id is not null").select("item_id", F.col("id").alias("slot"), status.alias("status"))).select("item_id", "slot")

    out["slot_survivors"] = slots, "select item_id, id slot from item_data where item_id not in (select item_id from item_data where id % 97 = 0 and item_id is not null) and id % 5 <> 0"
    out["rounded_confidence"] = (lambda spark, d: table(spark, d, "tags_items").select("item_data_id", "tag_id", rounded(F.col("confidence") / 3).alias("confidence"))), "select item_data_id, tag_id, round(confidence / 3 * 10000) / 10000 confidence from tags_items"
    out["pk_mix"] = (lambda spark, d: table(spark, d, "files").select("id", pk_mix(F.col("id"), -7).alias("mixed"))), """
        with c as (select 18446744073709551615::uhugeint m, 11400714819323198485::uhugeint g, 13787848793156543929::uhugeint m1, 10723151780598845931::uhugeint m2),
        s0 as (select *, (18446744073709551609::uhugeint + g) & m a from c), s1 as (select *, (xor(a, a >> 30) * m1) & m b from s0), s2 as (select *, (xor(b, b >> 27) * m2) & m e from s1), s as (select *, xor(e, e >> 31) seed from s2),
        x0 as (select f.id, m, m1, m2, (xor(f.id::uhugeint, seed) + g) & m a from files f, s), x1 as (select *, (xor(a, a >> 30) * m1) & m b from x0), x2 as (select *, (xor(b, b >> 27) * m2) & m e from x1), x as (select id, xor(e, e >> 31) u from x2)
        select id, (case when u >= 9223372036854775808::uhugeint then u::hugeint - 18446744073709551616::hugeint else u::hugeint end)::bigint mixed from x"""

    # ingestion
    out["scan_decisions"] = _decided, f"""
        with {with_sql("scan_errors")}, {LISTING} select ls.path, ls.last_modified, case when e.path is not null then 'suppressed' when ls.type is null then 'unknown'
          when starts_with(ls.path, '/library/vol2/tapes') or starts_with(ls.path, '\\library') then 'filtered' when fl.last_modified = ls.last_modified then 'touch' else 'hash' end decision
        from ls left join scan_errors e on e.path = ls.path and e.last_modified = ls.last_modified and e.file_size = ls.file_size and e.stage <> 'decode' and e.attempts >= e.skip_after left join fl on fl.path = ls.path"""
    fresh = "sha256('new' || path)"
    out["upserted_files"] = (lambda spark, d: _upserted(spark, d)["files"].select("path", "sha256", "last_modified", "scan_id", "available")), f"""
        with {LISTING}, n as (select *, id % 7 = 0 new_hash from ls)
        select f.path, f.sha256, coalesce(t.last_modified, f.last_modified) last_modified, case when t.path is not null then 999 else f.scan_id end scan_id, case when t.path is not null then true else f.available end available
        from files f left join n t on t.path = f.path and not t.new_hash where f.path is null or f.path not in (select path from n where new_hash)
        union all select path, {fresh}, last_modified, 999, true from n where new_hash"""
    out["upserted_items"] = (lambda spark, d: _upserted(spark, d)["items"].where("id >= 2000000").select("id", "sha256", "type", "size")), f"""
        with {LISTING} select 1999999 + row_number() over (order by {fresh}) id, {fresh} sha256, type, file_size size from ls"""
    out["marked_unavailable"] = (lambda spark, d: ingest.mark_unavailable(c := catalog(spark, d), 3, "/library/vol1", c["scan_errors"].where("stage = 'hash'")).select("id", "available")), f"""
        with {with_sql("scan_errors")} select id, case when starts_with(path, '/library/vol1') and scan_id <> 3 and path not in (select path from scan_errors where stage = 'hash' and path is not null) then false else available end available from files"""
    out["outside_folders"] = (lambda spark, d: ingest.outside_folders(catalog(spark, d)).select("id")), """
        with p as (select id, replace(path, '\\', '/') p from files) select id from p where p is null or not (starts_with(p, '/library/vol1/') or starts_with(p, '/library/Vault/')) or starts_with(p, '/library/vol1/tapes/')"""
    out["not_allowed"] = (lambda spark, d: ingest.not_allowed(catalog(spark, d), [{"match": {"startswith": {"type": "image/"}}}, {"match": {"gt": {"size": 50000}}}])), """
        select f.id file_id, f.item_id from files f left join items i on i.id = f.item_id where f.item_id is not null and not coalesce(i.type like 'image/%' and i.size > 50000, false)"""
    out["orphan_items"] = (lambda spark, d: ingest.orphan_items(catalog(spark, d)).select("id")), "select id from items where id not in (select item_id from files where item_id is not null)"
    out["orphan_tags"] = (lambda spark, d: ingest.orphan_tags(catalog(spark, d)).select("id")), "select id from tags where id not in (select tag_id from tags_items where tag_id is not null)"
    gone = "g0 as (select id from item_data where item_id in (select id from items where type like 'video/%')), g1 as (select id from item_data where source_id in (select id from g0)), g2 as (select id from item_data where source_id in (select id from g1)), g as (select id from g0 union select id from g1 union select id from g2)"
    out["cascaded_data"] = (lambda spark, d: ingest.cascade(c := catalog(spark, d), items=c["items"].where("type like 'video/%'"))["item_data"].select("id")), f"with {gone} select id from item_data where id not in (select id from g)"
    out["cascaded_tags"] = (lambda spark, d: ingest.cascade(c := catalog(spark, d), items=c["items"].where("type like 'video/%'"))["tags_items"].groupBy("item_data_id").count().withColumnRenamed("count", "n")), f"""
        with {gone} select item_data_id, count(*) n from tags_items where item_data_id not in (select id from g) group by 1"""
    out["clean_incomplete"] = (lambda spark, d: ingest.clean_incomplete(catalog(spark, d))["item_data"].select("id")), """
        with g0 as (select id from item_data where job_id % 7 = 0), g1 as (select id from item_data where source_id in (select id from g0)) select id from item_data where id not in (select id from g0) and id not in (select id from g1)"""
    failed = f"{with_sql('item_extraction_errors')}"
    out["work_items"] = (lambda spark, d: ingest.work(catalog(spark, d), "tagger/merlo", mimes=["image/"]).select("item_id")), f"""
        with {failed} select distinct f.item_id from files f join items i on i.id = f.item_id where i.type like 'image/%'
        and i.id not in (select d.item_id from item_data d join setters s on s.id = d.setter_id where s.name = 'tagger/merlo' and d.item_id is not null)
        and i.id not in (select e.item_id from item_extraction_errors e join setters s on s.id = e.setter_id where s.name = 'tagger/merlo' and e.attempts >= e.skip_after)"""
    out["work_texts"] = (lambda spark, d: ingest.work(catalog(spark, d), "textembed/borough-128", "text", data_types=["text"]).select("data_id")), f"""
        with {failed} select distinct d.id data_id from files f join items i on i.id = f.item_id join item_data d on d.item_id = i.id and d.data_type = 'text' join setters z on z.id = d.setter_id join extracted_text x on x.id = d.id
        where not coalesce(d.is_placeholder, false) and d.id not in (select v.source_id from item_data v join setters s on s.id = v.setter_id where s.name = 'textembed/borough-128' and v.source_id is not null)
        and i.id not in (select e.item_id from item_extraction_errors e join setters s on s.id = e.setter_id where s.name = 'textembed/borough-128' and e.attempts >= e.skip_after)"""
    def updated(spark, d, name, *columns):
        c = catalog(spark, d)
        wanted = spark.createDataFrame([("/library/vol1", True), ("/library/vol1/tapes", False)], "path string, included boolean")
        return ingest.folder_update(c, wanted, [{"match": {"gt": {"size": 20000}}}], drop_unavailable=True)[name].select(*columns)

    kept = """kf as (select f.*, replace(f.path, '\\', '/') p from files f left join items i on i.id = f.item_id where coalesce(f.available, true) and (f.item_id is null or coalesce(i.size > 20000, false))),
        k as (select * from kf where starts_with(p, '/library/vol1/') and not starts_with(p, '/library/vol1/tapes/')), ki as (select id from items where id in (select item_id from k))"""
    out["folder_update_files"] = (lambda spark, d: updated(spark, d, "files", "id", "path")), f"with {kept} select id, path from k"
    out["folder_update_items"] = (lambda spark, d: updated(spark, d, "items", "id")), f"with {kept} select id from ki"
    out["folder_update_texts"] = (lambda spark, d: updated(spark, d, "extracted_text", "id")), f"""
        with {kept}, g as (select id from item_data where item_id in (select id from items where id not in (select id from ki))) select id from extracted_text where id not in (select id from g)"""
    out["inputs_of_texts"] = (lambda spark, d: ingest.inputs(c := catalog(spark, d), c["item_data"].select(F.col("id").alias("data_id")), "extracted_text")), """
        select e.id data_id, d.item_id, e.text from extracted_text e join item_data d on d.id = e.id and d.data_type = 'text'"""
    out["inputs_of_frames"] = (lambda spark, d: ingest.inputs(c := catalog(spark, d), c["items"].select(F.col("id").alias("item_id")), "image_frames").withColumn("frame", F.col("frame").cast("long"))), """
        with p as (select item_id, arg_min(path, (case when available then 0 else 1 end) * 1000000000 + id) path from files where item_id is not null group by 1)
        select i.id item_id, f.frame::bigint frame, p.path from items i join p on p.item_id = i.id, (select unnest([0, 1, 2, 3]) frame) f where f.frame = 0 or i.type like 'video/%'"""
    snap = "sf as (select path, max(id) id from files where path is not null group by 1)"
    out["poll_changes"] = (lambda spark, d: changes.poll(_snapshot(spark, d, False), _snapshot(spark, d, True), spark.createDataFrame([("/library/vol1",)], "dir string"))), f"""
        with {snap}, o as (select path, regexp_replace(path, '/[^/]*$', '') dir, case when id % 5 <> 0 then id % 50 end size from sf where id % 9 <> 0),
        n as (select path, case when id % 4 = 0 then id % 50 + 1 else id % 50 end size from sf where id % 11 <> 0)
        select coalesce(n.path, o.path) path, case when n.path is null then 'remove' else 'upsert' end change from n full join o on o.path = n.path
        where (n.path is null and not (o.dir = '/library/vol1' or starts_with(o.dir, '/library/vol1/'))) or (n.path is not null and (o.path is null or (o.size is not null and o.size <> n.size)))"""

    # windows over the event table, the batch form of the streams
    events = lambda spark, d: table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out["events_tumbling"] = (lambda spark, d: changes.tumbling(events(spark, d), "6 hours").withColumn("total", F.round("total", 4))), """
        select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as "start", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"""
    out["events_sliding"] = (lambda spark, d: changes.sliding(events(spark, d), "12 hours", "6 hours")), """
        with b as (select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') b, event_type from events), w as (select b as "start", event_type from b union all select b - interval '6 hours', event_type from b)
        select "start", event_type, count(*) n from w group by 1, 2"""
    out["events_sessions"] = (lambda spark, d: changes.sessions(events(spark, d), "30 minutes")), """
        with l as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 1 else 0 end s from events),
        g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from l)
        select user_id, min(ts) as "start", max(ts) + interval '30 minutes' as "end", count(*) n from g group by user_id, k"""
    return out
