"""Statistics, bookmarks, boards and ledgers as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalore.operators import ledgers, stats, user
from catalore.plans.compile import Catalog
from catalore.registry.derived import catalog, with_sql

NOW = 1700500000
TEXTS = "et as (select * from extracted_text)"
KEPT = "select d.job_id, count(distinct d.id) n from item_data d where d.job_id is not null and not d.is_placeholder group by 1"
BOARD_COUNTS = """own as (select * from pinboards where usr = 'user'),
  ic as (select version_id, count(*) n from pinboard_version_items group by 1),
  pc as (select p.version_id, count(*) n from pinboard_version_items p where p.sha256 in (select sha256 from items) group by 1),
  vc as (select pinboard_id, count(*) n from pinboard_versions group by 1),
  b as (select o.*, coalesce(ic.n, 0) item_count, coalesce(pc.n, 0) present_count, coalesce(vc.n, 0) version_count from own o
        left join ic on ic.version_id = o.head_version_id left join pc on pc.version_id = o.head_version_id left join vc on vc.pinboard_id = o.id)"""
SCORE = f"4.0 * pow(2.0, -greatest({NOW} - last_seen, 0) / 21600.0) + frecency * pow(2.0, -greatest({NOW} - frecency_at, 0) / 604800.0)"
BOARD_COLUMNS = ["id", "name", "item_count", "present_count", "version_count", "at"]


def _append(spark, d):
    c = catalog(spark, d)
    version = c["pinboards"].where("user = 'user'").select((F.col("id") * 10 + 2).alias("id"), F.col("id").alias("pinboard_id"))
    pins = c["pinboard_version_items"].join(c["pinboards"].where("user = 'user'").select(F.col("head_version_id").alias("version_id")), "version_id", "left_semi")
    after = user.append_version(c, version, pins.withColumn("version_id", F.col("version_id") + 1), "2026-06-30")
    return after["pinboards"].select("id", "head_version_id", "time_updated")


def _delete(spark, d):
    after = user.delete_version(catalog(spark, d), 11)
    return after["pinboards"].select("id", "head_version_id")


def registered():
    """Name to (callable, SQL or None)."""

    def on(f, *columns):
        return (lambda spark, d: f(catalog(spark, d)).select(*columns)) if columns else (lambda spark, d: f(catalog(spark, d)))

    out = {}
    out["tag_recount"] = on(stats.tag_recount), """
        select t.id, t.namespace, t.name, coalesce(c.n, 0) item_count from tags t
        left join (select tag_id, count(distinct item_id) n from tags_items group by 1) c on c.tag_id = t.id"""
    out["tag_autocomplete"] = on(lambda c: stats.tag_autocomplete(c, "ar", 20, recount=True)), """
        select t.namespace, t.name, coalesce(c.n, 0) item_count from tags t
        left join (select tag_id, count(distinct item_id) n from tags_items group by 1) c on c.tag_id = t.id
        where contains(t.name, 'ar') order by item_count desc, t.namespace, t.name limit 20"""
    out["top_tags"] = on(lambda c: stats.top_tags(c, limit=25)), """
        select t.namespace, t.name, count(*) as "count" from tags t join tags_items i on i.tag_id = t.id group by 1, 2 order by 3 desc, 1, 2 limit 25"""
    out["top_tags_of_setters"] = on(lambda c: stats.top_tags(c, "kind", ["tagger/merlo", "tagger/sorrel"], 0.5, 25)), """
        select t.namespace, t.name, count(*) as "count" from tags t join tags_items i on i.tag_id = t.id join item_data d on d.id = i.item_data_id join setters s on s.id = d.setter_id
        where t.namespace >= 'kind' and t.namespace < 'kine' and i.confidence >= 0.5 and s.name in ('tagger/merlo', 'tagger/sorrel') group by 1, 2 order by 3 desc, 1, 2 limit 25"""
    out["tag_frequency"] = on(lambda c: stats.tag_frequency(c, limit=25)), """
        with top as (select t.namespace, t.name, count(*) as "count" from tags t join tags_items i on i.tag_id = t.id group by 1, 2 order by 3 desc, 1, 2 limit 25),
        total as (select count(distinct concat(d.item_id, '-', d.setter_id)) n from tags_items i join item_data d on d.id = i.item_data_id)
        select namespace, name, "count", "count" / n::double frequency from top, total"""
    out["tag_namespaces"] = on(stats.tag_namespaces), """
        with own as (select distinct namespace from tags where namespace is not null)
        select namespace from own union all select distinct split_part(namespace, ':', 1) from own where contains(namespace, ':')"""
    out["min_tag_confidence"] = on(stats.min_tag_confidence), "select coalesce(min(confidence), 0.0) min_confidence from tags_items"
    out["text_stats"] = on(stats.text_stats), f"""
        with {TEXTS} select string_agg(distinct language, ',' order by language) languages, min(language_confidence) lowest_language_confidence, min(confidence) lowest_confidence from et"""
    out["file_stats"] = on(stats.file_stats), "select (select count(*) from files) files, (select count(*) from items) items"
    out["mime_types"] = on(stats.mime_types), """
        with t as (select distinct type from items where type is not null) select type from t union all select distinct split_part(type, '/', 1) || '/' from t"""
    out["existing_setters"] = on(stats.existing_setters), "select distinct d.data_type, s.name setter from item_data d join setters s on s.id = d.setter_id"
    out["setter_totals"] = on(stats.setter_totals), "select s.name setter, count(*) total from item_data d join setters s on s.id = d.setter_id where not coalesce(d.is_placeholder, false) group by 1"
    out["job_history"] = on(stats.job_history, "id", "start_time", "items_in_db", "failed", "status"), f"""
        with {with_sql("data_log", "data_jobs")}, kept as ({KEPT})
        select l.id, l.start_time, coalesce(k.n, 0) items_in_db, case when l.completed then 0 when l.job_id is null then 1 else 0 end failed, j.completed status
        from data_log l left join kept k on k.job_id = l.job_id left join data_jobs j on j.id = l.job_id"""
    out["scan_history"] = on(lambda c: stats.scan_history(c, 2, 10), "id", "start_time", "total_available"), f"""
        with {with_sql("file_scans")} select id, start_time, total_available from file_scans order by start_time desc, id desc limit 10 offset 10"""
    out["item_tags"] = on(lambda c: stats.item_tags(c, c["items"].select(F.col("id").alias("item_id")), confidence=0.3, namespaces=["general", "kind"], limit_per_namespace=2)), """
        with r as (select d.item_id, s.name setter, t.namespace, t.name, i.confidence,
                     row_number() over (partition by d.item_id, s.name, t.namespace order by i.confidence desc nulls last, t.name) k
                   from tags_items i join item_data d on d.id = i.item_data_id and d.data_type = 'tags' join setters s on s.id = d.setter_id join tags t on t.id = i.tag_id
                   where i.confidence >= 0.3 and (starts_with(t.namespace, 'general') or starts_with(t.namespace, 'kind')) and d.item_id in (select id from items))
        select item_id, setter, namespace, name, confidence from r where k <= 2"""
    out["item_texts"] = on(lambda c: stats.item_texts(c, c["items"].select(F.col("id").alias("item_id")), 40), "item_id", "setter", "data_id", "idx", "text", "full_length"), f"""
        with {TEXTS} select d.item_id, s.name setter, e.id data_id, d.idx, substring(e.text, 1, 40) "text", length(e.text) full_length
        from et e join item_data d on d.id = e.id and d.data_type = 'text' join setters s on s.id = d.setter_id where d.item_id in (select id from items)"""
    out["texts_by_id"] = on(lambda c: stats.texts_by_id(c, [2, 10, 42, 333, 1251, 2353])), f"""
        with {TEXTS} select e.id data_id, d.item_id, s.name setter, e.language, e.text from et e join item_data d on d.id = e.id and d.data_type = 'text' join setters s on s.id = d.setter_id
        where e.id in (2, 10, 42, 333, 1251, 2353)"""
    meta = "select i.id item_id, i.sha256, i.type, f.id file_id, f.path, f.available from items i left join files f on f.item_id = i.id"
    for kind, value, where in (("item_id", 4, "i.id = 4"), ("sha256", "AD", "starts_with(i.sha256, 'ad')"), ("file_id", 57, "i.id in (select item_id from files where id = 57)"), ("data_id", 42, "i.id in (select item_id from item_data where id = 42)")):
        out[f"item_by_{kind}"] = on(lambda c, v=value, k=kind: stats.item_metadata(c, v, k).select("item_id", c["items"].columns[1], "type", "file_id", "path", "available")), f"{meta} where {where}"
    marked = "usr in ('user', '*')"
    listed = f"""with {with_sql("bookmarks")}, m as (select sha256, max(time_added) time_added, min(namespace) namespace from bookmarks where {marked} group by 1),
        p as (select sha256, min(case when available then path end) here, min(path) anywhere, max(last_modified) last_modified from files group by 1)
        select m.sha256, coalesce(here, anywhere) path, last_modified, time_added, namespace from m join p using (sha256)"""
    out["bookmarks_list"] = on(lambda c: user.bookmarks(c, page_size=1 << 30)), listed
    out["bookmarks_page"] = on(lambda c: user.bookmarks(c, order_by="path", page=2, page_size=25)), f"{listed} order by path, sha256 limit 25 offset 25"
    out["bookmark_total"] = on(lambda c: user.bookmark_total(c, "click")), f"""
        with {with_sql("bookmarks")} select count(distinct sha256) total from bookmarks where {marked} and namespace = 'click' and sha256 in (select sha256 from files)"""
    out["bookmark_namespaces"] = on(user.bookmark_namespaces), f"with {with_sql('bookmarks')} select distinct namespace from bookmarks where usr = 'user'"
    out["bookmark_users"] = on(user.bookmark_users), f"""with {with_sql("bookmarks")} select distinct usr "user" from bookmarks"""
    out["bookmarks_keep_last"] = on(lambda c: user.keep_last(c, 20, "click").select("user", "namespace", "sha256", "time_added")), f"""
        with {with_sql("bookmarks")}, r as (select *, row_number() over (partition by usr, namespace order by time_added desc, sha256) k from bookmarks)
        select usr "user", namespace, sha256, time_added from r where k <= 20 or not (usr = 'user' and namespace = 'click')"""
    out["boards_by_activity"] = on(lambda c: user.boards(c, now=NOW).select(*BOARD_COLUMNS)), f"""
        with {with_sql("pinboards", "pinboard_versions", "pinboard_version_items")}, {BOARD_COUNTS},
        r as (select *, row_number() over (order by last_seen desc nulls last, id desc) strip from b)
        select id, name, item_count, present_count, version_count, row_number() over (order by least(strip, 6), case when strip <= 5 then 0.0 else {SCORE} end desc, last_seen desc, id desc) "at" from r"""
    out["boards_by_update"] = on(lambda c: user.boards(c, order="updated").select(*BOARD_COLUMNS)), f"""
        with {with_sql("pinboards", "pinboard_versions", "pinboard_version_items")}, {BOARD_COUNTS}
        select id, name, item_count, present_count, version_count, row_number() over (order by time_updated desc nulls last, id desc) "at" from b"""
    out["boards_by_name"] = on(lambda c: user.boards(c, name_query="urg board", order="updated").select("id", "name")), f"""
        with {with_sql("pinboards")} select id, name from pinboards where usr = 'user' and regexp_matches(lower(name), '(^|[^a-z0-9])urg') and regexp_matches(lower(name), '(^|[^a-z0-9])board')"""
    out["boards_associated"] = on(lambda c: user.associations(c, user.boards(c, order="updated"), "uuid-1", "main", "instance-2", ["uuid-1", "uuid-2"]).select("id", "associated")), f"""
        with {with_sql("pinboards", "pinboard_versions", "pinboard_version_items", "pinboard_databases")}, {BOARD_COUNTS},
        st as (select distinct pinboard_id from pinboard_databases where db_uuid = 'uuid-1' or (instance_uuid = 'instance-2' and db_name = 'main' and db_uuid not in ('uuid-1', 'uuid-2')))
        select b.id, (item_count > 0 and present_count = item_count) or st.pinboard_id is not null associated from b left join st on st.pinboard_id = b.id"""
    out["boards_search"] = on(lambda c: user.boards_search(c, {"query": {"match": {"startswith": {"type": "image/"}}}, "order_by": [{"order_by": "size", "order": "desc"}]}, now=NOW).select("id", "match_count", "item_count", "best_key", "at")), f"""
        with {with_sql("pinboards", "pinboard_versions", "pinboard_version_items")}, {BOARD_COUNTS},
        f as (select distinct i.sha256, i.size from items i join files f on f.item_id = i.id where i.type like 'image/%'),
        h as (select p.version_id, count(distinct p.sha256) match_count, max(f.size) best_key from pinboard_version_items p join f using (sha256) group by 1)
        select b.id, h.match_count, b.item_count, h.best_key,
          row_number() over (order by h.best_key desc nulls last, h.match_count / b.item_count::double desc nulls last, h.match_count desc, {SCORE} desc, last_seen desc, b.id desc) "at"
        from b join h on h.version_id = b.head_version_id"""
    out["board_version_added"] = _append, f"""
        with {with_sql("pinboards")} select id, case when usr = 'user' then id * 10 + 2 else head_version_id end head_version_id, case when usr = 'user' then '2026-06-30' else time_updated end time_updated from pinboards"""
    out["board_version_deleted"] = _delete, f"with {with_sql('pinboards')} select id, case when id = 1 then 10 else head_version_id end head_version_id from pinboards"
    out["board_versions"] = on(lambda c: user.versions(c, 7)), f"""
        with {with_sql("pinboards", "pinboard_versions", "pinboard_version_items")} select v.id, v.time_added, count(i.sha256) items, v.id in (select head_version_id from pinboards) head
        from pinboard_versions v left join pinboard_version_items i on i.version_id = v.id where v.pinboard_id = 7 group by 1, 2"""
    out["extraction_audit"] = on(lambda c: ledgers.extraction_audit(c, error_class="input", mime_prefix="image/").select("id", "item_id", "setter", "attempts", "active", "path")), f"""
        with {with_sql("item_extraction_errors")}, p as (select item_id, arg_min(path, (case when available then 0 else 1 end) * 1000000000 + id) path from files where item_id is not null group by 1)
        select e.id, e.item_id, s.name setter, e.attempts, e.attempts >= e.skip_after active, p.path from item_extraction_errors e join setters s on s.id = e.setter_id left join p on p.item_id = e.item_id
        where e.error_class = 'input' and starts_with(e.mime_type, 'image/')"""
    out["scan_audit"] = on(lambda c: ledgers.scan_audit(c, stage="hash").select("id", "path", "attempts", "last_seen")), f"""
        with {with_sql("scan_errors")} select id, path, attempts, last_seen from scan_errors where stage = 'hash'"""
    out["scan_suppressed"] = on(lambda c: ledgers.suppressed(c, c["files"].select("path", "last_modified", (F.col("id") % 100).alias("file_size"))).select("path", "last_modified").distinct()), f"""
        with {with_sql("scan_errors")} select distinct f.path, f.last_modified from files f join scan_errors e on e.path = f.path and e.last_modified = f.last_modified and e.file_size = f.id % 100
        where e.stage <> 'decode' and e.attempts >= e.skip_after"""
    failures = "select item_id, setter_id, 60 as last_job_id, '2026-06-30' as last_seen from item_extraction_errors"

    def failed_again(c: Catalog):
        old = c["item_extraction_errors"]
        new = old.withColumns({"last_job_id": F.lit(60).cast("long"), "last_seen": F.lit("2026-06-30")})
        return ledgers.record_extraction_errors(c, new).select("id", "attempts", "last_job_id", "last_seen", "first_seen")

    out["extraction_ledger"] = on(failed_again), f"""
        with {with_sql("item_extraction_errors")} select e.id, e.attempts + 1 attempts, n.last_job_id::bigint last_job_id, n.last_seen, e.first_seen
        from item_extraction_errors e join ({failures}) n using (item_id, setter_id)"""
    return out
