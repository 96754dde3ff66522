"""Queries of the query language as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalore.functions import vectors
from catalore.operators import quants
from catalore.operators.textindex import TextIndex
from catalore.plans.compile import counted, item_set, search
from catalore.plans.service import existing_paths, without_outro
from catalore.operators.user import annotate
from catalore.registry.derived import catalog, with_sql

ALL = 0  # page size without a limit
TEXTS = "et as (select * from extracted_text)"
#: Rows of a query for files and for texts, all base tables joined.
FILES = """std as (select f.id file_id, f.item_id, f.sha256, f.path, f.filename, f.last_modified, f.available, i.type, i.size, i.width, i.height, i.duration, i.md5, i.time_added
  from files f join items i on i.id = f.item_id)"""
TEXT_ROWS = f"""{TEXTS}, std as (select f.id file_id, f.item_id, d.id data_id, f.sha256, f.path, f.last_modified, i.type, e.language, e.confidence, e.language_confidence, e.text, e.text_length,
  d.idx data_index, d.source_id, s.name setter_name
  from files f join items i on i.id = f.item_id join item_data d on d.item_id = f.item_id and d.data_type = 'text' join setters s on s.id = d.setter_id join et e on e.id = d.id)"""
IMAGE, TEXT_MODEL = "clip/halcyon-96", "textembed/borough-128"
QUERY96 = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(96)]
QUERY128 = [round(((i * 23) % 17 - 8) / 10, 1) for i in range(128)]


def _hits(text: str, term: str) -> str:
    return f"((length(lower({text})) - length(replace(lower({text}), '{term}', ''))) // {len(term)})"


def _grams(text: str) -> str:
    return f"greatest(coalesce(length({text}), 0) - 2, 0)"


def bm25(table: str, key: str, texts: list[str], terms: list[str], searched: list[str] | None = None, where: str | None = None) -> str:
    """SQL of (key, rank) for rows that hold all terms (or satisfy ``where``)."""
    searched = searched or texts
    size = " + ".join(_grams(t) for t in texts)
    has = lambda t: "(" + " or ".join(f"coalesce(contains(lower({c}), '{t}'), false)" for c in searched) + ")"
    df = ", ".join(f"sum(case when {has(t)} then 1 else 0 end) df{i}" for i, t in enumerate(terms))
    parts = []
    for i, t in enumerate(terms):
        tf = " + ".join(f"coalesce({_hits(c, t)}, 0)" for c in searched)
        idf = f"case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 then ln((n - df{i} + 0.5) / (df{i} + 0.5)) else 1e-6 end"
        parts.append(f"({idf}) * ({tf}) * 2.2 / (({tf}) + 1.2 * (1 - 0.75 + 0.75 * ({size}) / (tokens / n::double)))")
    ok = where or " and ".join(has(t) for t in terms)
    return f"select {key}, -({' + '.join(parts)}) as rank from {table}, (select count(*) n, sum({size}) tokens, {df} from {table}) where {ok}"


def _distance(metric: str, a: str, b: str) -> str:
    a, b = f"{a}::double[]", f"{b}::double[]"
    if metric == "L2":
        return f"list_distance({a}, {b})"
    return f"list_cosine_distance({a}, {b})"


def _literal(q) -> str:
    return "[" + ",".join(map(str, q)) + "]"


def _quantized(c):
    """The catalogue with int8 codes of all spaces, ready for use."""
    codes, steps = quants.encode(c, least=1)
    profiles = c.spark.createDataFrame([(1, "int8", "int8", "{}", "active", True)], "id long, name string, quantizer string, options string, state string, is_default boolean")
    spaces = {r["setter"]: (r["space"], r["dim"]) for r in quants.spaces(c).collect()}
    setters = c["setters"].where(F.col("name").isin(*spaces)).collect()
    rows = [(1, r["id"], True, steps[spaces[r["name"]][0]], 1, 0, spaces[r["name"]][1], "L2", "ready") for r in setters]
    cover = c.spark.createDataFrame(rows, "profile_id long, setter_id long, needs_artifact boolean, artifact double, artifact_rev long, n_at_artifact long, dim long, metric string, state string")
    return c.but(embedding_quants=codes.drop("setter"), vector_quant_profiles=profiles, vector_quant_coverage=cover)


def _target(spark, d, setter: str = IMAGE):
    """The content hash of the first item that a vector model has covered: known by id, looked up when the query is made."""
    c = catalog(spark, d)
    owner = c["item_data"].join(c["setters"].where(F.col("name") == setter).select(F.col("id").alias("setter_id")), "setter_id").join(c["embeddings"].where(F.size("embedding") == 96).select("id"), "id")
    least = owner.agg(F.min("item_id").alias("id"))
    return c, c["items"].join(least, "id").first()["sha256"]


TARGET = """tgt as (select i.* from items i where i.id = (select min(d.item_id) from item_data d join setters s on s.id = d.setter_id and s.name = 'clip/halcyon-96'
  join vector_fixtures v on v.id = d.id and len(v.embedding) = 96))"""


def registered():
    """Name to (callable, SQL or None)."""
    out = {}

    def add(name, query, sql, rounded=(), select=None, count=False, make=catalog, **more):
        def run(spark, d):
            c = make(spark, d)
            df = search(c, query, **more)
            for r in rounded:
                df = df.withColumn(r, F.round(F.col(r).cast("double"), 6))
            return df.select(*select) if select else df

        out[name] = run, sql
        if count:
            out[f"{name}_count"] = (lambda spark, d: counted(make(spark, d), query)), f"select count(*) total from ({sql})"

    files = f"with {FILES} select file_id, item_id from std"
    texts = f"with {TEXT_ROWS} select file_id, item_id, data_id from std"

    # envelope
    add("base_files", {"select": ["path", "size"], "page_size": ALL}, f"with {FILES} select file_id, item_id, path, size from std", count=True)
    add("base_texts", {"entity": "text", "select": ["setter_name", "data_index", "text_length"], "page_size": ALL}, f"with {TEXT_ROWS} select file_id, item_id, data_id, setter_name, data_index, text_length from std", count=True)
    add("page_default_order", {"select": ["last_modified"], "page_size": 50, "page": 2}, f"with {FILES} select file_id, item_id, last_modified from std order by last_modified desc nulls last, file_id limit 50 offset 50")
    add("order_by_many", {"select": ["type", "size"], "page_size": 100, "order_by": [{"order_by": "size", "order": "desc"}, {"order_by": "type", "priority": 5}]}, f"with {FILES} select file_id, item_id, type, size from std order by type nulls last, size desc nulls last, file_id limit 100")
    add("partition_by_type", {"select": ["type", "path"], "partition_by": ["type"], "page_size": ALL, "order_by": [{"order_by": "size", "order": "desc"}]}, f"""
        with {FILES}, r as (select *, row_number() over (partition by type order by size desc nulls last, file_id) k from std) select file_id, item_id, type, path from r where k = 1""")
    out["partition_count"] = (lambda spark, d: counted(catalog(spark, d), {"partition_by": ["type", "width"]})), f"with {FILES} select count(distinct type || width::varchar) total from std"
    add("random_order", {"select": [], "order_by": [{"order_by": "random"}], "seed": 42, "page_size": 100}, f"""
        with {FILES}, c as (select 18446744073709551615::uhugeint m, 11400714819323198485::uhugeint g, 13787848793156543929::uhugeint m1, 10723151780598845931::uhugeint m2),
        s0 as (select *, (42::uhugeint + g) & m a from c), s1 as (select *, (xor(a, a >> 30) * m1) & m b from s0), s2 as (select *, (xor(b, b >> 27) * m2) & m e from s1), s as (select *, xor(e, e >> 31) seed from s2),
        x0 as (select std.file_id, std.item_id, m, m1, m2, (xor(std.file_id::uhugeint, seed) + g) & m a from std, s), x1 as (select *, (xor(a, a >> 30) * m1) & m b from x0),
        x2 as (select *, (xor(b, b >> 27) * m2) & m e from x1), x as (select file_id, item_id, xor(e, e >> 31) u from x2)
        select file_id, item_id from x order by case when u >= 9223372036854775808::uhugeint then u::hugeint - 18446744073709551616::hugeint else u::hugeint end, file_id limit 100""")

    # attribute predicates
    tests = {
        "eq": ({"eq": {"type": "image/png"}}, "type = 'image/png'"),
        "neq": ({"neq": {"type": "image/png"}}, "type <> 'image/png'"),
        "bounds": ({"gte": {"size": 100000}, "lt": {"size": 3000000}, "gt": {"width": 100}, "lte": {"height": 3000}}, "size >= 100000 and size < 3000000 and width > 100 and height <= 3000"),
        "in": ({"in_": {"type": ["image/png", "video/mp4"]}, "nin": {"width": [640, 1280]}}, "type in ('image/png', 'video/mp4') and width not in (640, 1280)"),
        "startswith": ({"startswith": {"type": ["image/", "audio/"]}, "not_startswith": {"path": ["/library/vol1", "\\library"]}}, "(type like 'image/%' or type like 'audio/%') and path not like '/library/vol1%' and path not like '\\library%'"),
        "endswith": ({"endswith": {"path": [".png", ".fl_c"]}, "not_endswith": {"filename": "a.png"}}, "(path like '%.png' or path like '%.fl_c') and filename not like '%a.png'"),
        "contains": ({"contains": {"path": "nas-b"}, "not_contains": {"path": "tapes"}}, "path like '%nas-b%' and path not like '%tapes%'"),
        "backslash": ({"contains": {"path": "library\\nas-b\\"}}, "contains(path, 'library\\nas-b\\')"),
        "numeric_text": ({"startswith": {"width": "12"}}, "width::varchar like '12%'"),
        "and": ({"and_": [{"eq": {"available": True}}, {"gt": {"size": 1000000}}]}, "available = true and size > 1000000"),
        "or": ({"or_": [{"eq": {"type": "image/png"}}, {"gt": {"duration": 100}}]}, "type = 'image/png' or duration > 100"),
        "not": ({"not_": {"gt": {"width": 1000}}}, "not (width > 1000)"),
    }
    for name, (ops, where) in tests.items():
        add(f"match_{name}", {"query": {"match": ops}, "select": [], "page_size": ALL}, f"{files} where {where}", count=name in ("eq", "or"))
    add("match_text_columns", {"entity": "text", "query": {"match": {"eq": {"language": "en"}, "gte": {"confidence": 0.5}, "startswith": {"setter_name": "ocr/"}}}, "select": [], "page_size": ALL}, f"{texts} where language = 'en' and confidence >= 0.5 and setter_name like 'ocr/%'", count=True)

    # boolean tree
    add("not_keeps_unknown", {"query": {"not_": {"match": {"gt": {"width": 1000}}}}, "select": [], "page_size": ALL}, f"{files} where not coalesce(width > 1000, false)", count=True)
    add("or_of_filters", {"query": {"or_": [{"match": {"eq": {"type": "image/png"}}}, {"match_path": {"match": "lantern"}}, {"match_tags": {"tags": ["photo"]}}]}, "select": [], "page_size": ALL}, f"""
        {files} where type = 'image/png' or contains(lower(path), 'lantern') or contains(lower(filename), 'lantern') or item_id in
        (select d.item_id from tags_items x join tags t on t.id = x.tag_id join item_data d on d.id = x.item_data_id and d.data_type = 'tags' where t.name = 'photo')""", count=True)
    add("nested_tree", {"query": {"and_": [{"or_": [{"match": {"startswith": {"type": "video/"}}}, {"match": {"startswith": {"type": "audio/"}}}]}, {"not_": {"or_": [{"match_path": {"match": "tapes"}}, {"match": {"lt": {"size": 10000}}}]}}]}, "select": [], "page_size": ALL}, f"""
        {files} where (type like 'video/%' or type like 'audio/%') and not (coalesce(contains(lower(path), 'tapes'), false) or coalesce(contains(lower(filename), 'tapes'), false) or coalesce(size < 10000, false))""", count=True)

    # full text
    path_rank = bm25("(select id file_id, path, filename from files)", "file_id", ["path", "filename"], ["lantern"])
    add("match_path", {"query": {"match_path": {"match": "lantern"}, "select_as": "rank"}, "select": [], "page_size": ALL}, f"with {FILES}, h as ({path_rank}) select file_id, item_id, round(rank, 6) rank from std join h using (file_id)", ["rank"], count=False)
    add("match_path_name", {"query": {"match_path": {"match": "gallery NOT png", "filename_only": True}}, "select": [], "page_size": ALL}, f"{files} where contains(lower(filename), 'gallery') and not contains(lower(filename), 'png')", count=True)
    add("match_path_escaped", {"query": {"match_path": {"match": 'press "cuttings/20', "raw_fts5_match": False}}, "select": [], "page_size": ALL}, f"""
        {files} where (contains(lower(path), 'press') or contains(lower(filename), 'press')) and (contains(lower(path), 'cuttings/20') or contains(lower(filename), 'cuttings/20'))""")
    text_rank = bm25("et", "id", ["text"], ["winter", "album"])
    add("match_text", {"query": {"match_text": {"match": "winter AND album"}, "select_as": "rank"}, "select": [], "page_size": ALL}, f"""
        with {FILES}, {TEXTS}, h as ({text_rank}), b as (select d.item_id, min(h.rank) rank from h join item_data d on d.id = h.id join setters s on s.id = d.setter_id group by 1)
        select file_id, std.item_id, round(rank, 6) rank from std join b on b.item_id = std.item_id""", ["rank"])
    add("match_text_texts", {"entity": "text", "query": {"match_text": {"match": '"blurred portrait" OR film*', "setters": ["ocr/linocut", "ocr/galley"], "languages": ["en", "de"], "min_confidence": 0.6, "min_length": 50, "max_length": 1500}, "order_by": True, "select_as": "rank"}, "select": [], "page_size": ALL}, f"""
        with {TEXT_ROWS}, h as ({bm25("et", "id", ["text"], ["blurred portrait", "film"], where="contains(lower(text), 'blurred portrait') or contains(lower(text), 'film')")})
        select file_id, item_id, data_id, round(rank, 6) rank from std join h on h.id = std.data_id where setter_name in ('ocr/linocut', 'ocr/galley') and language in ('en', 'de') and confidence >= 0.6 and text_length between 50 and 1500""", ["rank"])
    add("match_text_filter_only", {"query": {"match_text": {"match": "", "filter_only": True, "languages": ["fr"], "min_language_confidence": 0.9}}, "select": [], "page_size": ALL}, f"""
        with {FILES}, {TEXTS} select file_id, item_id from std where item_id in (select d.item_id from et e join item_data d on d.id = e.id join setters s on s.id = d.setter_id where e.language = 'fr' and e.language_confidence >= 0.9)""", count=True)
    # the same from postings, with NEAR and column filters
    texts_indexed = lambda spark, d: (c := catalog(spark, d)).indexed(extracted_text=TextIndex.build(c["extracted_text"], "id", ["text"]))
    paths_indexed = lambda spark, d: (c := catalog(spark, d)).indexed(files=TextIndex.build(c["files"], "id", ["path", "filename"]))
    once = "et as (select id, max(text) \"text\" from extracted_text group by 1)"
    add("match_text_indexed", {"query": {"match_text": {"match": "winter AND album"}, "select_as": "rank"}, "select": [], "page_size": ALL}, f"""
        with {FILES}, {once}, h as ({text_rank}), b as (select d.item_id, min(h.rank) rank from h join item_data d on d.id = h.id join setters s on s.id = d.setter_id group by 1)
        select file_id, std.item_id, round(rank, 6) rank from std join b on b.item_id = std.item_id""", ["rank"], make=texts_indexed)
    add("match_path_indexed", {"query": {"match_path": {"match": "lantern"}, "select_as": "rank"}, "select": [], "page_size": ALL}, f"with {FILES}, h as ({path_rank}) select file_id, item_id, round(rank, 6) rank from std join h using (file_id)", ["rank"], make=paths_indexed)
    column_rank = bm25("(select id file_id, path, filename from files)", "file_id", ["path", "filename"], ["gallery"], ["filename"])
    add("match_path_column", {"query": {"match_path": {"match": "filename: gallery"}, "select_as": "rank"}, "select": [], "page_size": ALL}, f"with {FILES}, h as ({column_rank}) select file_id, item_id, round(rank, 6) rank from std join h using (file_id)", ["rank"])
    column_not = f"{files} where contains(lower(path), 'vol1') and not coalesce(contains(lower(filename), 'lantern'), false)"
    add("match_path_column_not", {"query": {"match_path": {"match": "- filename: vol1 NOT {filename} : lantern"}}, "select": [], "page_size": ALL}, column_not, count=True, make=paths_indexed)
    spots = lambda word: f"list_filter(range(1, length(lower(text))), lambda i: substr(lower(text), i, {len(word)}) = '{word}')"
    near_sql = f"""with {FILES}, {TEXTS}, p as (select id, unnest({spots('winter')}) a, {spots('album')} bs from et where contains(lower(text), 'winter') and contains(lower(text), 'album')),
        q as (select id, a, unnest(bs) b from p), hit as (select distinct id from q where (b >= a and a + 4 + 3 >= b) or (a >= b and b + 3 + 3 >= a))
        select file_id, item_id from std where item_id in (select d.item_id from hit join item_data d on d.id = hit.id join setters s on s.id = d.setter_id)"""
    add("match_text_near", {"query": {"match_text": {"match": "NEAR(winter album, 3)"}}, "select": [], "page_size": ALL}, near_sql, count=True)
    add("match_text_near_indexed", {"query": {"match_text": {"match": "NEAR(winter album, 3)"}}, "select": [], "page_size": ALL}, near_sql, make=texts_indexed)
    out["text_postings"] = (lambda spark, d: TextIndex.build(catalog(spark, d)["extracted_text"], "id", ["text"]).postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("at")).alias("n"))), f"""
        with {once}, g as (select id, unnest(list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3))) gram from et where length(text) >= 3) select gram, count(distinct id) texts, count(*) n from g group by 1"""
    piece = "greatest(1, least(strpos(lower(text), 'lantern') - 14, length(text) - 31))"
    add("match_text_snippet", {"entity": "text", "query": {"match_text": {"match": "lantern", "select_snippet_as": "snip"}}, "select": [], "page_size": ALL}, f"""
        with {TEXT_ROWS}, p as (select *, {piece} b from std where contains(lower(text), 'lantern'))
        select file_id, item_id, data_id, (case when b > 1 then '...' else '' end) || regexp_replace(substring(text, b::int, 32), '(?i)(lantern)', '<b>\\1</b>', 'g') || (case when b + 31 < length(text) then '...' else '' end) snip from p""")

    # tags
    tagged = """select d.item_id, avg(x.confidence) conf, count(distinct t.name) tags, count(distinct d.setter_id || '-' || t.name) pairs
        from tags_items x join tags t on t.id = x.tag_id join item_data d on d.id = x.item_data_id and d.data_type = 'tags' join setters s on s.id = d.setter_id where """
    for name, args, where, having in (
        ("all", {"tags": ["photo", "warm_tones"]}, "t.name in ('photo', 'warm_tones')", "tags = 2"),
        ("any", {"tags": ["photo", "pastel"], "match_any": True, "min_confidence": 0.5}, "t.name in ('photo', 'pastel') and x.confidence >= 0.5", "true"),
        ("namespaces", {"tags": ["photo"], "namespaces": ["kind", "mini"], "setters": ["tagger/sorrel", "tagger/pinto-mini"]}, "t.name = 'photo' and (t.namespace like 'kind%' or t.namespace like 'mini%') and s.name in ('tagger/sorrel', 'tagger/pinto-mini')", "tags = 1"),
        ("all_setters", {"tags": ["photo"], "setters": ["tagger/sorrel", "tagger/pinto-mini"], "all_setters_required": True}, "t.name = 'photo' and s.name in ('tagger/sorrel', 'tagger/pinto-mini')", "pairs = 2"),
    ):
        add(f"match_tags_{name}", {"query": {"match_tags": args, "select_as": "conf"}, "select": [], "page_size": ALL}, f"""
            with {FILES}, h as ({tagged} {where} group by 1) select file_id, std.item_id, round(conf, 6) conf from std join h on h.item_id = std.item_id where {having}""", ["conf"], count=True)
    add("match_tags_texts", {"entity": "text", "query": {"match_tags": {"tags": ["photo"]}, "order_by": True}, "select": [], "page_size": 100}, f"""
        with {TEXT_ROWS}, h as ({tagged} t.name = 'photo' group by 1) select file_id, std.item_id, data_id from std join h on h.item_id = std.item_id order by conf desc nulls last, file_id, data_id limit 100""", count=False)

    # user data and processing state
    marks = with_sql("bookmarks")
    add("in_bookmarks", {"query": {"in_bookmarks": {"namespaces": ["click"], "sub_ns": True}, "order_by": True, "select_as": "marked"}, "select": [], "page_size": ALL}, f"""
        with {marks}, {FILES}, m as (select sha256, max(time_added) marked from bookmarks where usr in ('user', '*') and (namespace = 'click' or namespace like 'click.%') group by 1)
        select file_id, item_id, marked from std join m using (sha256)""", count=True)
    pins = with_sql("pinboards", "pinboard_version_items")
    add("in_pinboard", {"query": {"in_pinboard": {"pinboard_ids": [1, 2, 3, 4, 5, 6, 7]}}, "select": [], "page_size": ALL}, f"""
        with {pins}, {FILES} select file_id, item_id from std where sha256 in (select sha256 from pinboard_version_items v join pinboards p on p.head_version_id = v.version_id where p.usr = 'user' and p.id in (1, 2, 3, 4, 5, 6, 7))""", count=True)
    add("not_in_pinboard", {"query": {"not_": {"in_pinboard": {}}}, "select": [], "page_size": ALL}, f"""
        with {pins}, {FILES} select file_id, item_id from std where sha256 is null or sha256 not in (select sha256 from pinboard_version_items v join pinboards p on p.head_version_id = v.version_id where p.usr = 'user')""", count=True)
    by = "(select d.{} from item_data d join setters s on s.id = d.setter_id where s.name = '{}' and d.{} is not null)"
    add("processed_by", {"query": {"processed_by": "tagger/merlo"}, "select": [], "page_size": ALL}, f"{files} where item_id in {by.format('item_id', 'tagger/merlo', 'item_id')}", count=True)
    add("processed_by_texts", {"entity": "text", "query": {"processed_by": TEXT_MODEL}, "select": [], "page_size": ALL}, f"{texts} where data_id in {by.format('source_id', TEXT_MODEL, 'source_id')}", count=True)
    lacking = f"(select id from item_data where data_type = 'text' and not coalesce(is_placeholder, false) and id not in {by.format('source_id', TEXT_MODEL, 'source_id')})"
    add("has_unprocessed", {"query": {"has_data_unprocessed": {"setter_name": TEXT_MODEL, "data_types": ["text"]}}, "select": [], "page_size": ALL}, f"{files} where item_id in (select item_id from item_data where id in {lacking})", count=True)
    add("has_unprocessed_texts", {"entity": "text", "query": {"has_data_unprocessed": {"setter_name": TEXT_MODEL, "data_types": ["text"]}}, "select": [], "page_size": ALL}, f"{texts} where data_id in {lacking}", count=True)
    add("failed_for", {"query": {"failed_for": "tagger/merlo"}, "select": [], "page_size": ALL}, f"""
        with {with_sql("item_extraction_errors")}, {FILES} select file_id, item_id from std where item_id in (select e.item_id from item_extraction_errors e join setters s on s.id = e.setter_id where s.name = 'tagger/merlo' and e.attempts >= e.skip_after)""", count=True)

    # ranks and their fusion
    item_rank = f"select d.item_id, min(h.rank) rank from ({bm25('et', 'id', ['text'], ['lantern'])}) h join item_data d on d.id = h.id join setters s on s.id = d.setter_id group by 1"
    ranked = f"""with {FILES}, {TEXTS}, p0 as ({path_rank}), p as (select std.file_id, std.item_id, rank, row_number() over (order by rank, std.file_id) n from std0 std join p0 on p0.file_id = std.file_id),
        t0 as ({item_rank}), t as (select std.file_id, std.item_id, rank, row_number() over (order by rank, std.file_id) n from std0 std join t0 on t0.item_id = std.item_id),
        k as (select file_id, item_id from p union select file_id, item_id from t)"""
    # ranks count the rows of the context, before the joins of the end
    ranked = ranked.replace(f"with {FILES}", f"with std0 as (select id file_id, item_id from files where item_id is not null), {FILES}")
    big = "9223372036854775805::double"
    add("search_rrf", {"query": {"or_": [{"match_path": {"match": "lantern"}, "order_by": True, "row_n": True, "direction": "desc", "select_as": "p", "rrf": {"k": 5, "weight": 1.0}}, {"match_text": {"match": "lantern"}, "order_by": True, "row_n": True, "direction": "desc", "select_as": "t", "rrf": {"k": 60, "weight": 0.6}}]}, "order_by": [], "select": ["path"], "page_size": 40}, f"""
        {ranked} select k.file_id, k.item_id, std.path, p.n p, t.n t from k join std using (file_id) left join p on p.file_id = k.file_id left join t on t.file_id = k.file_id
        order by 1.0 / (5 + coalesce(p.n::double, {big})) * 1.0 + 1.0 / (60 + coalesce(t.n::double, {big})) * 0.6 desc, k.file_id limit 40""")
    add("search_coalesced", {"query": {"or_": [{"match_path": {"match": "lantern"}, "order_by": True, "priority": 100}, {"match_text": {"match": "lantern"}, "order_by": True, "priority": 100}]}, "order_by": [{"order_by": "size", "order": "desc", "priority": 200}], "select": ["size"], "page_size": 60}, f"""
        {ranked} select k.file_id, k.item_id, std.size from k join std using (file_id) left join p on p.file_id = k.file_id left join t on t.file_id = k.file_id
        order by std.size desc nulls last, least(coalesce(p.rank, {big}), coalesce(t.rank, {big})), k.file_id limit 60""")
    add("search_cursor", {"query": {"match_path": {"match": "lantern"}, "row_n": True, "order_by": True, "gt": 10, "lt": 40, "select_as": "n"}, "select": [], "page_size": ALL}, f"{ranked} select p.file_id, p.item_id, p.n from p join std using (file_id) where n > 10 and n < 40")
    out["search_cursor_count"] = (lambda spark, d: counted(catalog(spark, d), {"query": {"match_path": {"match": "lantern"}, "gt": -1.0}})), f"{ranked} select count(*) total from p join std using (file_id)"
    add("ranked_and", {"query": {"and_": [{"match": {"startswith": {"type": "image/"}}}, {"match_path": {"match": "lantern"}, "row_n": True, "order_by": True, "select_as": "n"}]}, "select": [], "page_size": ALL}, f"""
        with {FILES}, p0 as ({path_rank}) select std.file_id, std.item_id, row_number() over (order by rank, std.file_id) n from std join p0 using (file_id) where type like 'image/%'""")

    add("ranked_branch", {"query": {"or_": [{"and_": [{"match_path": {"match": "lantern"}, "row_n": True, "order_by": True, "select_as": "n"}, {"match": {"startswith": {"type": "image/"}}}]}, {"match": {"gt": {"size": 100000}}}]}, "select": [], "page_size": ALL}, f"""
        {ranked} select std.file_id, std.item_id, p.n from std left join p on p.file_id = std.file_id where (p.n is not null and type like 'image/%') or size > 100000""")
    add("ranked_then_narrowed", {"query": {"and_": [{"match_path": {"match": "lantern"}, "row_n": True, "order_by": True, "select_as": "n"}, {"or_": [{"match_tags": {"tags": ["photo"]}, "select_as": "conf"}, {"match": {"startswith": {"type": "image/"}}}]}]}, "select": [], "page_size": ALL}, f"""
        {ranked}, h as ({tagged} t.name = 'photo' group by 1) select std.file_id, std.item_id, p.n, round(h.conf, 6) conf from p join std on std.file_id = p.file_id left join h on h.item_id = std.item_id where h.item_id is not null or type like 'image/%'""", ["conf"])

    def sorted_set(spark, d):
        df, _ = item_set(catalog(spark, d), {"query": {"match": {"startswith": {"type": "image/"}}}, "order_by": [{"order_by": "size"}]})
        return df

    out["item_set"] = sorted_set, f"with {FILES} select file_id, item_id, size sort_key from std where type like 'image/%'"
    out["annotated"] = (lambda spark, d: annotate(search(c := catalog(spark, d), {"select": ["sha256"], "page_size": ALL}), c, "click").select("file_id", "bookmarked")), f"""
        with {marks}, {FILES} select file_id, case when sha256 is not null then sha256 in (select sha256 from bookmarks where usr in ('user', '*') and namespace = 'click') end bookmarked from std"""
    have = "available and path is not null"
    out["checked_paths"] = (lambda spark, d: existing_paths(search(c := catalog(spark, d), {"select": ["path"], "page_size": ALL}), c, c["files"].where("available").select("path").distinct(), replace=True).select("file_id", "path")), f"""
        with {FILES}, e as (select distinct path from files where {have}), o as (select item_id, arg_min(path, (case when available then 0 else 1 end) * 1000000000 + id) other from files where item_id is not null and path in (select path from e) group by 1)
        select file_id, case when std.path in (select path from e) then std.path else other end path from std left join o using (item_id) where std.path in (select path from e) or other is not null"""
    out["outro_hidden"] = (lambda spark, d: without_outro(search(catalog(spark, d), {"select": ["outro_kind", "content_end_ms"], "page_size": ALL})).select("file_id", "outro_kind", "content_end_ms")), f"with {FILES} select file_id, null::varchar outro_kind, null::bigint content_end_ms from std"

    # vectors
    def near(metric, model, q, agg="min", where="true", extra=""):
        return f"""select d.item_id, {agg}(d.dist) dist from (select d.item_id, {_distance(metric, 'v.embedding', _literal(q))} dist from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id {extra}
            where s.name {model} and len(v.embedding) = {len(q)} and list_aggregate(list_transform(v.embedding, lambda x: isnan(x)::int), 'max') = 0 and {where}) d group by 1"""

    by_item = f"with {TEXTS}, {FILES}, h as ({{}}) select file_id, std.item_id, round(dist, 6) dist from std join h on h.item_id = std.item_id join (select distinct d.item_id from item_data d join vector_fixtures v on v.id = d.id where v.embedding is not null) z on z.item_id = std.item_id where dist is not null"
    nonnull = "dist is not null"

    def add_vector(name, query, sql, **more):
        add(name, query, sql, ["dist"], **more)
        run = out[name][0]
        # vectors that can't be compared have no distance; the comparison is of those that have
        out[name] = (lambda spark, d: run(spark, d).where(nonnull)), sql

    add_vector("text_embeddings", {"query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL, "index": "exact"}, "select_as": "dist"}, "select": [], "page_size": ALL}, by_item.format(near("L2", f"= '{TEXT_MODEL}'", QUERY128)))
    add_vector("text_embeddings_max", {"query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL, "distance_aggregation": "MAX", "src_text": {"languages": ["en", "de"], "min_confidence": 0.5}}, "select_as": "dist"}, "select": [], "page_size": ALL},
               by_item.format(near("L2", f"= '{TEXT_MODEL}'", QUERY128, "max", "e.language in ('en', 'de') and e.confidence >= 0.5", "join et e on e.id = d.source_id")))
    weights = f"""select item_id, sum(dist * w) / sum(w) dist from (select d.item_id, {_distance('L2', 'v.embedding', _literal(QUERY128))} dist, pow(coalesce(e.confidence, 1), 2.0) * pow(coalesce(e.language_confidence, 1), 0.5) w
        from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id join et e on e.id = d.source_id
        where s.name = '{TEXT_MODEL}' and len(v.embedding) = 128 and list_aggregate(list_transform(v.embedding, lambda x: isnan(x)::int), 'max') = 0) group by 1"""
    add_vector("text_embeddings_weighted", {"query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL, "src_text": {"confidence_weight": 2, "language_confidence_weight": 0.5}}, "select_as": "dist"}, "select": [], "page_size": ALL}, by_item.format(weights))
    add_vector("text_embeddings_texts", {"entity": "text", "query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL}, "select_as": "dist"}, "select": [], "page_size": ALL}, f"""
        with {TEXT_ROWS}, h as (select d.source_id, min({_distance('L2', 'v.embedding', _literal(QUERY128))}) dist from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id
          where s.name = '{TEXT_MODEL}' and len(v.embedding) = 128 and list_aggregate(list_transform(v.embedding, lambda x: isnan(x)::int), 'max') = 0 group by 1)
        select file_id, item_id, data_id, round(dist, 6) dist from std join h on h.source_id = std.data_id""")
    zero = "list_aggregate(list_transform(v.embedding, lambda x: abs(x)), 'max') > 0"
    add_vector("image_embeddings", {"query": {"image_embeddings": {"query": QUERY96, "model": IMAGE, "distance_aggregation": "AVG"}, "select_as": "dist"}, "select": [], "page_size": ALL}, by_item.format(near("cosine", f"= '{IMAGE}'", QUERY96, "avg", zero)))
    add_vector("image_embeddings_xmodal", {"query": {"image_embeddings": {"query": QUERY96, "model": IMAGE, "clip_xmodal": True, "src_text": {"min_confidence": 0.5}}, "select_as": "dist"}, "select": [], "page_size": ALL},
               by_item.format(near("cosine", f"in ('{IMAGE}', 't{IMAGE}')", QUERY96, "min", f"{zero} and (src.id is null or e.confidence >= 0.5)", "left join (select d.id from item_data d join et on et.id = d.id) src on src.id = d.source_id left join et e on e.id = d.source_id")))
    out["text_embeddings_count"] = (lambda spark, d: counted(catalog(spark, d), {"query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL}}})), f"""
        with {FILES} select count(*) total from std where item_id in (select d.item_id from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id where s.name = '{TEXT_MODEL}')"""

    def similar(name, args, sql_metric, agg, condition="true", weight=None):
        def run(spark, d):
            c, target = _target(spark, d)
            df = search(c, {"query": {"similar_to": {"target": target, "model": IMAGE, "index": "exact", **args}, "select_as": "dist"}, "select": [], "page_size": ALL})
            return df.withColumn("dist", F.round("dist", 6)).where(nonnull)

        usable = zero if sql_metric == "cosine" else "true"
        models = f"in ('{IMAGE}', 't{IMAGE}')" if args.get("clip_xmodal") else f"= '{IMAGE}'"
        value = f"{agg}(dist)" if weight is None else f"sum(dist * {weight}) / sum({weight})"
        out[name] = run, f"""
            with {TEXTS}, {FILES}, {TARGET}, v as (select d.item_id, d.data_type, v.embedding, {"e.confidence" if weight else "null"} c from item_data d join setters s on s.id = d.setter_id join vector_fixtures v on v.id = d.id {"left join et e on e.id = d.source_id" if weight else ""}
              where s.name {models} and len(v.embedding) = 96 and list_aggregate(list_transform(v.embedding, lambda x: isnan(x)::int), 'max') = 0 and {usable}),
            pairs as (select o.item_id, {_distance(sql_metric, 'm.embedding', 'o.embedding')} dist, o.c oc, m.c mc from v o, v m where m.item_id = (select id from tgt) and o.item_id <> (select id from tgt) and {condition}),
            h as (select item_id, {value} dist from pairs group by 1)
            select file_id, std.item_id, round(dist, 6) dist from std join h on h.item_id = std.item_id"""

    similar("similar_to_l2", {}, "L2", "avg")
    similar("similar_to_cosine", {"distance_function": "cosine", "distance_aggregation": "MIN"}, "cosine", "min")
    similar("similar_to_xmodal", {"clip_xmodal": True, "distance_aggregation": "MAX", "xmodal_i2i": False}, "L2", "max", "not (m.data_type = 'clip' and o.data_type = 'clip')")
    similar("similar_to_t2t_off", {"clip_xmodal": True, "xmodal_t2t": False}, "L2", "avg", "not (m.data_type = 'text-embedding' and o.data_type = 'text-embedding')")
    similar("similar_to_weighted", {"clip_xmodal": True, "src_text": {"confidence_weight": 1.5}}, "L2", "avg", "true", "pow(coalesce(oc, 1) * coalesce(mc, 1), 1.5)")

    # int8 index
    usual = """vr as (select v.id, s.name setter, d.data_type, len(v.embedding) dim, v.embedding from vector_fixtures v join item_data d on d.id = v.id and d.data_type in ('clip', 'text-embedding') join setters s on s.id = d.setter_id where v.embedding is not null),
        cn as (select setter, data_type, dim, count(*) n from vr group by all), us as (select setter, data_type, arg_max(dim, n * 100000 + dim) dim, sum(n)::bigint vectors from cn group by all),
        sp as (select u.setter, case when u.data_type = 'text-embedding' and i.dim = u.dim then i.setter else u.setter end space, u.data_type, u.dim, u.vectors from us u left join us i on i.data_type = 'clip' and 't' || i.setter = u.setter)"""
    out["quant_spaces"] = (lambda spark, d: quants.spaces(catalog(spark, d))), f"with {usual} select * from sp"
    scale = """sc as (select space, max(list_aggregate(list_transform(list_filter(embedding, lambda x: not isnan(x)), lambda x: abs(x)), 'max')) absmax, count(*) vectors from vr join sp using (setter) where vr.dim = sp.dim group by 1)"""
    out["quant_scales"] = (lambda spark, d: quants.scales(catalog(spark, d)).withColumn("absmax", F.round(F.col("absmax").cast("double"), 6))), f"with {usual}, {scale} select space, round(absmax::double, 6) absmax, vectors from sc"
    codes = f"""with {usual}, {scale} select vr.id, vr.setter, list_transform(vr.embedding, lambda x: case when isnan(x) then 0 else greatest(least(round_even((x::float / (absmax::float / 127::float)::float)::double, 0), 127), -128) end::tinyint) quant
        from vr join sp on sp.setter = vr.setter and sp.dim = vr.dim join sc on sc.space = sp.space"""
    out["quant_codes"] = (lambda spark, d: quants.encode(catalog(spark, d), least=1)[0].select("id", "setter", F.array_join(F.col("quant").cast("array<string>"), ",").alias("quant"))), f"select id, setter, array_to_string(quant, ',') quant from ({codes})"
    out["quant_coverage"] = (lambda spark, d: quants.coverage(_quantized(catalog(spark, d)))), f"""
        with {usual}, m as (select d.id, s.name setter from item_data d join setters s on s.id = d.setter_id where d.data_type in ('clip', 'text-embedding') and not coalesce(d.is_placeholder, false)),
        c as (select vr.id from vr join sp on sp.setter = vr.setter and sp.dim = vr.dim) select m.setter, count(*) vectors, count(c.id) coded from m left join c on c.id = m.id group by 1"""
    out["quant_finished"] = (lambda spark, d: quants.finished(_quantized(catalog(spark, d)), 1, 1, least=400)), f"""
        with {usual} select vr.setter, count(*) vectors, 0::bigint remaining, case when count(*) < 400 then 'pending' else 'ready' end state from vr join sp on sp.setter = vr.setter and sp.dim = vr.dim group by 1"""
    coded_query = f"list_transform({_literal(QUERY128)}, lambda x: greatest(least(round_even((x::float / (absmax::float / 127::float)::float)::double, 0), 127), -128))"
    add_vector("text_embeddings_quant", {"query": {"text_embeddings": {"query": QUERY128, "model": TEXT_MODEL, "index": "quant"}, "select_as": "dist"}, "select": [], "page_size": ALL}, f"""
        with {FILES}, {usual}, {scale}, q as ({codes.replace(f"with {usual}, {scale} ", "")}), qv as (select {coded_query} v from sc where space = '{TEXT_MODEL}'),
        h as (select d.item_id, min(list_distance(q.quant::double[], qv.v::double[])) dist from q join item_data d on d.id = q.id, qv where q.setter = '{TEXT_MODEL}' group by 1)
        select file_id, std.item_id, round(dist, 6) dist from std join h on h.item_id = std.item_id""", make=lambda spark, d: _quantized(catalog(spark, d)))
    return out
