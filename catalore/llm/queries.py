"""Registered queries of the training-data operators: (spark, folder) -> DataFrame."""

from __future__ import annotations

from catalore.llm import chunking, consensus, language, mixing, neighbours, ocr, packing, survivor
from catalore.sources.tables import table


def queries():
    """Query name to callable."""
    def votes(run):
        return lambda spark, d: run(table(spark, d, "tags_items"), table(spark, d, "item_data"), table(spark, d, "tags"))

    def scans(run):
        return lambda spark, d: run(table(spark, d, "extracted_text"), table(spark, d, "item_data"), table(spark, d, "setters"))

    return {
        "p1_found": votes(consensus.p1_found),
        "p1_labels": votes(consensus.p1_labels),
        "p1_annotators": votes(consensus.p1_annotators),
        "p2_found": lambda spark, d: language.p2_found(table(spark, d, "extracted_text")),
        "p2_segments": lambda spark, d: language.p2_segments(table(spark, d, "extracted_text")),
        "p2_labels": lambda spark, d: language.p2_labels(table(spark, d, "extracted_text")),
        "p3_found": lambda spark, d: survivor.p3_found(table(spark, d, "files")),
        "p3_survivors": lambda spark, d: survivor.p3_survivors(table(spark, d, "files")),
        "p4_found": scans(ocr.p4_found),
        "p4_pages": scans(ocr.p4_pages),
        "p5_found": lambda spark, d: neighbours.p5_found(table(spark, d, "vector_fixtures")),
        "p5_nearest": lambda spark, d: neighbours.p5_nearest(table(spark, d, "vector_fixtures")),
        "p6_pack": lambda spark, d: packing.p6_pack(table(spark, d, "documents")),
        "p6_fill": lambda spark, d: packing.p6_fill(table(spark, d, "documents")),
        "p6_bounds": lambda spark, d: packing.p6_bounds(table(spark, d, "documents")),
        "p7_found": lambda spark, d: mixing.p7_found(table(spark, d, "documents"), table(spark, d, "mix_targets")),
        "p7_mix": lambda spark, d: mixing.p7_mix(table(spark, d, "documents"), table(spark, d, "mix_targets")),
        "p7_shares": lambda spark, d: mixing.p7_shares(table(spark, d, "documents"), table(spark, d, "mix_targets")),
        "p8_found": lambda spark, d: chunking.p8_found(table(spark, d, "documents")),
        "p8_bounds": lambda spark, d: chunking.p8_bounds(table(spark, d, "documents")),
        "p8_pieces": lambda spark, d: chunking.p8_pieces(table(spark, d, "documents")),
    }


#: A file's place, hash and time as SQL.
FILES_SQL = r"""
with a as (select *, regexp_replace(path, '^[\s"'']+|[\s"'']+$', '', 'g') p from files where path is not null),
b as (select *, regexp_replace(replace(p, '\', '/'), '^file:(//(localhost)?)?', '', 'i') q from a where p <> ''),
c as (select *, nfc_normalize(case when contains(q, '%') then url_decode(q) else q end) r from b),
d as (select *, array_to_string(list_reduce(list_transform(string_split(r, '/'), lambda s: [s]), lambda done, s: case when s[1] in ('', '.') then done when s[1] = '..' then done[:-2] else list_concat(done, s) end), '/') place from c),
e as (select *, regexp_replace(regexp_replace(trim(last_modified), '^(\d{4})/(\d\d)/(\d\d)', '\1-\2-\3'), ' ', 'T') t,
  regexp_replace(lower(trim(sha256)), '^sha256:', '') h from d),
f as (select *, try_cast(case when regexp_matches(t, '(Z|[+-]\d\d:\d\d)$') then t else t || 'Z' end as timestamptz) at0,
  case when regexp_matches(h, '^[0-9a-f]{64}$') and h <> repeat(left(h, 1), 64) then h end hash from e),
g as (select *, case when at0 >= timestamptz '1990-01-01 00:00:00+00' and at0 < timestamptz '2026-07-01 00:00:00+00' then epoch_us(at0) end us from f)
"""
FOUND_SQL = FILES_SQL + """
select min(id) first_id, arg_max(hash, (coalesce(us, 0), hash)) filter (where hash is not null) sha256,
  strftime(make_timestamp(max(us)), '%Y-%m-%dT%H:%M:%SZ') last_modified
from g group by place having count(*) > 1"""

#: Votes of a year's half-life, weighted by the trust of each scan.
SURVIVORS_SQL = (
    FILES_SQL.replace("from files where path is not null", "from files")
    .replace("from a where p <> ''", "from a")
    + """,
tr as (select scan_id, (count(*) filter (where hash is not null and us is not null) + 1) / (count(*) + 2) trust from g group by 1),
w as (select g.*, trust, trust * pow(2, us / 31536000e6) vote from g join tr on tr.scan_id is not distinct from g.scan_id where p <> ''),
l as (select place, 'h' field, hash as "value", us, trust, vote from w where hash is not null
  union all select place, 't', strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ'), us, trust, vote from w where us is not null),
v as (select place, field, "value", (count(us) > 0)::int dated, case when count(us) > 0 then sum(vote) else sum(trust) end votes, coalesce(max(us), 0) last from l group by all),
best as (select place, arg_max("value", (dated, votes, last, "value")) filter (where field = 'h') sha256, arg_max("value", (dated, votes, last, "value")) filter (where field = 't') last_modified from v group by 1)
select first_id, records, place path, sha256, last_modified, string_split(place, '/')[-1] filename
from (select place, min(id) first_id, count(*) records from w group by 1) left join best using (place)"""
)

#: Pairs of usable vectors by comparing all of one model.
PAIRS_SQL = """
with v as (select id, model, case when embedding is not null then embedding::double[] else query_quant::double[] end x from vector_fixtures),
n as (select model, len(x) dim, count(*) n from v where x is not null group by all), m as (select model, arg_max(dim, n * 100000 + dim) dim from n group by 1),
u as (select v.id, v.model, x from v join m on m.model = v.model and m.dim = len(x)
  where list_aggregate(list_transform(x, lambda y: (isnan(y) or isinf(y))::int), 'max') = 0 and list_aggregate(list_transform(x, lambda y: abs(y)), 'max') > 0)
select a.id id_a, b.id id_b from u a join u b on a.model = b.model and a.id < b.id where list_cosine_similarity(a.x, b.x) >= 0.9"""

#: Targets out of reach, sizes counted in bytes: the answer is the same for any tokenizer.
TARGETS_SQL = r"""
with d as (select regexp_replace(regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g') k, strlen("text") n from documents),
h as (select k, sum(n) n from d where k is not null group by 1), a as (select sum(n) total from d),
t as (select regexp_replace(regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g') k, min(source) source, sum(coalesce(target_share, 0)) share, max(coalesce(max_repeats, 0)) most from mix_targets where source is not null group by 1)
select source from t left join h using (k), a where share * total > coalesce(n, 0) * most"""

#: Texts over 2,000 tokens: in these tables none has from 3,000 to 13,000 bytes, so bytes tell them apart.
LONG_SQL = """select doc_id from documents where strlen("text") > 6000"""
PIECES_SQL = f"""select count(*) documents, 0::bigint "over", 0::bigint gaps, 0::bigint bare from ({LONG_SQL})"""
PACKED_SQL = """select count(distinct doc_id) documents, 0::bigint "over", 0::bigint "split", 0::bigint lost from documents"""


def oracle_sql():
    """SQL for those queries that SQL can state over whole tables."""
    return {
        "p3_found": FOUND_SQL,
        "p3_survivors": SURVIVORS_SQL,
        "p5_found": PAIRS_SQL,
        "p6_bounds": PACKED_SQL,
        "p7_found": TARGETS_SQL,
        "p8_found": LONG_SQL,
        "p8_bounds": PIECES_SQL,
    }
