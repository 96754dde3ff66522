"""Tables that the test data lacks, derived from those it has; the same SQL on both sides."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalore.sources.catalog import SCHEMAS, Catalog
from catalore.sources.tables import table

SQL = {
    "bookmarks": """
        select case e.user_id % 4 when 0 then '*' when 1 then 'alice' else 'user' end as usr,
               case when e.event_id % 5 = 0 then concat(e.event_type, '.sub') else e.event_type end as namespace,
               i.sha256 as sha256, max(cast(e.ts as string)) as time_added, cast(null as string) as metadata
        from events e cross join (select count(*) as n from items) c join items i on i.id = 1 + e.event_id % c.n where i.sha256 is not null group by 1, 2, 3""",
    "pinboards": """
        select o_orderkey as id, case o_custkey % 3 when 0 then 'alice' else 'user' end as usr,
               concat('Board ', o_orderpriority, ' ', cast(o_orderkey % 17 as string)) as name, o_orderkey * 10 + 1 as head_version_id,
               cast(o_orderdate as string) as time_added, cast(o_orderdate as string) as time_updated, cast(null as string) as flags,
               cast(1700000000 + (o_orderkey * 7919) % 1000000 as bigint) as last_seen, cast((o_orderkey % 7) * 0.5 as double) as frecency,
               cast(1700000000 + (o_orderkey * 104729) % 1000000 as bigint) as frecency_at
        from orders""",
    "pinboard_versions": """
        select o_orderkey * 10 + 1 as id, o_orderkey as pinboard_id, cast(o_orderdate as string) as time_added from orders
        union all select o_orderkey * 10 as id, o_orderkey as pinboard_id, cast(o_orderdate as string) as time_added from orders""",
    "pinboard_version_items": """
        select distinct l.l_orderkey * 10 + case when l.l_linenumber % 3 = 0 then 0 else 1 end as version_id,
               coalesce(i.sha256, concat('absent-', cast(l.l_partkey as string))) as sha256
        from lineitem l cross join (select count(*) as n from items) c left join items i on i.id = 1 + l.l_partkey % c.n""",
    "pinboard_databases": """
        select o_orderkey as pinboard_id, concat('uuid-', cast(o_custkey % 5 as string)) as db_uuid, case o_custkey % 2 when 0 then 'main' else 'other' end as db_name,
               concat('instance-', cast(o_orderkey % 3 as string)) as instance_uuid, cast(0 as bigint) as last_stamped
        from orders""",
    "item_extraction_errors": """
        select max(e.event_id) as id, 1 + e.event_id % c.n as item_id, 1 + e.user_id % 21 as setter_id, max(e.event_type) as stage,
               case max(e.event_id) % 3 when 0 then 'decode' when 1 then 'input' else 'model' end as error_class, cast(null as string) as blocker,
               max(i.type) as mime_type, 'failed' as error, cast(2 as bigint) as skip_after, 1 + max(e.event_id) % 4 as attempts,
               max(e.event_id) % 50 as last_job_id, min(cast(e.ts as string)) as first_seen, max(cast(e.ts as string)) as last_seen
        from events e cross join (select count(*) as n from items) c left join items i on i.id = 1 + e.event_id % c.n group by 1 + e.event_id % c.n, 1 + e.user_id % 21""",
    "scan_errors": """
        select max(id) as id, path, max(last_modified) as last_modified, max(id) % 100 as file_size, case max(id) % 3 when 0 then 'decode' when 1 then 'hash' else 'stat' end as stage,
               case max(id) % 2 when 0 then 'corrupt' else 'denied' end as error_class, cast(null as string) as blocker, 'image/png' as mime_type, 'failed' as error,
               cast(2 as bigint) as skip_after, 1 + max(id) % 4 as attempts, max(scan_id) as last_scan_id, min(last_modified) as first_seen, max(last_modified) as last_seen
        from files group by path""",
    "folders": """
        select cast(1 as bigint) as id, '2026-01-01' as time_added, '/library/vol1' as path, true as included
        union all select cast(2 as bigint), '2026-01-01', '/library/Vault/', true union all select cast(3 as bigint), '2026-01-01', '/library/vol1/tapes', false""",
    "data_jobs": """
        select distinct job_id as id, cast(case when job_id % 7 = 0 then 0 when job_id % 5 = 0 then -1 else 1 end as int) as completed from item_data where job_id is not null""",
    "data_log": """
        select distinct job_id as id, case when job_id % 11 = 0 then null else job_id end as job_id, concat('2026-01-', cast(10 + job_id % 20 as string)) as start_time,
               'tags' as type, 'tagger/merlo' as setter, job_id % 7 <> 0 as completed
        from item_data where job_id is not null""",
    "file_scans": """
        select distinct scan_id as id, concat('2026-02-', cast(10 + scan_id % 15 as string)) as start_time, '/library' as path, scan_id * 3 as total_available from files where scan_id is not null""",
}
_USES = {
    "bookmarks": ["events", "items"], "pinboards": ["orders"], "pinboard_versions": ["orders"], "pinboard_version_items": ["lineitem", "items"], "pinboard_databases": ["orders"],
    "item_extraction_errors": ["events", "items"], "scan_errors": ["files"], "folders": [], "data_jobs": ["item_data"], "data_log": ["item_data"], "file_scans": ["files"],
}


#: Tables that a test folder neither holds nor derives.
ABSENT = ("embedding_quants", "vector_quant_profiles", "vector_quant_coverage", "visual_attempts")


def _derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # names stand in braces for DataFrames
    text = SQL[name]
    for used in _USES[name]:
        text = text.replace(f"from {used}", f"from {{{used}}}").replace(f"join {used}", f"join {{{used}}}")
    df = spark.sql(text, **{used: table(spark, folder, used) for used in _USES[name]}).withColumnRenamed("usr", "user")
    rest = [c.split() for c in SCHEMAS[name].split(", ") if c.split()[0] not in df.columns]
    return df.select("*", *[F.lit(None).cast(kind).alias(column) for column, kind in rest])


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """The catalogue of a test folder, missing tables derived when they are asked for."""
    return Catalog(spark, folder, {name: partial(_derived, spark, folder, name) for name in SQL}, ABSENT)


def with_sql(*names: str) -> str:
    """The derivations as the start of a WITH clause."""
    return ", ".join(f"{n} as ({SQL[n]})" for n in names)
