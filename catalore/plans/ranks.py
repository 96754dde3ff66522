"""Global row numbers without a single task, and merged orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from catalore.plans.runtime import cut_lineage

#: Stands for a missing rank.
BIG = 9223372036854775805


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with global 1-based row numbers in ``order``.

    Rows are range-partitioned by the order and kept, so that both passes below
    see the same ranges; each partition numbers its own rows from the count of
    those before it. Only the counts, one a partition, are broadcast. Finding
    the ranges and moving the rows would compute ``df`` twice, so it is held by
    the executors in between (a lost part is computed anew).
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = cut_lineage(held.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    held.unpersist()
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def directed(column: Column, direction: str) -> Column:
    """Order by a column, nulls last either way."""
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()


def merge(filters: list[dict], args: list[dict]) -> list[list[dict]]:
    """Order entries as groups in their final sequence.

    Higher priorities first, filters before plain columns, then as listed;
    neighbouring filters of one priority fuse into a group.
    """
    entries = [(-f["priority"], 0, i, f) for i, f in enumerate(filters)] + [(-a["priority"], 1, i, a) for i, a in enumerate(args)]
    groups: list[list[dict]] = []
    last = None
    for priority, kind, _, entry in sorted(entries, key=lambda e: e[:3]):
        if kind == 0 and last == (priority, 0):
            groups[-1].append(entry)
        else:
            groups.append([entry])
        last = (priority, kind)
    return groups


def fused(group: list[dict]) -> tuple[Column, str]:
    """(value, direction) of a group of filter ranks.

    With reciprocal rank fusion on its first filter: the weighted sum of
    1 / (k + rank); otherwise the best rank, a missing one counting as the worst.
    """
    direction = group[0]["direction"]
    if group[0].get("rrf"):
        total = F.lit(0.0)
        for g in group:
            rrf = g.get("rrf") or {"k": 1, "weight": 1.0}
            total = total + F.lit(1.0) / (F.lit(float(rrf["k"])) + F.coalesce(F.col(g["column"]).cast("double"), F.lit(float(BIG)))) * F.lit(float(rrf["weight"]))
        return total, direction
    if len(group) == 1:
        return F.col(group[0]["column"]), direction
    worst = float(BIG) if direction == "asc" else -float(BIG)
    ranks = [F.coalesce(_number(g), F.lit(worst)) for g in group]
    return (F.least(*ranks) if direction == "asc" else F.greatest(*ranks)), direction


def _number(entry: dict) -> Column:
    """A rank as a number; times count as seconds so that they can stand beside others."""
    column = F.col(entry["column"])
    return F.unix_timestamp(F.try_to_timestamp(column)).cast("double") if entry.get("time") else column.cast("double")
