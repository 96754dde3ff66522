"""Problem 6: texts put into containers of fixed capacity with little unused space.

Large-item matching: texts above a third of the capacity are paired greedily,
the largest with the largest that still fits beside it, at most two of them in
a container; smaller texts then go, longest first, where they leave the least
room (best fit decreasing). Sizes are whole numbers up to the capacity, so the
whole packing is decided on a histogram: at most one class per size, however
many texts there are. The histogram's plan says which ranks within a size go to
which containers, and every text finds its container from its rank alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.llm.tokens import TOKENIZER, count
from catalore.plans.runtime import cut_lineage

CAPACITY = 2000
#: Rows of the plan's side tables that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Buckets that a size class is ranked in, so that a size shared by many texts is no single task.
BUCKETS = 128


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((size, first rank, end rank, first container, items a container), ...) and the number of containers.

    ``sizes`` maps a size from 1 to ``capacity`` to its number of items.
    """
    left = {s: n for s, n in sizes.items() if n > 0}
    rows: list[tuple[int, int, int, int, int]] = []
    used = {s: 0 for s in left}
    bins = 0
    gaps: list[int] = []  # gaps that some containers have, sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # gap to (first container, containers)

    def add(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    def put(size: int, n: int, first: int, each: int) -> None:
        rows.append((size, used[size], used[size] + n, first, each))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            fits = bisect_left(large, min(s, capacity - s) + 1) - 1
            while fits >= 0 and not left[large[fits]]:
                fits -= 1
            t = large[fits] if fits >= 0 else None
            if t is None or t == s and left[s] == 1:
                # a lone one of its size may still pair with a smaller one
                lower = next((x for x in reversed(large[: max(fits, 0)]) if left[x]), None) if t == s else None
                n = left[s] if t is None else 1
                put(s, n, bins, 1)
                if lower is not None:
                    put(lower, n, bins, 1)
                add(capacity - s - (lower or 0), bins, n)
            elif t == s:
                n = left[s] // 2
                put(s, 2 * n, bins, 2)
                add(capacity - 2 * s, bins, n)
            else:
                n = min(left[s], left[t])
                put(s, n, bins, 1)
                put(t, n, bins, 1)
                add(capacity - s - t, bins, n)
            bins += n
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                each = capacity // s
                full, rest = divmod(left[s], each)
                if full:
                    put(s, full * each, bins, each)
                    add(capacity - each * s, bins, full)
                    bins += full
                if rest:
                    put(s, rest, bins, rest)
                    add(capacity - rest * s, bins, 1)
                    bins += 1
                continue
            gap = gaps[at]
            first, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = gap // s
            take = min(n, left[s] // each)
            if take:
                put(s, take * each, first, each)
                add(gap - each * s, first, take)
            if take < n and left[s] and left[s] < each:
                rest = left[s]
                put(s, rest, first + take, rest)
                add(gap - rest * s, first + take, 1)
                take += 1
            add(gap, first + take, n - take)
    return rows, bins


def items(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens): every text, those over the capacity in full pieces and a rest."""
    sized = documents.select("doc_id", count(F.col("text"), tokenizer).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / F.lit(capacity)) - 1, F.lit(0)).cast("long")
    cut = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("n_tokens"))


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container): every text's place.

    Null and empty texts take no room and lie in container 0; repeated rows are
    items of their own; no documents give no rows. Only a text over the
    capacity has several pieces.
    """
    spark = documents.sparkSession
    placed = items(documents, capacity, tokenizer).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    placed = cut_lineage(placed)
    # one row per size and bucket: at most capacity x BUCKETS
    classes = placed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = classes.select("n_tokens", "bucket", before.alias("before"))
    sizes = {r["n_tokens"]: r["n"] for r in classes.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan({s: n for s, n in sizes.items() if s > 0}, capacity)
    if sizes.get(0):
        rows.append((0, 0, sizes[0], 0, sizes[0]))
    where = spark.createDataFrame(rows, "n_tokens long, low long, high long, first long, each long")
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1
    # offsets have a row a size and bucket, the plan a few a size: both grow with the capacity, not with the texts
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    ranked = placed.withColumn("at", rank).join(small(offsets, BUCKETS * len(sizes)), ["n_tokens", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    found = ranked.join(small(where, len(rows)), "n_tokens").where("at >= low and at < high")
    return found.select("doc_id", "piece", "token_start", "n_tokens", (F.col("first") + F.floor((F.col("at") - F.col("low")) / F.col("each"))).cast("long").alias("container"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least, fill): how full the containers are; ``least`` no packing could undercut."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    totals = each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return totals.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"))


def p6_pack(documents: DataFrame) -> DataFrame:
    """Every text's container of 2,000 tokens."""
    return pack(documents)


def p6_fill(documents: DataFrame) -> DataFrame:
    """Containers used and their fill."""
    return fill(pack(documents))


def p6_bounds(documents: DataFrame) -> DataFrame:
    """(documents, over, split, lost): what must hold of every packing, counted over all texts.

    ``over`` counts containers beyond the capacity, ``split`` texts that would
    fit but have several pieces, ``lost`` pieces missing or out of place.
    """
    packed = cut_lineage(pack(documents))
    over = packed.where("container > 0 or n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > CAPACITY).agg(F.count(F.lit(1)).alias("over"))
    each = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    texts = each.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).cast("long")), F.lit(0)).alias("split"),
        F.coalesce(F.sum((F.col("n") != F.col("end")).cast("long")), F.lit(0)).alias("lost"),
    )
    return texts.crossJoin(F.broadcast(over)).select("documents", "over", "split", "lost")  # one row each
