"""Problem 7: records of several sources mixed to target shares of all tokens.

Time-varying curriculum: each source has a weight schedule over the training
run; its integral says how many of the source's tokens are due by any time, and
its inverse turns a document's place in its source's token sequence into a
training position. Documents are then range-sorted by position. A source short
of tokens is repeated, in a new order each time, up to its ``max_repeats``.

Running sums are taken in hash buckets whose totals are summed first, so no
source, however large, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.llm.tokens import TOKENIZER, count
from catalore.plans.runtime import cut_lineage

#: A source's repeat is summed up in 2^BUCKET_BITS buckets.
BUCKET_BITS = 10
#: The schedule of a source that has none of its own: the same weight throughout. Weights are relative, at even steps of the run.
FLAT = (1.0, 1.0)
#: The curriculum of ``p7_mix``: short captions and notes early, long and spoken texts late, manuals in the middle.
CURRICULUM = {
    "board_notes": (1.5, 0.5), "photo_captions": (1.5, 0.5), "film_stills": (1.5, 0.5), "image_prompts": (1.5, 0.5), "comic_bubbles": (1.5, 0.5),
    "lecture_transcripts": (0.5, 1.5), "podcast_transcripts": (0.5, 1.5), "oral_histories": (0.5, 1.5), "archive_letters": (0.5, 1.5),
    "user_manuals": (0.5, 1.5, 0.5),
}


def source_name(column: Column) -> Column:
    """A source's plain spelling: lower case, words joined by one ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[\s_\-]+", "_"), r"^_+|_+$", "")


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every row; the source in plain spelling or null."""
    return documents.select("doc_id", source_name(F.col("source")).alias("source"), count(F.col("text"), tokenizer).alias("n_tokens"))


def budget(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, target_share, max_repeats, available, total, need, goal) of each target.

    ``total`` is the size of all rows together, ``need`` the target's part of
    it, ``goal`` what the source can give of that. A null share or number of
    repeats counts as 0; sources listed twice add their shares.
    """
    # one row a source, counted once for the sources and for the whole
    each = cut_lineage(sizes.groupBy(F.col("source").alias("key")).agg(F.sum("n_tokens").alias("available")))
    total = each.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    own = each.where("key is not null")
    wanted = (
        targets.where("source is not null")
        .withColumn("key", source_name(F.col("source")))
        .groupBy("key")
        .agg(F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    )
    joined = wanted.join(own, "key", "left").crossJoin(F.broadcast(total)).withColumn("available", F.coalesce("available", F.lit(0)))
    need = F.col("target_share") * F.col("total")
    return joined.select("source", "key", "target_share", "max_repeats", "available", "total", need.alias("need"), F.least(need, F.col("available") * F.col("max_repeats").cast("double")).alias("goal"))


def segments(schedule) -> list[tuple[float, float, float, float, float, float]]:
    """(t0, t1, w0, w1, f0, f1) of a schedule's straight pieces, f its integral scaled to 1."""
    if len(schedule) < 2 or min(schedule) < 0 or not sum(schedule) > 0:
        raise ValueError(f"not a schedule: {schedule!r}")
    n = len(schedule) - 1
    areas = [(schedule[i] + schedule[i + 1]) / 2 / n for i in range(n)]
    whole, done, out = sum(areas), 0.0, []
    for i, area in enumerate(areas):
        last = 1.0 if i == n - 1 else (done + area) / whole
        out.append((i / n, (i + 1) / n, schedule[i] / whole, schedule[i + 1] / whole, done / whole, last))
        done += area
    return out


def mix(documents: DataFrame, targets: DataFrame, schedules: dict | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(position, doc_id, repeat, source, n_tokens) in training order, position from 0 to 1.

    Documents without tokens or of sources that are not wanted are not used. A
    document starts before its source's goal is reached, so a source may exceed
    it by less than one document. ``schedules`` maps a source to its weights
    (at least two, none negative, not all 0); others stay ``FLAT``.
    """
    return _mixed(cut_lineage(sized(documents, tokenizer)), targets, schedules)


def _mixed(sizes: DataFrame, targets: DataFrame, schedules: dict | None = None, plan: DataFrame | None = None) -> DataFrame:
    spark = sizes.sparkSession
    plan = (budget(sizes, targets) if plan is None else plan).where("goal > 0").orderBy("key").collect()  # one row per target
    wanted, pieces = [], []
    for r in plan:
        # a tiny allowance keeps a whole number of repeats whole
        repeats = min(int(r["max_repeats"]), int(-(-(r["goal"] - 1e-6) // r["available"])))
        wanted.append((r["key"], r["source"], float(r["goal"]), int(r["available"]), repeats))
        weights = (schedules or {}).get(r["source"], FLAT)
        pieces += [(r["key"], *x) for x in segments(weights)]
    goals = spark.createDataFrame(wanted, "source string, name string, goal double, available long, repeats int")
    lines = spark.createDataFrame(pieces, "source string, t0 double, t1 double, w0 double, w1 double, f0 double, f1 double")
    copies = (
        sizes.where("n_tokens > 0")
        .join(F.broadcast(goals), "source")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
        .withColumn("draw", F.xxhash64("doc_id", "repeat"))
        .withColumn("bucket", F.shiftrightunsigned("draw", 64 - BUCKET_BITS).cast("int"))
    )
    totals = copies.groupBy("source", "repeat", "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("source", "repeat").orderBy(F.col("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "repeat", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "repeat", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    running = copies.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = running.join(offsets, ["source", "repeat", "bucket"]).withColumn("begin", F.col("before") + F.col("own") + F.col("repeat") * F.col("available"))
    used = placed.where("begin < goal - 1e-6")
    share = F.least((F.col("begin") + F.col("n_tokens") / 2) / F.col("goal"), F.lit(1.0))
    timed = used.withColumn("u", share).join(F.broadcast(lines), "source").where("u > f0 and u <= f1")
    # the piece's integral w0 x + (w1 - w0) x^2 / (2 d) reaches u - f0 at x
    d, rise, due = F.col("t1") - F.col("t0"), F.col("w1") - F.col("w0"), F.col("u") - F.col("f0")
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * rise / d * due, F.lit(0.0)))
    x = 2 * due / (F.col("w0") + root)
    position = F.least(F.col("t0") + x, F.col("t1"))
    return timed.select(position.alias("position"), "doc_id", "repeat", F.col("name").alias("source"), "n_tokens").orderBy("position", "doc_id", "repeat")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, n_tokens, share, reached, most_repeats): what each target got.

    ``share`` is of the mix as it came out, ``reached`` of a mix as large as all
    documents; they differ where some target could not be reached.
    """
    sizes = cut_lineage(sized(documents, tokenizer))
    total = sizes.agg(F.sum("n_tokens").alias("total"))
    used = _mixed(sizes, targets).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    joined = wanted.join(used, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    whole = joined.agg(F.sum("n_tokens").alias("all"))
    joined = joined.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total))  # one row each
    return joined.select("source", "target_share", "n_tokens", F.try_divide(F.col("n_tokens"), F.col("all")).alias("share"), F.try_divide(F.col("n_tokens"), F.col("total")).alias("reached"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


def p7_found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that can't be reached even with all repeats in a mix as large as all documents.

    The mix is made; found is a target whose documents placed in the run hold
    fewer tokens than its part of all. What is reached may miss by the mix's
    own allowance of 1e-6 tokens.
    """
    sizes = cut_lineage(sized(documents))
    plan = cut_lineage(budget(sizes, targets))
    placed = _mixed(sizes, targets, plan=plan).where("position between 0 and 1").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    return plan.join(placed, "source", "left").where("need > coalesce(n_tokens, 0) + greatest(1e-9 * total, 2e-6)").select("source")


def p7_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix in training order, by ``CURRICULUM``."""
    return mix(documents, targets, CURRICULUM)


def p7_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached."""
    return shares(documents, targets)
