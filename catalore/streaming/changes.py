"""Changes of files as streams: events, settling, snapshot polling, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a file must rest, and the longest wait between looks.
SETTLE_S, BACKOFF_S = 2, 60


def events(raw: DataFrame) -> DataFrame:
    """(ts, path, change): create and modify as upsert, remove as remove, a rename as both, overflow as rescan."""
    pair = F.when(F.col("kind") == "rename", F.array(F.struct(F.col("old_path").alias("path"), F.lit("remove").alias("change")), F.struct(F.col("path"), F.lit("upsert").alias("change"))))
    single = F.array(F.struct(F.col("path"), F.when(F.col("kind").isin("create", "modify"), "upsert").when(F.col("kind") == "remove", "remove").when(F.col("kind") == "overflow", "rescan").alias("change")))
    return raw.select("ts", F.explode(F.coalesce(pair, single)).alias("e")).select("ts", "e.path", "e.change").where("change is not null")


def latest(changes: DataFrame) -> DataFrame:
    """One change per path of a batch: the last one."""
    return changes.groupBy("path").agg(F.max_by("change", F.struct("ts", "change")).alias("change"), F.max("ts").alias("ts"))


def settled(changes: DataFrame, settle_s: int = SETTLE_S) -> DataFrame:
    """Streaming: (path, change, ts) once a path has seen no change for ``settle_s`` seconds of event time.

    ``changes`` must carry a watermark on ts; each path keeps its last change
    and a timer, nothing else.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            change, ms = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "change": [change], "ts": [pd.Timestamp(ms, unit="ms")]})
            return
        change, ms = state.get if state.exists else (None, -1)
        for frame in frames:
            for c, t in zip(frame["change"], frame["ts"]):
                at = int(pd.Timestamp(t).timestamp() * 1000)
                if at >= ms:
                    change, ms = c, at
        state.update((change, ms))
        state.setTimeoutTimestamp(max(ms + settle_s * 1000, state.getCurrentWatermarkMs() + 1))

    return changes.groupBy("path").applyInPandasWithState(step, "path string, change string, ts timestamp", "change string, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def poll(before: DataFrame, now: DataFrame, failed_dirs: DataFrame | None = None) -> DataFrame:
    """(path, change) between two snapshots (path, dir, last_modified, size); nothing below a folder that failed is removed.

    A size not known before does not count as changed.
    """
    old = before.select("path", F.col("dir").alias("old_dir"), F.col("last_modified").alias("old_time"), F.col("size").alias("old_size"), F.lit(True).alias("_old"))
    joined = now.select("path", "last_modified", "size", F.lit(True).alias("_new")).join(old, "path", "full_outer")
    same = F.col("last_modified").eqNullSafe(F.col("old_time")) & (F.col("old_size").isNull() | F.col("old_size").eqNullSafe(F.col("size")))
    change = F.when(F.col("_new").isNull(), "remove").when(F.col("_old").isNull() | ~same, "upsert")
    out = joined.withColumn("change", change).where("change is not null")
    if failed_dirs is not None:
        parts = F.split("old_dir", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        lost = out.where("change = 'remove'").select("path", F.explode(above).alias("dir")).join(failed_dirs.select("dir"), "dir", "left_semi").select("path").distinct()
        out = out.join(lost, "path", "left_anti")
    return out.select("path", "change")


def settled_dirs(dirs: DataFrame, pass_start: int, settle_s: int = SETTLE_S) -> DataFrame:
    """(dir, dir_modified): folder times to remember; one that changed just now is looked at again."""
    return dirs.select("dir", F.when(F.col("dir_modified") + settle_s < pass_start, F.col("dir_modified")).alias("dir_modified"))


def backoff(looks: int, first: int = SETTLE_S, most: int = BACKOFF_S) -> int:
    """Seconds until the next look at a file that won't rest."""
    return min(most, first * 2 ** min(looks, 16))


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums per window, late rows within the watermark."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): counts per overlapping window."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upserting(target: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str):
    """A foreachBatch sink: each batch's last row per key replaces the target's; a replayed batch changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        write(target().join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True))

    return sink
