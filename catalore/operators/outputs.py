"""What models return, turned into data rows: tags, texts, vectors, placeholders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.text import rounded
from catalore.functions.vectors import load_npy_rows


def mcut(scores: Column) -> Column:
    """The middle of the largest gap between sorted scores; a lone or gapless list gives its greatest score or first middle."""
    down = F.reverse(F.array_sort(scores))
    gaps = F.transform(F.slice(down, 1, F.greatest(F.size(down) - 1, F.lit(0))), lambda x, i: x - F.element_at(down, i + 2))
    at = F.array_position(gaps, F.array_max(gaps)).cast("int")
    return F.when(F.size(down) < 1, F.lit(0.0)).when(F.size(down) < 2, F.element_at(down, 1)).otherwise((F.element_at(down, at) + F.element_at(down, at + 1)) / 2)


def aggregate_tags(frames: DataFrame, severity: list[str]) -> DataFrame:
    """(item_id, namespace, name, confidence, at) of per-frame scores (item_id, frame, namespace, name, score).

    A tag's best score over the frames counts; namespaces keep the order in
    which they first appear, tags fall by score. In namespace ``rating`` each
    frame votes for its best label and the severest label stays, then the
    surest.
    """
    first = frames.groupBy("item_id", "namespace").agg(F.min("frame").alias("_first"))
    best = frames.where("namespace <> 'rating'").groupBy("item_id", "namespace", "name").agg(F.max("score").alias("confidence"))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(severity) for x in (s, i)]), "name"), F.lit(0)) if severity else F.lit(0)
    votes = frames.where("namespace = 'rating'").groupBy("item_id", "frame").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("v")).select("item_id", "v.name", "v.score")
    rating = votes.withColumn("_level", level).groupBy("item_id").agg(F.max_by(F.struct("name", "score"), F.struct("_level", "score")).alias("v"))
    rating = rating.select("item_id", F.lit("rating").alias("namespace"), F.concat(F.lit("rating:"), "v.name").alias("name"), F.col("v.score").alias("confidence"))
    order = Window.partitionBy("item_id").orderBy("_first", "namespace", F.desc("confidence"), "name")
    return best.unionByName(rating).join(first, ["item_id", "namespace"]).withColumn("at", F.row_number().over(order)).withColumn("confidence", rounded(F.col("confidence"))).drop("_first")


def tag_texts(tags: DataFrame, main: str, with_mcut: bool = True) -> DataFrame:
    """(item_id, idx, text, language, confidence): the tags as searchable texts, all and cut at the largest gap."""
    names = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda r: r["name"]), ", ")
    general = F.col("namespace") == "general"
    each = tags.groupBy("item_id").agg(
        F.collect_list(F.struct("at", "name", "confidence", general.alias("general"))).alias("all"),
        F.collect_list(F.when(general, F.col("confidence"))).alias("scores"),
        F.min("confidence").alias("least"),
    )
    whole = each.select("item_id", F.lit(0).alias("idx"), names(F.col("all")).alias("text"), F.lit(main).alias("language"), F.col("least").alias("confidence"))
    if not with_mcut:
        return whole
    cut = each.where(F.size("scores") > 0).withColumn("m", mcut(F.col("scores")))
    kept = F.filter("all", lambda r: ~r["general"] | (r["confidence"] >= F.col("m")))
    return whole.unionByName(cut.select("item_id", F.lit(1).alias("idx"), names(kept).alias("text"), F.lit(f"{main}-mcut").alias("language"), F.col("m").alias("confidence")))


def clean_texts(outputs: DataFrame) -> DataFrame:
    """Text outputs (item_id, idx, text, ...) trimmed; under 3 bytes dropped; of equal ones, case aside, the first kept."""
    trimmed = outputs.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where(F.octet_length("text") >= 3)
    first = Window.partitionBy("item_id", F.lower("text")).orderBy("idx")
    return trimmed.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")


def vector_outputs(outputs: DataFrame) -> DataFrame:
    """(item_id, source_id, idx, embedding): one row per vector in the NPY payloads of (item_id, source_id, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s, n, v) for i, s, p in zip(batch["item_id"], batch["source_id"], batch["payload"]) for n, v in enumerate(load_npy_rows(bytes(p)))]
            yield pd.DataFrame(rows, columns=["item_id", "source_id", "idx", "embedding"]).astype({"source_id": "Int64"})

    return outputs.select("item_id", "source_id", "payload").mapInPandas(run, "item_id long, source_id long, idx long, embedding array<float>")


def with_placeholders(made: DataFrame, processed: DataFrame) -> DataFrame:
    """Data rows (item_id, ...) plus a placeholder for every processed item that gave none."""
    empty = processed.select("item_id").distinct().join(made, "item_id", "left_anti").withColumn("is_placeholder", F.lit(True))
    return made.withColumn("is_placeholder", F.lit(False)).unionByName(empty, allowMissingColumns=True)


def item_data_rows(made: DataFrame, job_id: int, setter_id: int, data_type: str, first_id: int) -> DataFrame:
    """item_data rows of outputs (item_id, idx, source_id?): what has a source is no origin, else an origin.

    Ids follow (item_id, source_id, idx) from ``first_id``.
    """
    from catalore.plans.ranks import row_numbers

    source = F.col("source_id") if "source_id" in made.columns else F.lit(None).cast("long")
    rows = made.select(
        "item_id", F.lit(job_id).cast("long").alias("job_id"), F.lit(setter_id).cast("long").alias("setter_id"), F.lit(data_type).alias("data_type"),
        F.coalesce(F.col("idx"), F.lit(0)).cast("long").alias("idx"), source.alias("source_id"), F.when(source.isNull(), F.lit(True)).alias("is_origin"),
        (F.col("is_placeholder") if "is_placeholder" in made.columns else F.lit(False)).alias("is_placeholder"),
    )
    numbered = row_numbers(rows, [F.col("item_id"), F.col("source_id").asc_nulls_first(), F.col("idx")], "_n")
    return numbered.select((F.col("_n") + (first_id - 1)).alias("id"), *rows.columns)


def survivors(outputs: DataFrame) -> DataFrame:
    """Slots (item_id, slot, status) of items none of whose slots failed but for bad input; rejected inputs leave gaps.

    status is ok, input_error or error; any plain error makes the whole item transient.
    """
    bad = outputs.groupBy("item_id").agg(F.max((F.col("status") == "error").cast("int")).alias("_bad")).where("_bad = 0")
    return outputs.where("status = 'ok'").join(bad.select("item_id"), "item_id", "left_semi")


def chunk_tokens(tokens: list[int], size: int) -> list[list[int]]:
    """Runs of ``size`` tokens; a last one under a third is filled up from the one before."""
    runs = [tokens[i : i + size] for i in range(0, len(tokens), size)] or [[]]
    lack = size // 3 - len(runs[-1])
    if len(runs) > 1 and lack > 0:
        runs[-2:] = [runs[-2][:-lack], runs[-2][-lack:] + runs[-1]]
    return runs


def combined(vectors: list, at: int) -> list[list[float]]:
    """The chunks' vectors, with their mean appended from ``at`` chunks on; -1 never appends."""
    x = [list(map(float, v)) for v in vectors]
    return x + [np.mean(x, axis=0).tolist()] if at != -1 and len(x) >= at else x


def chunks(texts: DataFrame, size: int) -> DataFrame:
    """(source_id, chunk, tokens): the runs of ``chunk_tokens`` of every row of (source_id, tokens), by built-in functions.

    No tokens are one empty run, null ones none.
    """
    n = F.size("tokens")
    last = F.greatest(F.ceil(n / F.lit(size)).cast("int") - 1, F.lit(0))
    # how far the last run reaches back into the one before
    lack = F.when(last > 0, F.greatest(F.lit(size // 3) - (n - last * size), F.lit(0))).otherwise(F.lit(0))
    spans = texts.where("tokens is not null").select("source_id", "tokens", n.alias("_n"), last.alias("_last"), lack.alias("_lack"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    begin = F.col("chunk") * size - F.when(F.col("chunk") == F.col("_last"), F.col("_lack")).otherwise(0)
    end = F.when(F.col("chunk") == F.col("_last"), F.col("_n")).otherwise((F.col("chunk") + 1) * size - F.when(F.col("chunk") == F.col("_last") - 1, F.col("_lack")).otherwise(0))
    return spans.select("source_id", "chunk", F.slice("tokens", begin + 1, end - begin).alias("tokens"))


def combined_vectors(rows: DataFrame, at: int) -> DataFrame:
    """``rows`` (source_id, chunk, embedding) plus, from ``at`` chunks on, their mean as a last chunk; -1 adds none.

    Means combine map-side by place in the vector; vectors of one source have one length.
    """
    plain = rows.select("source_id", F.col("chunk").cast("int").alias("chunk"), F.col("embedding").cast("array<double>").alias("embedding"))
    if at == -1:
        return plain
    each = plain.select("source_id", F.posexplode("embedding").alias("place", "value")).groupBy("source_id", "place").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    means = each.where(F.col("n") >= at).groupBy("source_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    return plain.unionByName(means.select("source_id", F.col("n").cast("int").alias("chunk"), F.col("v.value").alias("embedding")))


@dataclass
class Extractor:
    """A model plug-in: what it reads, what it makes, and a function over batches of inputs."""

    input_type: str
    output_type: str
    predict: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str

    def run(self, inputs: DataFrame) -> DataFrame:
        """The outputs of all inputs, batch by batch on the executors."""
        predict = self.predict

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield predict(frame)

        return inputs.mapInPandas(batches, self.schema)
