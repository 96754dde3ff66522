"""Problem 5: the most similar vectors of every vector.

Vantage-point trees per shard, pruned by the triangle inequality with a search
radius divided by ``factor`` (1 restores exact search). A small routing tree per
model, fitted on a bounded sample (``SAMPLE_ROWS``), places every vector in one
shard and sends it as a query to each shard its relaxed ball touches; each shard
then builds a tree of its own over all its vectors. Work per vector therefore
follows the depth of the trees, not the number of vectors.

Exact copies are one class: the class is indexed once, and copies come back
through the membership table, so a group of copies of any size never meets in
one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.llm.vptree import Tree, chord
from catalore.plans.runtime import cut_lineage

#: Rows per model that the routing tree is fitted on, in expectation; more where more shards are wanted, up to MOST_ROWS.
SAMPLE_ROWS, MOST_ROWS = 4096, 65_536
#: Sample rows that a shard stands on at least.
ROWS_A_SHARD = 8
#: Rows a shard should hold; one that the sample says will hold over twice as many is split into blocks.
SHARD_ROWS = 6000
#: The table of copies is broadcast up to this size, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20


def _unit(dims):
    """Arrow batches of (id, model, vec, code) to those of usable rows with unit float32 bytes."""

    def rows(column, size, out, at):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.diff(lists.offsets.to_numpy())
        valid = ~np.asarray(lists.is_null()) & (lengths == size)
        take = np.flatnonzero(valid & at)
        if len(take):
            flat = lists.take(pa.array(take)).flatten()
            out[take] = flat.to_numpy(zero_copy_only=False).reshape(len(take), size)
        return valid

    def run(batches):
        for batch in batches:
            ids, models = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1).to_pylist(), dtype=object)
            absent = np.asarray(batch.column(2).is_null())
            for model, size in dims.items():
                own = models == model
                if not own.any():
                    continue
                x = np.full((len(ids), size), np.nan)
                rows(batch.column(2), size, x, own & ~absent)
                rows(batch.column(3), size, x, own & absent)
                norm = np.sqrt((x * x).sum(1))
                good = np.flatnonzero(own & np.isfinite(norm) & (norm > 0))
                unit = np.ascontiguousarray((x[good] / norm[good, None]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[good], pa.int64()), pa.array([model] * len(good), pa.string()), pa.array([u.tobytes() for u in unit], pa.binary())],
                    ["id", "model", "vec"],
                )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(id, model, vec) of the usable rows, vec the bytes of the unit vector.

    The embedding counts where it is not null, else the int8 form. Usable means
    of the model's usual dimension, finite throughout and not zero; a row with
    a null id or model is not.
    """
    source = vectors.where(F.col("id").isNotNull() & F.col("model").isNotNull())
    sizes = source.groupBy("model", F.size(F.coalesce(F.transform("embedding", lambda x: F.lit(1)), F.transform("query_quant", lambda x: F.lit(1)))).alias("size")).count()
    dims: dict[str, int] = {}
    for r in sorted(sizes.where("size > 0").collect(), key=lambda r: (r["count"], r["size"])):
        dims[r["model"]] = r["size"]
    plain = source.select(F.col("id").cast("long"), "model", F.col("embedding").cast("array<double>"), F.col("query_quant").cast("array<double>"))
    return plain.mapInArrow(_unit(dims), "id long, model string, vec binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), -1) if values else np.zeros((0, 1), np.float32)


def _once(table: pa.Table) -> pa.Table:
    """One row of each class; rows of an id recorded twice meet in their shard."""
    reps = table.column("rep").to_numpy()
    _, first = np.unique(reps, return_index=True)
    return table if len(first) == len(reps) else table.take(pa.array(np.sort(first)))


class Index:
    """Classes of equal vectors, their members, and a routing tree per model."""

    def __init__(self, vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS):
        self.spark = vectors.sparkSession
        self.rows = cut_lineage(usable(vectors).withColumn("key", F.unhex(F.md5("vec"))))
        repeated = self.rows.groupBy("model", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        # members of classes of several rows; a small table where copies are few
        self.members = cut_lineage(self.rows.select("model", "key", "id").join(repeated, ["model", "key"]).select("model", "rep", "id").distinct())
        others = self.members.where("id <> rep").select("model", "id")
        if self.members.count() * 64 <= BROADCAST_BYTES:
            others = F.broadcast(others)
        self.classes = self.rows.join(others, ["model", "id"], "left_anti").select("model", F.col("id").alias("rep"), "vec")
        counts = {r["model"]: r["count"] for r in self.rows.groupBy("model").count().collect()}
        share = F.lit(0.0)
        for model, n in counts.items():
            share = F.when(F.col("model") == model, F.lit(min(1.0, min(max(sample_rows, ROWS_A_SHARD * n // shard_rows), most_rows) / n))).otherwise(share)
        draw = F.pmod(F.xxhash64(F.lit("routing"), "id"), F.lit(1 << 30)) < share * float(1 << 30)
        picked: dict[str, list] = {}
        for r in self.rows.where(draw).select("model", "id", "vec").orderBy("model", "id").collect():
            picked.setdefault(r["model"], []).append(bytes(r["vec"]))
        self.samples = {m: np.frombuffer(b"".join(v), dtype=np.float32).reshape(len(v), -1) for m, v in picked.items()}
        self.routes, self.blocks = {}, {}
        for model, sample in self.samples.items():
            distinct = np.unique(sample, axis=0)
            n = max(counts[model], 1)
            tree = self.routes[model] = Tree(distinct, leaf=max(ROWS_A_SHARD, int(len(distinct) * shard_rows / n)))
            expected = np.asarray([len(leaf) for leaf in tree.leaves]) * (n / len(distinct))
            self.blocks[model] = np.maximum(np.ceil(expected / (2 * shard_rows)), 1).astype(np.int64)
            self.samples[model] = sample[:sample_rows]  # in the order of the ids, which say nothing about vectors

    def _routed(self, source: DataFrame, reach_of, query) -> DataFrame:
        """Rows sent to shards: once as member, and as query wherever the ball reaches."""
        routes = self.spark.sparkContext.broadcast((self.routes, self.blocks, self.samples if reach_of == "nearest" else {}))
        k, value = query

        def send(batches):
            trees, blocks, samples = routes.value
            for batch in batches:
                models = np.asarray(batch.column(1).to_pylist(), dtype=object)
                for model in set(models.tolist()):
                    own = np.flatnonzero(models == model)
                    part = batch.take(pa.array(own))
                    asks = np.asarray(part.column(3).to_pylist(), dtype=bool)
                    x = _matrix(part.column(2))
                    tree = trees.get(model)
                    if tree is None:
                        # no row of this model fell into the sample: one shard
                        at, shard, member, query = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool), asks
                    else:
                        split = blocks[model]
                        first = np.cumsum(split) - split
                        leaf = tree.place(x)
                        draw = part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                        home = first[leaf] + (draw % split[leaf].astype(np.uint64)).astype(np.int64)
                        rows = np.flatnonzero(asks)
                        reach = value
                        if reach_of == "nearest":
                            s = np.sort(x[rows] @ samples[model].T, axis=1)
                            reach = chord(s[:, -(k + 1)] if s.shape[1] > k else np.full(len(rows), -1.0)) / value
                        # a query goes to every block of every leaf it reaches
                        goes = [(np.repeat(rows[r], split[to]), np.tile(first[to] + np.arange(split[to]), len(r))) for r, to in tree.visits(x[rows], reach)] if len(rows) else []
                        q_at = np.concatenate([g[0] for g in goes]) if goes else np.zeros(0, np.int64)
                        q_to = np.concatenate([g[1] for g in goes]) if goes else np.zeros(0, np.int64)
                        away = q_to != home[q_at]
                        at = np.concatenate([np.arange(len(x)), q_at[away]])
                        shard = np.concatenate([home, q_to[away]])
                        member = np.arange(len(at)) < len(x)
                        query = np.concatenate([asks, np.ones(away.sum(), bool)])
                    sent = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard, pa.int64()), sent.column(1), sent.column(0), sent.column(2), pa.array(member), pa.array(query)],
                        ["shard", "model", "rep", "vec", "member", "query"],
                    )

        return source.mapInArrow(send, "shard long, model string, rep long, vec binary, member boolean, query boolean")

    def similar(self, cosine: float = 0.9, factor: float = 6.0) -> DataFrame:
        """(model, rep_a, rep_b, cosine) of the class pairs of at least ``cosine``, rep_a < rep_b.

        A pair is found if either of its vectors reaches the other, so the
        relaxed pruning has two chances.
        """
        asks = self.classes.select("rep", "model", "vec", F.lit(True).alias("asks"))

        def search(table: pa.Table) -> pa.Table:
            table = _once(table)
            member = np.asarray(table.column("member").combine_chunks())
            x, reps = _matrix(table.column("vec")), table.column("rep").to_numpy()
            points, names = x[member], reps[member]
            if len(points):
                q, p, s = Tree(points).within(points, x, cosine, factor)
            else:
                q, p, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            a, b = reps[q], names[p] if len(p) else np.zeros(0, np.int64)
            keep = a != b
            lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            _, first = np.unique(np.stack([lo, hi], 1), axis=0, return_index=True) if len(lo) else (0, np.zeros(0, int))
            model = table.column("model")[0].as_py() if table.num_rows else None
            return pa.table({"model": pa.array([model] * len(first), pa.string()), "rep_a": pa.array(lo[first], pa.int64()), "rep_b": pa.array(hi[first], pa.int64()), "cosine": pa.array(s[keep][first], pa.float64())})

        found = self._routed(asks, "radius", (0, float(chord(cosine)) / factor)).groupBy("model", "shard").applyInArrow(search, "model string, rep_a long, rep_b long, cosine double")
        return found.groupBy("model", "rep_a", "rep_b").agg(F.max("cosine").alias("cosine"))

    def pairs(self, cosine: float = 0.9, factor: float = 6.0) -> DataFrame:
        """(id_a, id_b) of all row pairs of at least ``cosine``, id_a < id_b, each once.

        All pairs of rows are what is asked for here, so copies are expanded;
        where a vector may have many copies, take ``similar`` and ``members``,
        which hold each class once.
        """
        a = self.members.select("model", F.col("rep").alias("rep_a"), F.col("id").alias("of_a"))
        b = self.members.select("model", F.col("rep").alias("rep_b"), F.col("id").alias("of_b"))
        across = (
            self.similar(cosine, factor)
            .join(a, ["model", "rep_a"], "left")
            .join(b, ["model", "rep_b"], "left")
            .select(F.coalesce("of_a", "rep_a").alias("x"), F.coalesce("of_b", "rep_b").alias("y"))
        )
        inside = self.members.alias("m").join(self.members.alias("n"), ["model", "rep"]).where("m.id < n.id").select(F.col("m.id").alias("x"), F.col("n.id").alias("y"))
        both = across.unionByName(inside).where("x <> y")
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def nearest(self, queries, k: int = 10, factor: float = 2.5) -> DataFrame:
        """(id, rank, neighbour, cosine, copies): the k most similar classes of each query row.

        ``queries`` is a condition on ``id``. A neighbour is named by its
        smallest id; ``copies`` is the number of rows of the class other than
        the query itself, so a query's own class counts only if it has more
        rows. Ties go to the smaller id.
        """
        rep_of = self.members.select("model", "id", "rep")
        asked = self.rows.where(queries).select("model", "id").join(rep_of, ["model", "id"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "model").distinct()
        wanted = asked.select("rep", "model").distinct().withColumn("asks", F.lit(True))
        source = self.classes.join(F.broadcast(wanted) if wanted.count() * 64 <= BROADCAST_BYTES else wanted, ["rep", "model"], "left").select("rep", "model", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))

        def search(table: pa.Table) -> pa.Table:
            table = _once(table)
            member, query = np.asarray(table.column("member").combine_chunks()), np.asarray(table.column("query").combine_chunks())
            x, reps = _matrix(table.column("vec")), table.column("rep").to_numpy()
            points, names = x[member], reps[member]
            asking = np.flatnonzero(query)
            ids, s = np.zeros((0, 1), int), np.zeros((0, 1))
            if len(points) and len(asking):
                ids, s = Tree(points, leaf=256).nearest(points, x[asking], k + 1, factor)
            row, col = np.nonzero(ids >= 0)
            model = table.column("model")[0].as_py() if table.num_rows else None
            return pa.table({"model": pa.array([model] * len(row), pa.string()), "rep": pa.array(reps[asking][row] if len(row) else np.zeros(0, np.int64), pa.int64()), "neighbour": pa.array(names[ids[row, col]] if len(row) else np.zeros(0, np.int64), pa.int64()), "cosine": pa.array(np.round(s[row, col].astype(np.float64), 6), pa.float64())})

        found = self._routed(source, "nearest", (k, factor)).groupBy("model", "shard").applyInArrow(search, "model string, rep long, neighbour long, cosine double")
        best = Window.partitionBy("model", "rep").orderBy(F.desc("cosine"), "neighbour")
        short = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
        sizes = self.members.groupBy("model", F.col("rep").alias("neighbour")).agg(F.count(F.lit(1)).alias("copies"))
        named = short.join(sizes, ["model", "neighbour"], "left").join(asked, ["model", "rep"]).withColumn("copies", F.coalesce("copies", F.lit(1)))
        named = named.withColumn("copies", F.col("copies") - (F.col("neighbour") == F.col("rep")).cast("long")).where("copies > 0")
        order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "cosine", "copies")


def p5_found(vectors: DataFrame, cosine: float = 0.9, factor: float = 6.0) -> DataFrame:
    """All pairs of usable vectors of one model with at least this cosine."""
    return Index(vectors).pairs(cosine, factor)


def p5_nearest(vectors: DataFrame, k: int = 10, factor: float = 2.5) -> DataFrame:
    """The k most similar classes of every row whose id is divisible by 50, against all rows."""
    return Index(vectors).nearest(F.col("id") % 50 == 0, k, factor)
