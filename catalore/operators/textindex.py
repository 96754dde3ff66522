"""A full-text index: positional trigram postings, kept beside the texts they were made from.

A query touches only the postings of its own trigrams: a phrase stands where
all its trigrams follow each other, so neither matching nor BM25 reads a text.
Postings are written in ranges of their trigram, so that the filter on it
skips files, and a trigram that many texts have spans several of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalore.functions import fts

POSTINGS = "key bigint, col string, gram string, at array<int>"
LENGTHS = "key bigint, tokens bigint"


@dataclass
class TextIndex:
    """``postings`` (key, col, gram, at: positions from 1) and ``lengths`` (key, tokens) of ``columns``."""

    postings: DataFrame
    lengths: DataFrame
    columns: tuple[str, ...]

    @classmethod
    def build(cls, corpus: DataFrame, key: str, columns: list[str]) -> "TextIndex":
        """The index of a corpus. A key recorded twice is indexed once, by the greater text of each column.

        Rows with a null key are not indexed; null and short texts have no
        postings but count as rows.
        """
        once = corpus.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(*[F.max(c).alias(c) for c in columns])
        texts = once.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lower(c).alias("text")) for c in columns])).alias("t")).select("key", "t.col", "t.text")
        spots = F.sequence(F.lit(1), F.length("text") - (fts.GRAM - 1))
        grams = F.transform(spots, lambda i: F.struct(F.col("text").substr(i, F.lit(fts.GRAM)).alias("gram"), i.alias("at")))
        rows = texts.where(F.length("text") >= fts.GRAM).select("key", "col", F.explode(grams).alias("g"))
        postings = rows.groupBy("key", "col", F.col("g.gram").alias("gram")).agg(F.sort_array(F.collect_list("g.at")).alias("at"))
        return cls(postings.select("key", "col", "gram", "at"), once.select("key", fts.tokens_of(columns).alias("tokens")), tuple(columns))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, columns: list[str]) -> "TextIndex":
        return cls(spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), spark.read.schema(LENGTHS).parquet(f"{folder}/lengths"), tuple(columns))

    def save(self, folder: str) -> None:
        """Write the index to a folder other than the one it was read from."""
        self.postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")

    def changed(self, corpus: DataFrame, key: str, removed: DataFrame | None = None) -> "TextIndex":
        """The index after rows of ``corpus`` were added or changed and the keys of ``removed`` (key) deleted."""
        fresh = TextIndex.build(corpus, key, list(self.columns))
        stale = fresh.lengths.select("key")
        if removed is not None:
            stale = stale.unionByName(removed.select(F.col("key").cast("long").alias("key"))).distinct()
        return TextIndex(
            self.postings.join(stale, "key", "left_anti").unionByName(fresh.postings),
            self.lengths.join(stale, "key", "left_anti").unionByName(fresh.lengths),
            self.columns,
        )

    def search(self, node, searched: list[str] | None = None) -> DataFrame:
        """(key, rank) of the rows that match a parsed query; rank is negative BM25, smaller is better."""
        node = fts.known_columns(node, list(self.columns))
        names = list(searched or self.columns)
        terms = fts.phrases(node)
        spark = self.lengths.sparkSession
        # one row a trigram of the query
        wanted = [(p.folded[i : i + fts.GRAM], n, i, p.grams, c) for n, p in enumerate(terms) if len(p.text) >= fts.GRAM for i in range(p.grams) for c in names if p.looks_into(c)]
        asked = spark.createDataFrame(wanted, "gram string, term int, off int, grams int, col string")
        own = self.postings.where(F.col("gram").isin(sorted({w[0] for w in wanted})) & F.col("col").isin(names))
        spots = own.join(F.broadcast(asked), ["gram", "col"]).select("key", "col", "term", "grams", F.explode(F.transform("at", lambda a: a - F.col("off"))).alias("start"))
        whole = spots.groupBy("key", "col", "term", "start").agg(F.count(F.lit(1)).alias("n"), F.first("grams").alias("grams")).where("n = grams")
        starts = [F.collect_list(F.when(F.col("term") == n, F.col("start"))).alias(f"s{n}") for n in range(len(terms))]
        by_column = whole.groupBy("key", "col").agg(*starts)
        counts = self._counts(node, [F.col(f"s{n}") for n in range(len(terms))])
        each = by_column.select("key", *[F.size(f"s{n}").alias(f"r{n}") for n in range(len(terms))], *[c.alias(f"t{n}") for n, c in enumerate(counts)])
        rows = each.groupBy("key").agg(*[F.sum(f"{x}{n}").alias(f"{x}{n}") for x in "rt" for n in range(len(terms))])
        held = [F.sum((F.col(f"r{n}") > 0).cast("long")).alias(f"d{n}") for n in range(len(terms))]
        stats = self.lengths.agg(F.count(F.lit(1)).alias("_rows"), F.sum("tokens").alias("_tokens")).crossJoin(rows.agg(*held))
        place = iter(range(len(terms)))
        found = rows.where(self._true(node, place)).join(self.lengths, "key").crossJoin(F.broadcast(stats))  # one row
        used = [n for n, p in enumerate(terms) if len(p.text) >= fts.GRAM]
        rank = fts.score([F.col(f"t{n}") for n in used], [F.col(f"d{n}") for n in used], F.col("tokens"), F.col("_rows"), F.col("_tokens") / F.col("_rows"))
        return found.select("key", rank.alias("rank"))

    def _counts(self, node, starts: list[Column]) -> list[Column]:
        if isinstance(node, fts.Near):
            return [F.size(kept) for kept in fts.near_starts(node, starts)]
        if isinstance(node, fts.Phrase):
            return [F.size(starts[0])]
        left = len(fts.phrases(node.left))
        return self._counts(node.left, starts[:left]) + self._counts(node.right, starts[left:])

    def _true(self, node, place) -> Column:
        if isinstance(node, fts.Phrase):
            return F.col(f"t{next(place)}") > 0
        if isinstance(node, fts.Near):
            return F.col(f"t{[next(place) for _ in node.parts][0]}") > 0
        left = self._true(node.left, place)
        return fts.combined(node, left, self._true(node.right, place))
