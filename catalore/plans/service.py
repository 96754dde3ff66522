"""The search call: response, post-processing, timings, and the result cache."""

from __future__ import annotations

import json
import random
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.window import Window

from catalore.operators.user import annotate
from catalore.plans import compile as compiler
from catalore.plans.model import Group, Leaf, Query, decode
from catalore.sources.catalog import Catalog

#: Rows that may be fetched ahead of a page at most; rows of one cached span.
PREFETCH, SPAN = 4096, 256


@dataclass
class Response:
    """What a search gives: count (if wanted), rows, seed (if one was minted), seconds by step.

    A page's rows are fetched; those of a query without pages (``page_size``
    below 1) stay a DataFrame, as they may be the whole library.
    """

    count: int | None
    results: list[Row] | DataFrame
    seed: int | None = None
    metrics: dict[str, float] = field(default_factory=dict)


def user_data(node) -> bool:
    """Whether a query tree reads bookmarks or boards."""
    if isinstance(node, Group):
        return any(map(user_data, node.parts))
    return isinstance(node, Leaf) and node.name in ("in_bookmarks", "in_pinboard")


class Cache:
    """Results by canonical query and versions; spans of rows with a known end; least recently used leave."""

    def __init__(self, entries: int = 128):
        self.entries = entries
        self._held: OrderedDict[str, dict[str, Any]] = OrderedDict()

    @staticmethod
    def key(q: Query, versions: dict[str, Any]) -> str:
        """A query without its page, with the versions it depends on."""
        body = {k: v for k, v in q.__dict__.items() if k not in ("page", "page_size", "count", "results", "cache", "prefetch_rows")}
        seen = {"index": versions.get("index")} | ({"user": versions.get("user")} if user_data(q.query) else {})
        return json.dumps([body, seen], sort_keys=True, default=lambda o: [type(o).__name__, o.__dict__])

    def rows(self, key: str, offset: int, limit: int) -> list[Row] | None:
        """The rows of a page if one span holds all of it, or its known end."""
        entry = self._held.get(key)
        for start, rows, ended in entry["spans"] if entry else []:
            if start <= offset and (offset + limit <= start + len(rows) or ended and offset <= start + len(rows)):
                self._held.move_to_end(key)
                return rows[offset - start : offset - start + limit]
        return None

    def put(self, key: str, offset: int, rows: list[Row], asked: int) -> None:
        """Keep rows from ``offset``; fewer than asked for means that they are the last."""
        entry = self._held.setdefault(key, {"spans": [], "count": None})
        entry["spans"] = [s for s in entry["spans"] if not (offset <= s[0] and s[0] + len(s[1]) <= offset + len(rows))][-7:]
        entry["spans"].append((offset, rows, len(rows) < asked))
        self._held.move_to_end(key)
        while len(self._held) > self.entries:
            self._held.popitem(last=False)

    def count(self, key: str) -> int | None:
        return (self._held.get(key) or {}).get("count")

    def put_count(self, key: str, n: int) -> None:
        self._held.setdefault(key, {"spans": [], "count": None})["count"] = n

    def clear(self) -> None:
        self._held.clear()


def existing_paths(results: DataFrame, cat: Catalog, existing: DataFrame, replace: bool) -> DataFrame:
    """``results`` whose path exists; with ``replace`` another existing path of the item steps in, available ones first."""
    found = results.join(existing.select("path").withColumn("_here", F.lit(True)), "path", "left")
    if not replace:
        return found.where("_here").drop("_here")
    files = cat["files"].join(results.select("item_id").distinct(), "item_id", "left_semi").join(existing.select("path"), "path", "left_semi")
    other = files.groupBy("item_id").agg(F.min_by("path", F.struct(~F.coalesce("available", F.lit(False)), "id")).alias("_other"))
    out = found.join(other, "item_id", "left").withColumn("path", F.when(F.col("_here"), F.col("path")).otherwise(F.col("_other")))
    return out.where("path is not null").drop("_here", "_other")


def without_outro(results: DataFrame) -> DataFrame:
    """``results`` with the end-card columns blanked."""
    return results.withColumns({c: F.lit(None).cast(results.schema[c].dataType) for c in ("outro_kind", "content_end_ms") if c in results.columns})


class Engine:
    """A catalogue to be searched, with cache, embedder and post-processing.

    ``versions`` names the state of index and user data; results are cached
    only as long as it stays the same.
    """

    def __init__(self, catalog: Catalog, embed: Callable | None = None, metrics: dict[str, str] | None = None, versions: Callable[[], dict] | None = None, existing: DataFrame | None = None, outro: bool = True):
        self.catalog, self.metrics, self.existing, self.outro = catalog, metrics or {}, existing, outro
        self.versions = versions or (lambda: {"index": 0, "user": 0})
        self.cache = Cache()
        self._embedded: OrderedDict = OrderedDict()
        self._embedder = embed

    def embed(self, model: str, query: Any) -> list[float]:
        """A query's vector, the latest ones kept."""
        key = (model, query)
        if key not in self._embedded:
            if self._embedder is None:
                return compiler._no_embedder(model, query)
            self._embedded[key] = self._embedder(model, query)
            while len(self._embedded) > 64:
                self._embedded.popitem(last=False)
        return self._embedded[key]

    def search(self, query: dict, bookmarks: bool = False, bookmarks_namespace: str = "*", bookmarks_user: str = "user") -> Response:
        """Count and page of a query; a random order without a seed gets one, whose rows are not cached."""
        began = time.time()
        q = decode(query)
        minted = None
        if q.seed is None and any(o["order_by"] == "random" for o in q.order_by):
            minted = q.seed = random.randrange(1 << 53)
        seconds = {"preprocess": time.time() - began}
        key, rows_key = Cache.key(Query(**{**q.__dict__, "seed": None if minted is not None else q.seed}), self.versions()), Cache.key(q, self.versions())
        count = None
        if q.count:
            count = self.cache.count(key) if q.cache else None
            if count is None:
                at = time.time()
                count = compiler.counted(self.catalog, q).first()["total"]
                seconds["count"] = time.time() - at
                self.cache.put_count(key, count)
        out: list[Row] = []
        if q.results:
            size = q.page_size if q.page_size >= 1 else 0
            offset = (q.page - 1) * size
            plain = not (bookmarks or q.check_path) and minted is None and q.cache and size
            held = self.cache.rows(rows_key, offset, size) if plain else None
            if held is not None:
                return Response(count, held, minted, seconds | {"cached": True})
            at = time.time()
            fetch = min(max(size, q.prefetch_rows), max(size, PREFETCH)) if plain else size
            state = compiler.State(self.catalog, q.entity, embed=self.embed, metrics=self.metrics)
            df, keys = compiler.rows(q, state)
            page = compiler._page(q, df, keys, state)
            if plain and fetch > size:
                ahead = Query(**{**q.__dict__, "page": 1, "page_size": offset + fetch})
                page = compiler._page(ahead, df, keys, state).offset(offset)
            seconds["build"] = time.time() - at
            at = time.time()
            kept = page if not (q.check_path or bookmarks) else page.withColumn("_at", F.monotonically_increasing_id())
            if q.check_path and self.existing is not None:
                kept = existing_paths(kept, self.catalog, self.existing, replace=q.entity != "file" or bool(q.partition_by))
            if bookmarks:
                kept = annotate(kept, self.catalog, bookmarks_namespace, bookmarks_user)
            if "_at" in kept.columns:
                kept = kept.orderBy("_at").drop("_at")
            kept = kept if self.outro else without_outro(kept)
            if not size:
                return Response(count, kept, minted, seconds)
            rows = kept.collect()  # a page
            seconds["execute"] = time.time() - at
            if plain:
                self.cache.put(rows_key, offset, rows, fetch)
            out = rows[:size]
        return Response(count, out, minted, seconds)
