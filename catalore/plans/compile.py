"""From a decoded query to DataFrames: filter tree, ranks, order, partitions, pages, counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from catalore.functions.mixing import pk_mix
from catalore.operators import quants
from catalore.plans import ranks
from catalore.plans.filters import FILTERS, match, with_columns
from catalore.plans.model import COLUMNS, Group, Leaf, Match, Query, QueryError, decode, prune
from catalore.sources.catalog import Catalog


def _no_embedder(model: str, query: Any):
    raise QueryError("this query needs an embedder for text, or embed: null and a vector")


@dataclass
class State:
    """What a compilation gathers."""

    catalog: Catalog
    entity: str
    counting: bool = False
    embed: Callable[[str, Any], list[float]] = _no_embedder
    metrics: dict[str, str] = field(default_factory=dict)
    orders: list[dict] = field(default_factory=list)
    extras: list[tuple[str, str]] = field(default_factory=list)
    apart: list[DataFrame] = field(default_factory=list)
    uses_user_data: bool = False
    serial: int = 0

    @property
    def keys(self) -> list[str]:
        return ["file_id", "item_id"] + (["data_id"] if self.entity == "text" else [])

    def index(self, args: dict, models: list[str]):
        """(profile, step) of the int8 index to use, or None for exact vectors."""
        mode = args["index"]
        if mode == "ann":
            raise QueryError("index ann is reserved")
        if mode not in ("exact", "quant", "auto"):
            raise QueryError(f"unknown index {mode!r}")
        if mode == "exact":
            return None
        ready = quants.ready(self.catalog, models, args["variant"])
        if ready is None and (mode == "quant" or args["variant"]):
            raise QueryError("no int8 index is ready for " + ", ".join(models))
        return ready


def base(state: State) -> DataFrame:
    """The keys of all rows of the entity."""
    files = state.catalog["files"].where("item_id is not null").select(F.col("id").alias("file_id"), "item_id")
    if state.entity == "file":
        return files
    data = state.catalog["item_data"].where("data_type = 'text'").select(F.col("id").alias("data_id"), "item_id")
    return files.join(data, "item_id").select(*state.keys)


def _exact(node) -> bool:
    """Whether a branch of an or ranks no row that it does not let through."""
    if isinstance(node, Group):
        return node.kind == "and" and all(isinstance(p, Match) or isinstance(p, Leaf) and p.sort is None for p in node.parts[:-1]) and _exact(node.parts[-1])
    return True


def run(node, ctx: DataFrame, state: State, carry: bool = True) -> DataFrame:
    """The rows of ``ctx`` that pass ``node``; ranks go to ``state``.

    Ranks travel with the rows where that is exact, so that a ranked filter is
    computed once; elsewhere (``carry`` false) they are joined to the result.
    """
    if isinstance(node, Group):
        if node.kind == "and":
            for part in node.parts:
                ctx = run(part, ctx, state, carry)
            return ctx
        if node.kind == "or":
            branches = [run(part, ctx, state, carry and _exact(part)) for part in node.parts]
            ranked = list(dict.fromkeys(c for b in branches for c in b.columns if c not in state.keys))
            found = branches[0]
            for b in branches[1:]:
                found = found.unionByName(b, allowMissingColumns=True)
            return found.groupBy(*state.keys).agg(*[F.max(c).alias(c) for c in ranked]) if ranked else found.distinct()
        inner = State(state.catalog, state.entity, True, state.embed, state.metrics)
        out = ctx.join(run(node.parts[0], ctx.select(*state.keys), inner), ["file_id"] + (["data_id"] if state.entity == "text" else []), "left_anti")
        state.uses_user_data |= inner.uses_user_data
        return out
    if isinstance(node, Match):
        return match(ctx, node, state)
    return leaf(node, ctx, state, carry)


def leaf(node: Leaf, ctx: DataFrame, state: State, carry: bool) -> DataFrame:
    """One filter with its row numbers, bounds and registrations."""
    sort = node.sort
    if node.name == "match_text" and node.args["filter_only"]:
        sort = {**sort, "order_by": False, "select_as": None, "row_n": False}
    found = FILTERS[node.name](ctx, node.args, state)
    if state.counting or sort is None:
        return found.select(*ctx.columns)
    if sort["row_n"] and (sort["order_by"] or sort["select_as"]):
        tie = [F.col(k).asc() for k in state.keys if k != "item_id"]
        found = ranks.row_numbers(found, [ranks.directed(F.col("order_rank"), sort["row_n_direction"]), *tie], "_n").drop("order_rank").withColumnRenamed("_n", "order_rank")
    for bound, test in (("gt", F.Column.__gt__), ("lt", F.Column.__lt__)):
        if sort[bound] is not None:
            found = found.where(test(F.col("order_rank"), F.lit(sort[bound])))
    name = f"_rank{state.serial}"
    state.serial += 1
    used = {"order_rank": name} if sort["order_by"] or sort["select_as"] else {}
    if node.args.get("select_snippet_as") and "snip" in found.columns:
        used["snip"] = f"{name}_snip"
    ranked = found.select(*ctx.columns, *[F.col(c).alias(n) for c, n in used.items()])
    if not carry and used:
        state.apart.append(ranked.select(*[k for k in state.keys if k != "item_id"], *used.values()))
    if sort["order_by"]:
        state.orders.append({"column": name, "direction": sort["direction"], "priority": sort["priority"], "rrf": sort["rrf"], "time": node.name == "in_bookmarks" and not sort["row_n"]})
    if sort["select_as"]:
        state.extras.append((sort["select_as"], name))
    if "snip" in used:
        state.extras.append((node.args["select_snippet_as"], used["snip"]))
    return ranked if carry else found.select(*ctx.columns)


def _filtered(q: Query, state: State) -> DataFrame:
    tree = prune(q.query)
    return base(state) if tree is None else run(tree, base(state), state)


def _joined(std: DataFrame, names: set[str], state: State) -> DataFrame:
    """``std`` with columns, inner-joined to every base table of its entity as the engine does."""
    must = {"sha256", "md5"} | ({"setter_name", "language", "data_index"} if state.entity == "text" else set())
    return with_columns(std, {n for n in names | must if COLUMNS[n][0] != "std"}, state)


def rows(q: Query, state: State) -> tuple[DataFrame, list[tuple[str, Column, str]]]:
    """(all result rows with every needed column, order keys as (name, column, direction))."""
    std = _filtered(q, state)
    wanted = set(q.select) | {o["order_by"] for o in q.order_by if o["order_by"] != "random"} | set(q.partition_by or [])
    df = _joined(std, wanted, state)
    for side in state.apart:
        df = df.join(side, [k for k in state.keys if k != "item_id"], "left")
    keys: list[tuple[str, Column, str]] = []
    for i, group in enumerate(ranks.merge(state.orders, q.order_by)):
        if "column" in group[0]:
            value, direction = ranks.fused(group)
        elif group[0]["order_by"] == "random":
            value, direction = pk_mix(F.col("file_id"), q.seed or 0), group[0]["order"]
        else:
            value, direction = F.col(group[0]["order_by"]), group[0]["order"]
        df = df.withColumn(f"_key{i}", value)
        keys.append((f"_key{i}", F.col(f"_key{i}"), direction))
    return df, keys


def _order(keys, state: State) -> list[Column]:
    return [ranks.directed(c, d) for _, c, d in keys] + [F.col(k).asc() for k in state.keys if k != "item_id"]


def search(catalog: Catalog, query: dict | Query, embed: Callable | None = None, metrics: dict[str, str] | None = None) -> DataFrame:
    """The page of rows a query asks for, in order; ids, selected and extra columns.

    Ties are broken by file_id and data_id, so every result is definite.
    """
    q = query if isinstance(query, Query) else decode(query)
    state = State(catalog, q.entity, embed=embed or _no_embedder, metrics=metrics or {})
    return _page(q, *rows(q, state), state)


def _page(q: Query, df: DataFrame, keys, state: State) -> DataFrame:
    order = _order(keys, state)
    if q.partition_by:
        first = F.row_number().over(Window.partitionBy(*q.partition_by).orderBy(*order))
        df = df.withColumn("_first", first).where("_first = 1")
    extra = [F.col(column).alias(alias) for alias, column in state.extras if alias]
    shown = list(dict.fromkeys([*state.keys, *q.select]))
    df = df.orderBy(*order)
    if q.page_size >= 1:
        if q.page > 1:
            df = df.offset((q.page - 1) * q.page_size)
        df = df.limit(q.page_size)
    return df.select(*shown, *extra)


def counted(catalog: Catalog, query: dict | Query) -> DataFrame:
    """(total): rows a query finds, by membership alone, cursors not counted.

    With a partition it counts distinct keys joined as text: keys with a null
    part are not counted.
    """
    q = query if isinstance(query, Query) else decode(query)
    state = State(catalog, q.entity, counting=True)
    df = _joined(_filtered(q, state), set(q.partition_by or []), state)
    if q.partition_by:
        return df.agg(F.count_distinct(F.concat(*[F.col(c).cast("string") for c in q.partition_by])).alias("total"))
    return df.agg(F.count(F.lit(1)).alias("total"))


def item_set(catalog: Catalog, query: dict | Query, embed: Callable | None = None) -> tuple[DataFrame, str | None]:
    """(keys with sort_key of the first order, its direction): the whole unsorted set of a query."""
    q = query if isinstance(query, Query) else decode(query)
    q.partition_by = None
    state = State(catalog, q.entity, embed=embed or _no_embedder)
    df, keys = rows(q, state)
    if not keys:
        return df.select(*state.keys, F.lit(None).cast("double").alias("sort_key")), None
    return df.select(*state.keys, keys[0][1].alias("sort_key")), keys[0][2]


def explain(catalog: Catalog, query: dict | Query) -> str:
    """The plan of a query, not run."""
    return search(catalog, query)._jdf.queryExecution().toString()
