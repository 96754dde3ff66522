"""The leaf filters: each narrows a context of row keys and may rank it.

A filter takes ``(context, args, state)`` and returns the context's rows that
pass, each once, with ``order_rank`` where it ranks and ``snip`` where a snippet
is wanted. Vectors and texts stay out of shuffles: distances and ranks are
computed before grouping and the payload is dropped.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, functions as F

from catalore.functions import fts, vectors
from catalore.functions.text import like
from catalore.plans.match import columns_of, condition
from catalore.plans.model import COLUMNS, Match, QueryError
from catalore.plans.runtime import cut_lineage, few

#: Vectors of one target item that are broadcast at once; a larger target comes in several blocks.
TARGET_ROWS = 10_000


def with_columns(ctx: DataFrame, names: set[str], state, prefix: str = "") -> DataFrame:
    """``ctx`` joined once to each base table that ``names`` come from."""
    cat = state.catalog
    need = {COLUMNS[n][0] for n in names}
    df = ctx

    def pick(table: str) -> list[Column]:
        return [F.col(c).alias(prefix + n) for n, (t, c) in COLUMNS.items() if t == table and n in names]

    if "files" in need:
        df = df.join(cat["files"].select(F.col("id").alias("file_id"), *pick("files")), "file_id")
    if "items" in need:
        df = df.join(cat["items"].select(F.col("id").alias("item_id"), *pick("items")), "item_id")
    if need & {"item_data", "setters"}:
        made = cat["item_data"].select(F.col("id").alias("data_id"), F.col("setter_id").alias("_setter"), *pick("item_data"))
        df = df.join(made, "data_id")
        if "setters" in need:
            df = df.join(cat["setters"].select(F.col("id").alias("_setter"), *pick("setters")), "_setter")
        df = df.drop("_setter")
    if "extracted_text" in need:
        df = df.join(cat["extracted_text"].select(F.col("id").alias("data_id"), *pick("extracted_text")), "data_id")
    return df


def match(ctx: DataFrame, node: Match, state) -> DataFrame:
    """Attribute predicates."""
    names = columns_of(node)
    if state.entity == "file" and (wrong := {n for n in names if COLUMNS[n][0] in ("extracted_text", "item_data", "setters") or n == "data_id"}):
        raise QueryError(f"match of a query for files has text columns: {sorted(wrong)}")
    std = {n for n in names if COLUMNS[n][0] == "std"}
    joined = with_columns(ctx, names - std, state, prefix="m_")
    return joined.where(condition(node, lambda n: F.col(n if n in std else f"m_{n}"))).select(*ctx.columns)


def _tree(args):
    return fts.parse(args["match"] if args["raw_fts5_match"] else fts.escape(args["match"]))


def match_path(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Full-text match on path or filename, ranked by BM25."""
    corpus = state.catalog["files"].select(F.col("id").alias("file_id"), "path", "filename")
    searched = ["filename"] if args["filename_only"] else ["path", "filename"]
    tree = fts.known_columns(_tree(args), ["path", "filename"])
    index = state.catalog.text_indexes.get("files")
    if index is not None:
        hits = index.search(tree, searched).select(F.col("key").alias("file_id"), F.col("rank").alias("order_rank"))
        return ctx.join(hits, "file_id", "left_semi") if state.counting else ctx.join(hits, "file_id").select(*ctx.columns, "order_rank")
    if state.counting:
        hits = corpus.where(fts.matches(tree, searched)).select("file_id")
        return ctx.join(hits, "file_id", "left_semi")
    hits = fts.bm25(corpus, tree, searched, ["path", "filename"]).select("file_id", F.col("rank").alias("order_rank"))
    return ctx.join(hits, "file_id").select(*ctx.columns, "order_rank")


def _text_criteria(args: dict, setters: str = "setters") -> Column:
    """Conditions on text rows; a bound of 0 or less is none, a null value fails a bound."""
    out = F.lit(True)
    if args.get("languages"):
        out = out & F.col("language").isin(*args["languages"])
    for key, column, at_least in (("min_confidence", "confidence", True), ("min_language_confidence", "language_confidence", True), ("min_length", "text_length", True), ("max_length", "text_length", False)):
        bound = args.get(key)
        if bound is not None and bound > 0:
            out = out & (F.col(column) >= bound if at_least else F.col(column) <= bound)
    if args.get(setters):
        out = out & F.col("setter_name").isin(*args[setters])
    return out


def _named(df: DataFrame, state, names: list[str] | None, alias: str = "setter_name") -> DataFrame:
    """``df`` with the name of its setter; the setters are a small dimension."""
    setters = state.catalog["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias(alias))
    return df.join(setters.where(F.col(alias).isin(*names)) if names else setters, "setter_id")


def match_text(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Full-text match on extracted texts, ranked by BM25; per file the best text counts."""
    cat = state.catalog
    corpus = cat["extracted_text"].withColumnRenamed("id", "data_id")
    on = "data_id" if state.entity == "text" else "item_id"
    made = cat["item_data"].select(F.col("id").alias("data_id"), "item_id", "setter_id")
    plain = args["filter_only"] or not (args["match"] or "").strip()
    ranked = not (plain or state.counting)
    tree = None if plain else fts.known_columns(_tree(args), ["text"])
    index = cat.text_indexes.get("extracted_text")
    if index is not None and not plain:
        hits = corpus.join(index.search(tree).withColumnRenamed("key", "data_id"), "data_id")
    elif ranked:
        hits = fts.bm25(corpus, tree, ["text"])
    else:
        hits = corpus if plain else corpus.where(fts.matches(tree, ["text"]))
        hits = hits.withColumn("rank", F.lit(1.0))
    keep = hits.where(_text_criteria({k: v for k, v in args.items() if k != "setters"}))
    snip = fts.snippet(F.col("text"), tree, args["s_max_len"], args["s_start_tag"], args["s_end_tag"], args["s_ellipsis"]) if ranked and args["select_snippet_as"] else None
    keep = keep.select("data_id", "rank", *([snip.alias("snip")] if snip is not None else []))
    rows = _named(keep.join(made, "data_id"), state, args["setters"])
    if not ranked:
        found = ctx.join(rows, on, "left_semi")
        return found if state.counting else found.withColumn("order_rank", F.lit(1.0))
    if on == "data_id":
        return ctx.join(rows.drop("item_id"), "data_id").select(*ctx.columns, F.col("rank").alias("order_rank"), *(["snip"] if snip is not None else []))
    best = [F.min("rank").alias("order_rank")] + ([F.min_by("snip", F.struct("rank", "data_id")).alias("snip")] if snip is not None else [])
    # one row per item before it meets the files
    return ctx.join(rows.groupBy("item_id").agg(*best), "item_id").select(*ctx.columns, "order_rank", *(["snip"] if snip is not None else []))


def match_tags(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Items with all (or any) of the tags, ranked by the mean confidence of the matching rows."""
    cat = state.catalog
    wanted = cat["tags"].where(F.col("name").isin(*args["tags"]))
    if args["namespaces"]:
        ok = F.lit(False)
        for ns in args["namespaces"]:
            ok = ok | like(F.col("namespace"), f"{ns}%")
        wanted = wanted.where(ok)
    rows = cat["tags_items"].select("item_data_id", "tag_id", "confidence")
    if (args["min_confidence"] or 0) > 0:
        rows = rows.where(F.col("confidence") >= args["min_confidence"])
    made = cat["item_data"].where("data_type = 'tags'").select(F.col("id").alias("item_data_id"), "item_id", "setter_id")
    rows = rows.join(wanted.select(F.col("id").alias("tag_id"), "name"), "tag_id").join(made, "item_data_id")
    rows = _named(rows, state, args["setters"])
    agg = [F.avg("confidence").alias("order_rank"), F.count_distinct("name").alias("_tags"), F.count_distinct("setter_id", "name").alias("_pairs")]
    each = rows.groupBy("item_id").agg(*agg)
    tags = len(args["tags"])
    any_of = args["match_any"] and tags > 1
    if not any_of:
        by_setter = args["all_setters_required"] and args["setters"]
        each = each.where(F.col("_pairs") == tags * len(args["setters"]) if by_setter else F.col("_tags") == tags)
    if state.counting:
        return ctx.join(each, "item_id", "left_semi")
    return ctx.join(each.select("item_id", "order_rank"), "item_id").select(*ctx.columns, "order_rank")


def in_bookmarks(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Files whose content is bookmarked, ranked by the time of the latest bookmark."""
    state.uses_user_data = True
    users = [args["user"]] + (["*"] if args["include_wildcard"] else [])
    marks = state.catalog["bookmarks"].where(F.col("user").isin(*users))
    if args["namespaces"]:
        ok = F.col("namespace").isin(*args["namespaces"])
        if args["sub_ns"]:
            for ns in args["namespaces"]:
                ok = ok | like(F.col("namespace"), f"{ns}.%")
        marks = marks.where(ok)
    best = marks.groupBy("sha256").agg(F.max("time_added").alias("order_rank"))
    files = state.catalog["files"].select(F.col("id").alias("file_id"), "sha256")
    hits = files.join(best, "sha256").select("file_id", "order_rank")
    return ctx.join(hits, "file_id", "left_semi") if state.counting else ctx.join(hits, "file_id").select(*ctx.columns, "order_rank")


def in_pinboard(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Files whose content is on the current version of one of the user's boards."""
    state.uses_user_data = True
    boards = state.catalog["pinboards"].where(F.col("user") == args["user"])
    if args["pinboard_ids"]:
        boards = boards.where(F.col("id").isin(*args["pinboard_ids"]))
    pins = state.catalog["pinboard_version_items"].join(boards.select(F.col("head_version_id").alias("version_id")), "version_id", "left_semi")
    files = state.catalog["files"].select(F.col("id").alias("file_id"), "sha256").join(pins, "sha256", "left_semi")
    return ctx.join(files, "file_id", "left_semi")


def processed_by(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Files with data by a setter; texts with data derived from them by it."""
    rows = _named(state.catalog["item_data"].select("item_id", "setter_id", "source_id"), state, [args["setter"]])
    if state.entity == "text":
        return ctx.join(rows.select(F.col("source_id").alias("data_id")), "data_id", "left_semi")
    return ctx.join(rows.select("item_id"), "item_id", "left_semi")


def has_data_unprocessed(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Rows with data of the given types from which the setter has derived nothing yet."""
    data = state.catalog["item_data"]
    source = data.where(F.col("data_type").isin(*args["data_types"]) & ~F.coalesce("is_placeholder", F.lit(False))).select(F.col("id").alias("_src"), "item_id")
    derived = _named(data.select("setter_id", F.col("source_id").alias("_src")), state, [args["setter_name"]]).select("_src")
    left = source.join(derived, "_src", "left_anti")
    if state.entity == "text":
        return ctx.join(left.select(F.col("_src").alias("data_id")), "data_id", "left_semi")
    return ctx.join(left.select("item_id"), "item_id", "left_semi")


def failed_for(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Rows whose item a setter has failed on too often."""
    failed = state.catalog["item_extraction_errors"].where("attempts >= skip_after").select("item_id", "setter_id")
    return ctx.join(_named(failed, state, [args["setter"]]).select("item_id"), "item_id", "left_semi")


def _query_vector(args: dict, state):
    """The vector of a query: given, from a base64 NPY file, or made by the session's embedder."""
    q = args["query"]
    if isinstance(q, (list, tuple)):
        return [float(x) for x in q]
    if args["embed"] is None:
        try:
            return vectors.load_npy(base64.b64decode(q, validate=True)).tolist()
        except Exception as e:
            raise QueryError("the query is no base64 NPY vector") from e
    return state.embed(args["model"], q)


def _aggregate(kind: str, d: Column, weight: Column | None) -> Column:
    if weight is not None:
        return F.try_divide(F.sum(d * weight), F.sum(F.when(d.isNotNull(), weight)))
    return {"MIN": F.min, "MAX": F.max, "AVG": F.avg}[kind.upper()](d)


def _weighs(src) -> bool:
    return bool(src and (src["confidence_weight"] or src["language_confidence_weight"]))


def _weight(src, *sides: str) -> Column | None:
    """Product of the sides' confidences to the given powers; unknown ones count as 1."""
    if not _weighs(src):
        return None
    out = F.lit(1.0)
    for key, column in (("confidence_weight", "confidence"), ("language_confidence_weight", "language_confidence")):
        if src[key]:
            product = F.lit(1.0)
            for s in sides:
                product = product * F.coalesce(F.col(s + column), F.lit(1.0))
            out = out * F.pow(product, F.lit(float(src[key])))
    return out


def _vector_rows(args: dict, state, models: list[str], outer: bool, need_text: bool) -> DataFrame:
    """(vec_id, item_id, source_id, data_type, confidences): a model's vector rows after the source-text criteria."""
    cat, src = state.catalog, args["src_text"]
    rows = _named(cat["item_data"].select(F.col("id").alias("vec_id"), "item_id", "setter_id", "source_id", "data_type"), state, models, "model").drop("setter_id")
    if src is None and not need_text:
        return rows
    src = src or {}
    made = cat["item_data"].select(F.col("id").alias("source_id"), "setter_id")
    texts = cat["extracted_text"].select(F.col("id").alias("source_id"), "language", "language_confidence", "confidence", "text_length")
    source = made.join(texts, "source_id", "left" if outer else "inner")
    if src.get("setters"):
        source = source.join(cat["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter_name")), "setter_id", "left")
    source = source.drop("setter_id").withColumn("_has", F.lit(True))
    joined = rows.join(source, "source_id", "left" if outer else "inner")
    ok = _text_criteria(src)
    return joined.where(F.col("_has").isNull() | ok if outer else ok).drop("_has")


def _payload(args: dict, state, models: list[str]) -> tuple[DataFrame, float | None]:
    """(vec_id, vec) of all vectors, or of their int8 codes where the index says so (then with their step)."""
    profile = state.index(args, models)
    if profile is None:
        return state.catalog["embeddings"].select(F.col("id").alias("vec_id"), F.col("embedding").alias("vec")), None
    codes = state.catalog["embedding_quants"].where(F.col("profile_id") == profile[0])
    return codes.select(F.col("id").alias("vec_id"), F.col("quant").alias("vec")), profile[1]


def _coded(query, step: float | None):
    """The query in the space of the codes."""
    import numpy as np

    return query if step is None else np.clip(np.rint(np.asarray(query, dtype=np.float32) / np.float32(step)), -128, 127).tolist()


def _semantic(ctx: DataFrame, args: dict, state, models: list[str], metric: str, outer: bool, on_text: bool) -> DataFrame:
    rows = _vector_rows(args, state, models, outer, need_text=False)
    on = ["data_id"] if on_text else ["item_id"]
    if on_text:
        rows = rows.drop("item_id").withColumnRenamed("source_id", "data_id")
    if state.counting:
        # membership alone, by the table that holds a row for every vector
        held = state.catalog["embeddings"].select(F.col("id").alias("vec_id"))
        return ctx.join(rows.join(held, "vec_id", "left_semi"), on, "left_semi")
    vec, step = _payload(args, state, models)
    query = _coded(_query_vector(args, state), step)
    # distances are taken where the vectors lie; only (vec_id, d) meets the other tables
    near = rows.join(vec.select("vec_id", vectors.distance_to(F.col("vec"), query, metric).alias("d")), "vec_id")
    each = near.groupBy(*on).agg(_aggregate(args["distance_aggregation"], F.col("d"), _weight(args["src_text"], "")).alias("order_rank"))
    return ctx.join(each, on).select(*ctx.columns, "order_rank")


def text_embeddings(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Semantic text search: L2 distance of text vectors to the query."""
    return _semantic(ctx, args, state, [args["model"]], vectors.L2, outer=False, on_text=state.entity == "text")


def image_embeddings(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Semantic image search: cosine distance unless the model says L2; ``clip_xmodal`` adds the text sibling."""
    models = [args["model"]] + ([f"t{args['model']}"] if args["clip_xmodal"] else [])
    metric = state.metrics.get(args["model"]) or state.metrics.get(args["model"].split("/")[0]) or vectors.COSINE
    return _semantic(ctx, args, state, models, metric, outer=True, on_text=False)


def similar_to(ctx: DataFrame, args: dict, state) -> DataFrame:
    """Rows by the distance of their vectors to those of a target item, itself excluded."""
    cat, src = state.catalog, args["src_text"]
    models = [args["model"]] + ([f"t{args['model']}"] if args["clip_xmodal"] else [])
    rows = _vector_rows(args, state, models, outer=args["clip_xmodal"], need_text=False)
    target = cat["items"].where(F.col("sha256") == args["target"]).select(F.col("id").alias("item_id"))
    others = rows.join(target, "item_id", "left_anti")
    if state.counting:
        held = cat["embeddings"].select(F.col("id").alias("vec_id"))
        some = rows.join(target, "item_id", "left_semi").join(held, "vec_id", "left_semi").limit(1).select(F.lit(True).alias("_some"))
        mine = others.join(held, "vec_id", "left_semi").select("item_id")
        return ctx.join(mine, "item_id", "left_semi").crossJoin(F.broadcast(some)).select(*ctx.columns)
    metric = args["force_distance_function"] or state.metrics.get(args["model"]) or state.metrics.get(args["model"].split("/")[0]) or args["distance_function"]
    metric = vectors.COSINE if str(metric).lower() == "cosine" else vectors.L2
    vec, _ = _payload(args, state, models)
    carry = ["data_type"] + (["confidence", "language_confidence"] if _weighs(src) else [])
    mine = rows.join(target, "item_id", "left_semi").select("vec_id", *[F.col(c).alias(f"t_{c}") for c in carry])
    own = vec.join(F.broadcast(mine) if few(mine, TARGET_ROWS) else mine, "vec_id").select(F.col("vec").alias("t_vec"), *[f"t_{c}" for c in carry])
    theirs = others.join(ctx.select("item_id").distinct(), "item_id", "left_semi").select("vec_id", "item_id", *carry)
    # the vectors of one item are a query set against all rows, in broadcast blocks
    near = None
    for block in _blocks(own):
        d = vec.crossJoin(F.broadcast(block)).withColumn("d", vectors.distance(F.col("t_vec"), F.col("vec"), metric)).drop("vec", "t_vec")
        pairs = theirs.join(d, "vec_id")
        near = pairs if near is None else near.unionByName(pairs)
    if args["clip_xmodal"]:
        for keep, kind in ((args["xmodal_i2i"], "clip"), (args["xmodal_t2t"], "text-embedding")):
            if not keep:
                near = near.where((F.col("t_data_type") != kind) | (F.col("data_type") != kind))
    each = near.groupBy("item_id").agg(_aggregate(args["distance_aggregation"], F.col("d"), _weight(src, "", "t_")).alias("order_rank"))
    return ctx.join(each, "item_id").select(*ctx.columns, "order_rank")


def _blocks(own: DataFrame) -> list[DataFrame]:
    """A target's vectors, computed once, in blocks of about ``TARGET_ROWS`` at most."""
    own = cut_lineage(own)
    n = -(-own.count() // TARGET_ROWS)
    if n <= 1:
        return [own]
    # twice as many blocks as needed, so that none outgrows its bound by chance
    marked = cut_lineage(own.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2 * n))))
    return [marked.where(F.col("_block") == i).drop("_block") for i in range(2 * n)]


FILTERS = {f.__name__: f for f in (match_path, match_text, match_tags, in_bookmarks, in_pinboard, processed_by, has_data_unprocessed, failed_for, text_embeddings, image_embeddings, similar_to)}
