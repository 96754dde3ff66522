"""The JSON query language: decoding into plain records, strict about unknown keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from catalore.functions.errors import QueryError

#: Selectable columns: name to (table, column).
COLUMNS = {
    "file_id": ("std", "file_id"),
    "item_id": ("std", "item_id"),
    "data_id": ("std", "data_id"),
    "sha256": ("files", "sha256"),
    "path": ("files", "path"),
    "filename": ("files", "filename"),
    "last_modified": ("files", "last_modified"),
    "available": ("files", "available"),
    "md5": ("items", "md5"),
    "type": ("items", "type"),
    "size": ("items", "size"),
    "width": ("items", "width"),
    "height": ("items", "height"),
    "duration": ("items", "duration"),
    "time_added": ("items", "time_added"),
    "audio_tracks": ("items", "audio_tracks"),
    "video_tracks": ("items", "video_tracks"),
    "subtitle_tracks": ("items", "subtitle_tracks"),
    "blurhash": ("items", "blurhash"),
    "outro_kind": ("items", "outro_kind"),
    "content_end_ms": ("items", "content_end_ms"),
    "video_codec": ("items", "video_codec"),
    "audio_codec": ("items", "audio_codec"),
    "language": ("extracted_text", "language"),
    "language_confidence": ("extracted_text", "language_confidence"),
    "confidence": ("extracted_text", "confidence"),
    "text": ("extracted_text", "text"),
    "text_length": ("extracted_text", "text_length"),
    "job_id": ("item_data", "job_id"),
    "setter_id": ("item_data", "setter_id"),
    "data_index": ("item_data", "idx"),
    "source_id": ("item_data", "source_id"),
    "setter_name": ("setters", "name"),
}
#: Columns that only queries for texts have.
TEXT_ONLY = {n for n, (t, _) in COLUMNS.items() if t in ("extracted_text", "item_data", "setters")} | {"data_id"}
NUMERIC = {
    "file_id", "item_id", "data_id", "size", "width", "height", "duration", "audio_tracks", "video_tracks", "subtitle_tracks", "content_end_ms",
    "language_confidence", "confidence", "text_length", "job_id", "setter_id", "data_index", "source_id",
}

COMPARE = ("eq", "neq", "gt", "gte", "lt", "lte")
MANY = ("in_", "nin")
AFFIX = ("startswith", "not_startswith", "endswith", "not_endswith", "contains", "not_contains")

SORT = {"order_by": False, "direction": None, "priority": 0, "row_n": False, "row_n_direction": None, "gt": None, "lt": None, "select_as": None, "rrf": None}
EMBED = {"cache_key": "search", "lru_size": 1, "ttl_seconds": 60}
SOURCE = {"setters": [], "languages": None, "min_confidence": None, "min_language_confidence": 0, "min_length": 0, "max_length": None, "confidence_weight": 0, "language_confidence_weight": 0}
_VECTOR = {"query": None, "model": None, "distance_aggregation": "MIN", "embed": EMBED, "src_text": None, "index": "auto", "variant": None, "k": 10000}

#: Leaf filters: argument defaults.
ARGUMENTS: dict[str, dict[str, Any]] = {
    "match_path": {"match": None, "filename_only": False, "raw_fts5_match": True},
    "match_text": {
        "match": None, "filter_only": False, "setters": [], "languages": [], "min_language_confidence": None, "min_confidence": None, "raw_fts5_match": True,
        "min_length": None, "max_length": None, "select_snippet_as": None, "s_max_len": 30, "s_ellipsis": "...", "s_start_tag": "<b>", "s_end_tag": "</b>",
    },
    "match_tags": {"tags": [], "match_any": False, "min_confidence": 0, "setters": [], "namespaces": [], "all_setters_required": False},
    "in_bookmarks": {"filter": True, "namespaces": [], "sub_ns": False, "user": "user", "include_wildcard": True},
    "in_pinboard": {"filter": True, "pinboard_ids": [], "user": "user"},
    "has_data_unprocessed": {"setter_name": None, "data_types": []},
    "text_embeddings": _VECTOR,
    "image_embeddings": _VECTOR | {"clip_xmodal": False},
    "similar_to": {
        "target": None, "model": None, "distance_function": "L2", "force_distance_function": None, "distance_aggregation": "AVG", "src_text": None,
        "clip_xmodal": False, "xmodal_t2t": True, "xmodal_i2i": True, "index": "auto", "variant": None, "k": 10000,
    },
}
#: Leaf filters given by one name only.
NAMED = ("processed_by", "failed_for")
#: Filters that rank, with their sort defaults where they differ.
RANKED: dict[str, dict[str, Any]] = {
    "match_path": {"direction": "asc", "row_n_direction": "asc"},
    "match_text": {"direction": "asc", "row_n_direction": "asc"},
    "match_tags": {"direction": "desc", "row_n_direction": "desc"},
    "in_bookmarks": {"direction": "desc", "row_n_direction": "desc"},
    "text_embeddings": {"direction": "asc", "row_n_direction": "asc", "order_by": True},
    "image_embeddings": {"direction": "asc", "row_n_direction": "asc", "order_by": True},
    "similar_to": {"direction": "asc", "row_n_direction": "asc", "order_by": True},
}


@dataclass
class Group:
    """and, or, not with its parts."""

    kind: str
    parts: list


@dataclass
class Match:
    """Attribute predicates: kind is ops, and, or, not; parts are operation records."""

    kind: str
    parts: list[dict[str, dict[str, Any]]]


@dataclass
class Leaf:
    """A filter with its arguments and, where it ranks, its sort record."""

    name: str
    args: dict[str, Any]
    sort: dict[str, Any] | None = None


@dataclass
class Query:
    """The envelope; ``query`` is a tree or None."""

    query: Any = None
    order_by: list[dict[str, Any]] = field(default_factory=lambda: [{"order_by": "last_modified", "order": None, "priority": 0}])
    select: list[str] = field(default_factory=lambda: ["sha256", "path", "last_modified", "type"])
    entity: str = "file"
    partition_by: list[str] | None = None
    seed: int | None = None
    page: int = 1
    page_size: int = 10
    count: bool = True
    results: bool = True
    check_path: bool = False
    cache: bool = True
    prefetch_rows: int = 0


def _known(given: dict, defaults: dict, what: str) -> dict:
    if extra := set(given) - set(defaults):
        raise QueryError(f"unknown keys in {what}: {sorted(extra)}")
    return {**defaults, **given}


def _ops(given: dict) -> dict[str, dict[str, Any]]:
    if extra := set(given) - {*COMPARE, *MANY, *AFFIX}:
        raise QueryError(f"unknown operations: {sorted(extra)}")
    for op, values in given.items():
        if extra := set(values) - set(COLUMNS):
            raise QueryError(f"unknown columns in {op}: {sorted(extra)}")
    return {op: {c: v for c, v in values.items() if v is not None} for op, values in given.items()}


def _match(given: dict) -> Match:
    for kind in ("and", "or", "not"):
        for key in (f"{kind}_", kind):
            if key in given:
                if len(given) > 1:
                    raise QueryError(f"match: {key} stands alone")
                parts = [given[key]] if kind == "not" else given[key]
                return Match(kind, [_ops(p) for p in parts])
    return Match("ops", [_ops(given)])


def element(given: dict):
    """One node of the query tree; the key that names it decides."""
    if not isinstance(given, dict):
        raise QueryError(f"not a query element: {given!r}")
    for kind in ("and", "or", "not"):
        for key in (f"{kind}_", kind):
            if key in given:
                if len(given) > 1:
                    raise QueryError(f"{key} stands alone")
                return Group(kind, [element(given[key])] if kind == "not" else [element(x) for x in given[key]])
    names = [n for n in (*ARGUMENTS, *NAMED, "match") if n in given]
    if len(names) != 1:
        raise QueryError(f"expected one filter, found {names or sorted(given)}")
    name = names[0]
    rest = {k: v for k, v in given.items() if k != name}
    if name == "match":
        if rest:
            raise QueryError(f"unknown keys beside match: {sorted(rest)}")
        return _match(given["match"])
    if name in NAMED:
        if rest:
            raise QueryError(f"unknown keys beside {name}: {sorted(rest)}")
        return Leaf(name, {"setter": given[name]})
    args = _known(given[name], ARGUMENTS[name], name)
    if "src_text" in args and args["src_text"] is not None:
        args["src_text"] = _known(args["src_text"], SOURCE, "src_text")
    if name not in RANKED:
        if rest:
            raise QueryError(f"unknown keys beside {name}: {sorted(rest)}")
        return Leaf(name, args)
    sort = _known(rest, SORT | RANKED[name], f"sorting of {name}")
    if sort["rrf"] is not None:
        sort["rrf"] = _known(sort["rrf"], {"k": 1, "weight": 1.0}, "rrf")
    for key in ("direction", "row_n_direction"):
        if sort[key] is None:
            sort[key] = RANKED[name][key]
        if sort[key] not in ("asc", "desc"):
            raise QueryError(f"{key} is asc or desc")
    return Leaf(name, args, sort)


def decode(given: dict) -> Query:
    """A query document; a fault in it raises ``QueryError``."""
    defaults = Query().__dict__
    q = Query(**_known(given, defaults, "query"))
    if q.entity not in ("file", "text"):
        raise QueryError(f"unknown entity {q.entity!r}")
    q.query = element(q.query) if q.query else None
    orders = []
    for o in q.order_by or []:
        o = _known(o, {"order_by": "last_modified", "order": None, "priority": 0}, "order_by")
        if o["order_by"] not in COLUMNS and o["order_by"] != "random":
            raise QueryError(f"unknown order {o['order_by']!r}")
        orders.append(o | {"order": o["order"] or ("desc" if o["order_by"] == "last_modified" else "asc")})
    q.order_by = orders
    for what, names in (("select", q.select), ("partition_by", q.partition_by or []), ("order_by", [o["order_by"] for o in orders if o["order_by"] != "random"])):
        if unknown := [n for n in names if n not in COLUMNS]:
            raise QueryError(f"unknown columns in {what}: {unknown}")
        if q.entity == "file" and (wrong := [n for n in names if n in TEXT_ONLY]):
            raise QueryError(f"{what} of a query for files has text columns: {wrong}")
    q.partition_by = q.partition_by or None
    q.page = max(1, q.page)
    return q


def prune(node):
    """The tree without parts that say nothing; None if nothing is left."""
    if node is None:
        return None
    if isinstance(node, Group):
        parts = [p for p in map(prune, node.parts) if p is not None]
        if not parts:
            return None
        return Group("not", parts) if node.kind == "not" else parts[0] if len(parts) == 1 else Group(node.kind, parts)
    if isinstance(node, Match):
        parts = [p for p in ({op: v for op, v in part.items() if v} for part in node.parts) if p]
        if not parts:
            return None
        return Match(node.kind, parts) if node.kind == "not" or len(parts) > 1 else Match("ops", parts)
    a = node.args
    if node.name == "match_path" and not (a["match"] or "").strip():
        return None
    if node.name == "match_text" and not (a["match"] or "").strip() and not a["filter_only"]:
        return None
    if node.name == "match_tags" and not a["tags"]:
        return None
    if node.name in ("in_bookmarks", "in_pinboard") and not a["filter"]:
        return None
    if node.name in NAMED and not a["setter"]:
        return None
    if node.name == "has_data_unprocessed" and not (a["setter_name"] and a["data_types"]):
        return None
    if node.name in ("text_embeddings", "image_embeddings") and a["query"] in (None, "", b""):
        return None
    if node.name == "similar_to" and not a["target"]:
        return None
    return node
