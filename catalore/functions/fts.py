"""Trigram full-text search: query syntax, matching, BM25 and snippets as columns.

``bm25`` scans a corpus; ``operators.textindex`` answers the same queries from
postings, without reading texts.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from catalore.functions.errors import QueryError

K1, B = 1.2, 0.75
#: The tokenizer cuts texts into runs of this many characters.
GRAM = 3


@dataclass(frozen=True)
class Phrase:
    """A substring to be found, whatever its letter case.

    ``within`` restricts the columns it is looked for in: pairs of (column
    names, whether those are the excluded ones), all of which must hold.
    """

    text: str
    within: tuple[tuple[tuple[str, ...], bool], ...] = ()

    @property
    def folded(self) -> str:
        return self.text.lower()

    @property
    def grams(self) -> int:
        """Its length in trigrams, the tokens that positions count."""
        return len(self.folded) - (GRAM - 1)

    def looks_into(self, column: str) -> bool:
        return all((column in names) != excluded for names, excluded in self.within)


#: Tokens that may lie between the phrases of a NEAR group unless it says otherwise.
NEAR_TOKENS = 10


@dataclass(frozen=True)
class Near:
    """Phrases of one column, each ending no more than ``most`` tokens before the last of them begins."""

    parts: tuple[Phrase, ...]
    most: int = NEAR_TOKENS


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


_LEX = re.compile(r'\s*(?:(?P<phrase>"(?:[^"]|"")*")|(?P<sign>[()+*:^{}-])|(?P<word>[^\s"()+*:^{}-]+))')


def parse(query: str):
    """A query's tree: AND, OR, NOT, implicit AND, phrases, ``+``, prefix ``*`` and parentheses.

    NOT binds tightest, then AND, then OR. ``NEAR(a b, n)`` and column filters
    (``name: x``, ``{a b}: (x OR y)``, ``- name: x``) are understood.
    """
    tokens, at = [], 0
    while query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"unterminated string in {query!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek():
        return tokens[place]

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def expect(sign):
        if take() != ("sign", sign):
            raise QueryError(f"missing {sign}")

    def phrase():
        kind, text = take()
        if kind not in ("word", "phrase"):
            raise QueryError(f"unexpected {text!r}")
        value = text[1:-1].replace('""', '"') if kind == "phrase" else text
        while peek() == ("sign", "+"):
            take()
            kind, more = take()
            if kind not in ("word", "phrase"):
                raise QueryError("+ needs a phrase")
            value += more[1:-1].replace('""', '"') if kind == "phrase" else more
        if peek() == ("sign", "*"):
            # a prefix of a trigram run is any substring already
            take()
        return Phrase(value)

    def near():
        expect("(")
        parts, most = [], NEAR_TOKENS
        while peek()[0] in ("word", "phrase") and not peek()[1].startswith(","):
            # a comma ends a phrase, wherever it is written
            kind, text = peek()
            if kind == "word" and "," in text:
                head, _, rest = text.partition(",")
                tokens[place : place + 1] = [("word", head), *([("word", "," + rest)])]
            parts.append(phrase())
        if peek()[0] == "word":
            number = take()[1][1:]
            if not number and peek()[0] == "word":
                number = take()[1]
            if not number.isdigit():
                raise QueryError(f"NEAR needs a number of tokens, not {number!r}")
            most = int(number)
        expect(")")
        if not parts:
            raise QueryError("NEAR needs phrases")
        return Near(tuple(parts), most)

    def columns():
        """A column filter if one stands here, as (names, excluded), else None."""
        nonlocal place
        at, names, excluded = place, (), False
        if tokens[at] == ("sign", "-"):
            at, excluded = at + 1, True
        if tokens[at] == ("sign", "{"):
            end = at + 1
            while tokens[end][0] in ("word", "phrase"):
                end += 1
            names, at = tuple(t[1].strip('"').lower() for t in tokens[at + 1 : end]), end + 1
            if tokens[end] != ("sign", "}") or not names:
                raise QueryError("{ needs column names and }")
        elif tokens[at][0] in ("word", "phrase"):
            names, at = (tokens[at][1].strip('"').lower(),), at + 1
        if names and tokens[min(at, len(tokens) - 1)] == ("sign", ":"):
            place = at + 1
            return names, excluded
        if excluded or tokens[place] == ("sign", "{"):
            raise QueryError("missing :")
        return None

    def primary():
        if (only := columns()) is not None:
            return restricted(primary(), only)
        kind, text = peek()
        if (kind, text) == ("sign", "("):
            take()
            inner = either()
            expect(")")
            return inner
        if kind == "word" and text in ("AND", "OR", "NOT"):
            raise QueryError(f"{text} needs two sides")
        if kind == "word" and text == "NEAR" and tokens[place + 1] == ("sign", "("):
            take()
            return near()
        return phrase()

    def without():
        node = primary()
        while peek() == ("word", "NOT"):
            take()
            node = Without(node, primary())
        return node

    def both():
        node = without()
        while True:
            kind, text = peek()
            if (kind, text) == ("word", "AND"):
                take()
            elif kind not in ("word", "phrase") and text not in ("(", "{", "-") or (kind, text) == ("word", "OR"):
                return node
            node = Both(node, without())

    def either():
        node = both()
        while peek() == ("word", "OR"):
            take()
            node = Either(node, both())
        return node

    tree = either()
    if peek()[0] != "end":
        raise QueryError(f"unexpected {peek()[1]!r}")
    return tree


def escape(text: str) -> str:
    """Free text as a query: shell words, each a phrase, all required."""
    try:
        words = shlex.split(text if text.count('"') % 2 == 0 else text + '"')
    except ValueError:
        words = text.split()
    return " ".join('"' + w.replace('"', '""') + '"' for w in words)


def restricted(node, only):
    """``node`` with a column filter on all its phrases."""
    if isinstance(node, Phrase):
        return Phrase(node.text, (*node.within, only))
    if isinstance(node, Near):
        return Near(tuple(restricted(p, only) for p in node.parts), node.most)
    return type(node)(restricted(node.left, only), restricted(node.right, only))


def known_columns(node, columns: list[str]):
    """``node``, if all columns it names exist."""
    for p in phrases(node):
        for names, _ in p.within:
            if wrong := set(names) - set(columns):
                raise QueryError(f"no such columns: {sorted(wrong)}")
    return node


def phrases(node) -> list[Phrase]:
    """The phrases of a query, left to right."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.parts)
    return phrases(node.left) + phrases(node.right)


def _in_any(columns: list[str], test) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(test(c), F.lit(False))
    return found


def _has(columns: list[str], phrase: Phrase) -> Column:
    if len(phrase.text) < GRAM:
        return F.lit(False)
    return _in_any([c for c in columns if phrase.looks_into(c)], lambda c: F.contains(F.lower(F.col(c)), F.lit(phrase.folded)))


def _starts(column: str, phrase: Phrase) -> Column:
    """Where a phrase begins in a column, as positions from 1, overlapping ones too."""
    low, none = F.lower(F.col(column)), F.array().cast("array<int>")
    if len(phrase.folded) < GRAM or not phrase.looks_into(column):
        return none
    pieces = F.split(low, f"(?={re.escape(phrase.folded)})")
    done = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("next"), none.alias("found")),
        lambda acc, piece: F.struct(
            (acc["next"] + F.length(piece)).alias("next"),
            F.when(piece.startswith(phrase.folded), F.concat(acc["found"], F.array(acc["next"]))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.when(F.contains(low, F.lit(phrase.folded)), done["found"]).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def near_starts(node: Near, starts: list[Column]) -> list[Column]:
    """Of the positions of each phrase of a NEAR group in one column, those that take part in it.

    A group ends where its last phrase begins; every phrase must begin at or
    before that and end at most ``most`` tokens before it.
    """
    parts = list(enumerate(node.parts))

    def reaches(part, at, end):
        return (at <= end) & (at + part.grams + node.most >= end)

    def kept(given):
        def complete(end):
            return reduce(Column.__and__, [F.exists(given[f"s{i}"], begins(p, end)) for i, p in parts])

        return _let(F.filter(F.flatten(F.array(*[given[f"s{i}"] for i, _ in parts])), complete), lambda ends: F.array(*[F.filter(given[f"s{i}"], ends_in(p, ends)) for i, p in parts]))

    def begins(part, end):
        return lambda at: reaches(part, at, end)

    def ends_in(part, ends):
        return lambda at: F.exists(ends, lambda end: reaches(part, at, end))

    all_kept = _let(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(starts)]), kept)
    return [F.element_at(all_kept, i + 1) for i, _ in parts]


def matches(node, columns: list[str]) -> Column:
    """Whether the columns of a row, taken together, match the query."""
    if isinstance(node, Phrase):
        return _has(columns, node)
    if isinstance(node, Near):
        return _in_any(columns, lambda c: F.size(near_starts(node, [_starts(c, p) for p in node.parts])[0]) > 0)
    left, right = matches(node.left, columns), matches(node.right, columns)
    return combined(node, left, right)


def combined(node, left: Column, right: Column) -> Column:
    """The truth of AND, OR or NOT from that of its sides."""
    if isinstance(node, Both):
        return left & right
    if isinstance(node, Either):
        return left | right
    return left & ~right


def counts(node, columns: list[str]) -> list[Column]:
    """How often each phrase of a query occurs in a row; in a NEAR group only where it takes part."""
    if isinstance(node, Near):
        total = [F.lit(0)] * len(node.parts)
        for c in columns:
            kept = near_starts(node, [_starts(c, p) for p in node.parts])
            total = [t + F.coalesce(F.size(k), F.lit(0)) for t, k in zip(total, kept)]
        return total
    if isinstance(node, Phrase):
        found = F.lit(0)
        for c in columns:
            if node.looks_into(c):
                found = found + F.regexp_count(F.coalesce(F.lower(F.col(c)), F.lit("")), F.lit(f"(?={re.escape(node.folded)})"))
        return [found]
    return counts(node.left, columns) + counts(node.right, columns)


def tokens_of(columns: list[str]) -> Column:
    """Trigrams of a row's columns together."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.greatest(F.coalesce(F.length(c), F.lit(0)) - (GRAM - 1), F.lit(0))
    return total


def score(tf: list[Column], df: list[Column], size: Column, rows: Column, mean: Column) -> Column:
    """Negative BM25 from the counts of all phrases, in a row and in rows."""
    rank = F.lit(0.0)
    for n_row, n_rows in zip(tf, df):
        odds = F.ln((rows - n_rows + 0.5) / (n_rows + 0.5))
        idf = F.when(odds > 0, odds).otherwise(F.lit(1e-6))
        n_row = n_row.cast("double")
        rank = rank - idf * n_row * (K1 + 1) / (n_row + K1 * (1 - B + B * size / mean))
    return rank


def bm25(corpus: DataFrame, node, searched: list[str], indexed: list[str] | None = None) -> DataFrame:
    """``corpus`` rows that match, with ``rank``: negative BM25, smaller is better.

    Corpus statistics (rows, mean length, rows per phrase) are one aggregate of
    one row, computed in the same plan. ``indexed`` are all columns of the
    index, which count for lengths; ``searched`` those the query looks into.
    """
    all_columns = indexed or searched
    node = known_columns(node, all_columns)
    pairs = [(p, n) for p, n in zip(phrases(node), counts(node, searched)) if len(p.text) >= GRAM]
    stats = corpus.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(tokens_of(all_columns)).alias("_tokens"),
        *[F.sum(_has(searched, p).cast("long")).alias(f"_df{i}") for i, (p, _) in enumerate(pairs)],
    )
    hits = corpus.where(matches(node, searched)).crossJoin(F.broadcast(stats))  # statistics are one row
    df = [F.col(f"_df{i}") for i in range(len(pairs))]
    rank = score([n for _, n in pairs], df, tokens_of(all_columns), F.col("_rows"), F.col("_tokens") / F.col("_rows"))
    return hits.withColumn("rank", rank).drop("_rows", "_tokens", *[f"_df{i}" for i in range(len(pairs))])


def snippet(column: Column, node, most: int = 30, start: str = "<b>", end: str = "</b>", ellipsis: str = "...") -> Column:
    """The stretch of about ``most`` trigrams around the first hit, all hits in it marked."""
    terms = [p for p in phrases(node) if len(p.text) >= GRAM]
    if not terms:
        return F.lit(None).cast("string")
    low = F.lower(column)
    first = F.lit(None).cast("int")
    for p in reversed(terms):
        at = F.instr(low, p.folded)
        first = F.least(first, F.when(at > 0, at))
    width = most + GRAM - 1
    begin = F.greatest(F.lit(1), F.least(first - (most // 2 - 1), F.length(column) - (width - 1)))
    piece = F.substring(column, begin, F.lit(width))
    marked = piece
    pattern = "(?i)(" + "|".join(sorted({re.escape(p.text) for p in terms}, key=len, reverse=True)) + ")"
    safe = lambda tag: re.sub(r"([\\$])", r"\\\1", tag)
    marked = F.regexp_replace(marked, pattern, f"{safe(start)}$1{safe(end)}")
    return F.concat(F.when(begin > 1, ellipsis).otherwise(""), marked, F.when(begin + width - 1 < F.length(column), ellipsis).otherwise(""))


def prefix_terms(column: Column, query: str) -> Column:
    """Word-wise prefix match (names of boards): every term starts some word."""
    words = F.split(F.lower(column), r"[^\p{L}\p{N}]+")
    found = F.lit(True)
    for term in re.findall(r"[^\W_]+", query.lower()):
        found = found & F.exists(words, _starting(term))
    return found


def _starting(term: str):
    return lambda word: word.startswith(term)
