"""Problem 8: oversized texts cut at natural boundaries.

Content-defined chunking: a rolling hash over the bytes marks landmarks, a
landmark snaps to the nearest natural boundary (paragraph, line, sentence, then
word) between a least and a greatest size, and each piece repeats the last
tokens of the one before. Boundaries depend on nearby text only, so an edit
changes the pieces around it and the others come out the same.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from catalore.llm.tokens import TOKENIZER, encoding

LIMIT, OVERLAP = 2000, 100
#: A landmark every 2^LANDMARK_BITS bytes on average, from the last WINDOW bytes.
LANDMARK_BITS, WINDOW = 12, 32
#: Tokens left free for a count that shifts where a piece is cut.
SPARE = 24

_BOUNDARY = re.compile(r"(\n[^\S\n]*\n\s*)|(\n\s*)|((?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？]))|(\s+)")
_GEAR = np.random.default_rng(20260630).integers(0, 2**63, 256, dtype=np.uint64)


def landmarks(data: bytes) -> np.ndarray:
    """Byte positions whose rolling hash over the bytes before them ends in zeros."""
    raw = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = np.zeros(len(raw), dtype=np.uint64)
    for back in range(min(WINDOW, len(raw))):
        h[back:] += raw[: len(raw) - back] << np.uint64(back)
    return np.flatnonzero((h >> np.uint64(WINDOW - LANDMARK_BITS)) & np.uint64((1 << LANDMARK_BITS) - 1) == 0) + 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(character positions, strengths 1 word to 4 paragraph) of natural boundaries inside ``text``."""
    at, strength = [], []
    for m in _BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            strength.append(4 if m[1] is not None else 3 if m[2] is not None else 2 if m[3] is not None else 1)
    return np.asarray(at, dtype=np.int64), np.asarray(strength, dtype=np.int64)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER) -> list[tuple[int, int, int, int]]:
    """(start, new, end, tokens) of the pieces in characters; [start, new) repeats the piece before.

    A text within the limit is one piece, an empty one none.
    """
    encode = encoding(tokenizer)
    tokens = encode.encode_ordinary(text)
    if not tokens:
        return []
    if len(tokens) <= limit:
        return [(0, 0, len(text), len(tokens))]
    data = text.encode()
    token_ends = np.cumsum([len(b) for b in encode.decode_tokens_bytes(tokens)])
    char_bytes = np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80), len(data))
    spots, strengths = boundaries(text)
    marks = np.searchsorted(char_bytes, landmarks(data))
    tokens_at = np.searchsorted(token_ends, char_bytes, side="right")  # whole tokens before each character
    most, least = limit - overlap - SPARE, (limit - overlap) // 4

    def char_after(count: int) -> int:
        """The last character before which there are at most ``count`` tokens."""
        return int(np.searchsorted(tokens_at, count, side="right")) - 1

    out, new = [], 0
    while new < len(text):
        if len(tokens) - tokens_at[new] <= most:
            end = len(text)
        else:
            low, high = max(char_after(int(tokens_at[new]) + least), new + 1), max(char_after(int(tokens_at[new]) + most), new + 1)
            near = slice(np.searchsorted(spots, low), np.searchsorted(spots, high, side="right"))
            own, weight = spots[near], strengths[near]
            mark = marks[(marks >= low) & (marks <= high)][:1]
            if not len(own):
                end = int(mark[0]) if len(mark) else high
            elif not len(mark):
                # no landmark: the last of the strongest boundaries
                best = weight.max()
                end = int(own[np.flatnonzero(weight == best)[-1]])
            else:
                # a sentence's end or better within a quarter of the range, else any boundary
                good = own[weight >= 2]
                close = good[np.abs(good - mark[0]) <= (high - low) // 4]
                pool = close if len(close) else own
                end = int(pool[np.argmin(np.abs(pool - mark[0]))])
        start = new
        if new and overlap:
            start = char_after(max(int(tokens_at[new]) - overlap, 0))
            # back to the start of a word, if one is near
            at = int(np.searchsorted(spots, start, side="right")) - 1
            if at >= 0 and tokens_at[start] - tokens_at[spots[at]] <= SPARE // 2 and (not out or spots[at] > out[-1][1]):
                start = int(spots[at])
        n = len(encode.encode_ordinary(text[start:end]))
        while n > limit and start < new:
            start = min(new, char_after(int(tokens_at[start]) + n - limit) + 1)
            n = len(encode.encode_ordinary(text[start:end]))
        while n > limit:
            end = max(new + 1, end - max(1, (end - new) // 50))
            n = len(encode.encode_ordinary(text[start:end]))
        out.append((start, new, end, n))
        new = end
    return out


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, new, end, n_tokens, text) of every text over the limit, pieces counted from 0.

    Offsets count characters. Null, empty and fitting texts have no rows. A
    token is a byte at least, so a text of at most ``limit`` bytes fits without
    being tokenized.
    """
    long = documents.where(F.octet_length("text") > limit).select("doc_id", "text")

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = cut(text, limit, overlap, tokenizer)
                if len(found) > 1:
                    rows += [(doc, i, *f, text[f[0] : f[2]]) for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "new", "end", "n_tokens", "text"])

    return long.mapInPandas(run, "doc_id long, piece long, start long, new long, end long, n_tokens long, text string")


def p8_found(documents: DataFrame) -> DataFrame:
    """Documents that had to be cut."""
    return pieces(documents).where("piece = 0").select("doc_id")


def p8_pieces(documents: DataFrame) -> DataFrame:
    """Pieces of at most 2,000 tokens with an overlap of about 100."""
    return pieces(documents)


def p8_bounds(documents: DataFrame) -> DataFrame:
    """(documents, over, gaps, bare): what must hold of all pieces, counted over all cut texts.

    ``over`` counts pieces beyond the limit, ``gaps`` texts whose pieces do not
    cover them character for character, ``bare`` pieces but the first that
    repeat nothing.
    """
    whole = documents.where(F.octet_length("text") > LIMIT).select("doc_id", F.length("text").alias("length"))
    each = pieces(documents).groupBy("doc_id").agg(
        F.sum((F.col("n_tokens") > LIMIT).cast("long")).alias("over"),
        F.sum(((F.col("piece") > 0) & (F.col("start") >= F.col("new"))).cast("long")).alias("bare"),
        F.sum(F.col("end") - F.col("new")).alias("covered"),
        F.sum((F.length("text") != F.col("end") - F.col("start")).cast("long")).alias("wrong"),
    )
    gap = (F.col("covered") != F.col("length")) | (F.col("wrong") > 0)
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("over", F.col("over")), ("gaps", gap.cast("long")), ("bare", F.col("bare")))]
    return each.join(whole, "doc_id").agg(F.count(F.lit(1)).alias("documents"), *totals)
