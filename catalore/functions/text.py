"""Text predicates with the engine's exact matching rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def like(column: Column, pattern: str) -> Column:
    """Case-sensitive LIKE without an escape character: ``%`` and ``_`` are live, a backslash is itself."""
    return column.like(pattern.replace("\\", "\\\\"))


def prefix_upper_bound(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None where there is none."""
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            step = last + 1
            # surrogates are no characters
            return "".join(map(chr, points)) + chr(0xE000 if 0xD800 <= step <= 0xDFFF else step)
    return None


def starts_in(column: Column, prefix: str) -> Column:
    """Literal prefix match as a range, which reaches the parquet reader."""
    upper = prefix_upper_bound(prefix)
    return (column >= prefix) & (column < upper) if upper is not None else column >= prefix


def escape_like(text: str) -> str:
    """``text`` as a literal for LIKE with the escape character backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def hex_prefix(column: Column, prefix: str) -> Column:
    """Hash column starts with a hex prefix of any case; what isn't hex matches nothing."""
    if not re.fullmatch(r"[0-9a-fA-F]+", prefix):
        return F.lit(False)
    return column.startswith(prefix.lower())


def mime_class(column: Column) -> Column:
    """``image/`` of ``image/png``."""
    return F.concat(F.split_part(column, F.lit("/"), F.lit(1)), F.lit("/"))


def first_segment(column: Column) -> Column:
    """What stands before the first ``:``."""
    return F.split_part(column, F.lit(":"), F.lit(1))


def rounded(column: Column) -> Column:
    """A confidence as stored: four decimals, halves away from zero."""
    return F.round(column * 10000, 0) / 10000
