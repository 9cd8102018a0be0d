"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without blanks at either end, Unicode blanks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def snippet(c: Column, prefix: str = "", limit: int = 200) -> Column:
    """Collapsed text, cut at limit with an ellipsis."""
    # bound by a lambda, so that the text is collapsed once a row
    cut = F.get(F.transform(F.array(collapse(c)), lambda t: F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…"))).otherwise(t)), F.lit(0))
    return F.concat(F.lit(prefix), cut) if prefix else cut


def timestamp_label(ms: Column) -> Column:
    """Milliseconds as M:SS."""
    s = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000).cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def visual_snippet(ms: Column, album_index: Column) -> Column:
    """The reason shown for a frame that matched."""
    return F.when(album_index.isNotNull(), F.concat(F.lit("Visual match: photo "), (album_index + 1).cast("string"))).otherwise(F.concat(F.lit("Visual match near "), timestamp_label(ms)))


def last_index(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 where there is none."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(F.lit(-1))


def lead_summary(c: Column, limit: int = 2000) -> Column:
    """The text up to limit characters, cut behind a sentence where one ends in the second
    half (kinds of ends in a fixed order), else before a word with an ellipsis."""
    t = strip(c)
    cut = F.substring(t, 1, limit)
    out = F.when(F.length(t) <= limit, t)
    for end in (". ", "! ", "? ", "\n"):
        at = last_index(cut, end)
        out = out.when(at > limit * 0.5, strip(F.substring(cut, F.lit(1), (at + 1).cast("int"))))
    blank = last_index(cut, " ")
    return out.otherwise(F.concat(strip(F.when(blank > 0, F.substring(cut, F.lit(1), blank.cast("int"))).otherwise(cut)), F.lit("…")))


def slug(c: Column, sep: str = "-", fallback: str = "category", limit: int | None = None) -> Column:
    """X11: lower case, other than letters and digits as sep, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    s = F.substring(s, 1, limit) if limit else s
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))
