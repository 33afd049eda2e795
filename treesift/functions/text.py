"""Scalar functions over paths, sizes and numbers: as Columns where rows need them, as Python where only a caller does."""

from __future__ import annotations

import math
import ntpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def leaf(path: Column) -> Column:
    """What follows the last separator of either kind."""
    return F.regexp_extract(path, r"(?s)([^\\/]*)\z", 1)


def folder(path: Column) -> Column:
    """What precedes the last separator; empty without one."""
    return F.regexp_extract(path, r"(?s)\A(.*)[\\/][^\\/]*\z", 1)


def separators(path: Column) -> Column:
    """How many separators of either kind."""
    return F.length(path) - F.length(F.translate(path, "\\/", ""))


def extension(name_fold: Column) -> Column:
    """After the last dot of a folded name; empty where there is none or nothing follows it."""
    return F.regexp_extract(name_fold, r"(?s)\.([^.]+)\z", 1)


def path_length(path: Column) -> Column:
    """Bytes of the path plus one, the length that ranking uses."""
    return F.octet_length(path) + 1


def human_size(size: Column) -> Column:
    """1024-based size with one decimal (halves to even), B to PiB."""
    shown = lambda i: F.format_string(f"%.1f {_UNITS[i]}", F.bround(size / F.lit(float(1024**i)), 1))
    out = shown(len(_UNITS) - 1)
    for i in range(len(_UNITS) - 2, -1, -1):
        out = F.when(size < 1024 ** (i + 1), shown(i)).otherwise(out)
    return out


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def share_percent(part: Column, whole: Column) -> Column:
    """Part of a whole in percent, 0 where the whole is not positive."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def human_seconds(seconds: int) -> str:
    minutes, s = divmod(seconds, 60)
    h, m = divmod(minutes, 60)
    return " ".join(f"{v}{u}" for v, u, shown in ((h, "h", h), (m, "m", h or m), (s, "s", True)) if shown)


def nearest_rank(ordered: list, share: float):
    """The value at floor(n * share), at most the last; None for an empty list."""
    return ordered[min(len(ordered) - 1, math.floor(len(ordered) * share))] if ordered else None


_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")


def percent_decode(text: str) -> str:
    """Decode %XX; anything else after a % stays as written, and bytes that are no UTF-8 become U+FFFD."""
    raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogatepass"))
    return raw.decode("utf-8", "replace")


def percent_decode_column(text: Column) -> Column:
    """percent_decode in Arrow batches; a null stays null."""
    return F.pandas_udf(lambda s: s.map(percent_decode, na_action="ignore").astype(object) if len(s) else pd.Series([], dtype=object), "string")(text)


def _cells(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def elide_from(path: str, width: int, mark: int = 1) -> int:
    """Where a path shown in `width` cells starts: whole folders go, nearest the root first, until the rest fits beside a
    mark of `mark` cells; where not even the name fits, it starts at the last separator."""
    if _cells(path) <= width:
        return 0
    cuts = [i for i, c in enumerate(path) if c == "\\"]
    return next((i for i in cuts if _cells(path[i:]) <= max(0, width - mark)), cuts[-1] if cuts else 0)


def absolute_argument(path: str, here: str) -> str:
    """A relative path put under `here`; empty ones, network paths and those that name a drive stay as they are."""
    if not path or re.match(r"[A-Za-z]:|\\\\|//", path):
        return path
    return ntpath.normpath(ntpath.join(here, path))
