"""Where the words of a query stand in the name at the end of a path."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import runtime
from ..plans.syntax import parse
from .fold import fold_needle


def name_spans(path: str, word: str) -> list[tuple[int, int]]:
    """Character spans of the word in the part of `path` after its last separator, without overlaps.

    Folding may change a character's length, so every folded character remembers its source: a match that covers part of
    an expansion spans the whole source character.
    """
    needle = fold_needle(word)
    if not needle:
        return []
    start = max(path.rfind("\\"), path.rfind("/")) + 1
    source = [i for i in range(start, len(path)) for _ in path[i].lower()]
    folded = "".join(c.lower() for c in path[start:])
    return [(source[m.start()], source[m.end() - 1] + 1) for m in re.finditer(re.escape(needle), folded)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def query_spans(path: str, words: list[str]) -> list[tuple[int, int]]:
    """Spans of all positive words of a query."""
    found = [s for w in words for s in name_spans(path, w)]
    return merge_spans(found) if len(words) > 1 else found


def spans_column(path: Column, query: str) -> Column:
    """array<struct<start,end>> for the words of `query`, in Arrow batches; a null path has null spans."""
    from pyspark.sql import SparkSession

    runtime.ship_package(SparkSession.getActiveSession())
    words = list(parse(query).words)

    def spans(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: [{"start": a, "end": b} for a, b in query_spans(p, words)], na_action="ignore")

    return F.pandas_udf(spans, "array<struct<start:int,end:int>>")(path)
