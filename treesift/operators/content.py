"""Search inside texts, line by line."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..plans.conditions import java_pattern, java_valid

BLOCK = 1 << 16
#: Bits that an index has for each distinct gram of a text: one in five or so is set.
GRAM_BITS = 4
#: Characters that are read into grams at a time (about 100 bytes each).
GRAM_CHARS = 1 << 18


def line_filter(df: DataFrame, pattern: str, insensitive: bool) -> str:
    """The pattern in Java's dialect; a pattern that can't be read raises, as a search inside files has no literal form."""
    if not java_valid(df.sparkSession)(pattern, insensitive):
        raise ValueError(f"not a pattern: {pattern}")
    return java_pattern(pattern, insensitive)


def in_scopes(path: Column, root: str, scopes: list[str]) -> Column:
    """Whether a path relative to `root` lies in one of the scopes; the root itself is no limit, a scope outside an error."""
    out, base = F.lit(False), root.rstrip("/\\")
    for s in scopes:
        s = s.rstrip("/\\")
        if s == base:
            return F.lit(True)
        if not s.startswith((base + "/", base + "\\")):
            raise ValueError(f"{s} is outside {root}")
        part = s[len(base) + 1 :]
        out = out | (path == part) | path.startswith(part + "\\") | path.startswith(part + "/")
    return out if scopes else F.lit(True)


def grep(texts: DataFrame, pattern: str, insensitive: bool = True, root: str = "", scopes: list[str] | None = None) -> DataFrame:
    """(rel_path, line_number, text): lines of `texts` (rel_path, text[, is_binary]) that match, trailing \\r removed.

    A text is tested as a whole before it is split, so that texts without a match never explode (but for patterns with
    anchors, which mean another thing there). Binary and null texts are skipped; a newline at
    the end makes no extra line.
    """
    java = line_filter(texts, pattern, insensitive)
    rows = texts.where(F.col("text").isNotNull())
    if "is_binary" in texts.columns:
        rows = rows.where(~F.coalesce("is_binary", F.lit(False)))
    if scopes:
        rows = rows.where(in_scopes(F.col("rel_path"), root, scopes))
    if not re.search(r"[$^]|\\[AzZG]", pattern):
        rows = rows.where(F.col("text").rlike(java))
    body = F.regexp_replace("text", r"\n\z", "")
    lines = rows.select("rel_path", F.posexplode(F.split(body, "\n")).alias("i", "line")).where(F.col("line").rlike(java))
    return lines.select("rel_path", (F.col("i") + 1).alias("line_number"), F.regexp_replace("line", r"\r+\z", "").alias("text"))


def file_counts(hits: DataFrame) -> DataFrame:
    """(rel_path, lines) of the texts with a match."""
    return hits.groupBy("rel_path").agg(F.count(F.lit(1)).alias("lines"))


def _gram_hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """31 bits for every three code points (uint64)."""
    key = a | b << np.uint64(21) | c << np.uint64(42)
    key = (key ^ key >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((key ^ key >> np.uint64(32)) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the words of its bits: one bit is set for each gram, GRAM_BITS bits are there for each distinct gram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = _code_points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-2] == owner[2:]
    grams, owner = _gram_hashes(chars[:-2], chars[1:-1], chars[2:])[inside], owner[:-2][inside]
    room = 8 * sizes + 1  # so roomy that few grams meet: how many are distinct
    start = np.cumsum(room) - room
    seen = np.zeros(room.sum(), bool)
    seen[start[owner] + grams % room[owner]] = True
    words = np.add.reduceat(seen, start, dtype=np.int64) * GRAM_BITS // 64 + 1
    first = np.cumsum(words) - words
    bits = np.zeros(64 * words.sum(), bool)
    bits[64 * first[owner] + grams % (64 * words[owner])] = True
    return np.split(np.packbits(bits, bitorder="little").view("<i8"), first[1:])


def _gram_series(texts: pd.Series) -> pd.Series:
    out: list[np.ndarray] = []
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= GRAM_CHARS:
            out += _gram_sets(part)
            part, held = [], 0
    return pd.Series(out + _gram_sets(part) if part else out, dtype=object)


def _grams(texts: DataFrame) -> Column:
    runtime.ship_package(texts.sparkSession)
    made = F.pandas_udf(_gram_series, "array<long>").asNondeterministic()  # else a search's filter has it run before a refresh's join
    return made(F.lower("text")).alias("grams")


def trigram_index(texts: DataFrame) -> DataFrame:
    """(rel_path, grams array<long>): an index for searches of literals, one row a text. `grams` is a set of bits that has one
    for every three characters, lower case, that the text holds (see _gram_sets); several may share a bit, so a
    search confirms what it finds. It is about as large as the compressed text, and making it shuffles nothing."""
    return texts.where(F.col("text").isNotNull()).select("rel_path", _grams(texts))


def sealed_index(texts: DataFrame) -> DataFrame:
    """(rel_path, seal, grams): trigram_index with a hash of the text that each row was made of, to be kept and refreshed."""
    return texts.where(F.col("text").isNotNull()).select("rel_path", F.xxhash64("text").alias("seal"), _grams(texts))


def refresh_index(index: DataFrame, texts: DataFrame) -> DataFrame:
    """`index` (see sealed_index) as of `texts`: rows of texts that are gone or have changed are dropped, and only new and
    changed texts are read into grams."""
    now = texts.where(F.col("text").isNotNull()).select("rel_path", "text", F.xxhash64("text").alias("seal"))
    kept = index.join(now.select("rel_path", "seal"), ["rel_path", "seal"], "left_semi")
    changed = now.join(index.select("rel_path", "seal"), ["rel_path", "seal"], "left_anti")
    return kept.select("rel_path", "seal", "grams").unionByName(sealed_index(changed))


def may_hold(grams: Column, literal: str) -> Column:
    """Whether a set of grams (see trigram_index) has all of those of `literal`, which is in lower case."""
    chars = _code_points(literal)
    wanted = sorted({int(g) for g in _gram_hashes(chars[:-2], chars[1:-1], chars[2:])})
    bits = F.size(grams) * 64

    def there(gram: Column) -> Column:
        at = (gram % bits).cast("int")
        return F.getbit(F.get(grams, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1

    return F.forall(F.lit(wanted), there) if wanted else F.lit(True)


def grep_indexed(texts: DataFrame, index: DataFrame, literal: str, insensitive: bool = True) -> DataFrame:
    """grep for a literal with the index's candidates only; the same answer as without, since candidates are confirmed."""
    low = literal.lower()
    rows = texts
    if len(low) >= 3:
        rows = texts.join(index.where(may_hold(F.col("grams"), low)).select("rel_path"), "rel_path", "left_semi")
    return grep(rows, re.escape(literal), insensitive)
