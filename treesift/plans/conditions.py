"""From the tree of a query to one boolean Column, and which extra columns it needs."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold_needle
from .syntax import U64, All, And, Ext, Flag, HasChild, Match, Not, Number, Or, Query, Regex, parse

LONG_MAX = (1 << 63) - 1
_WORD_CHAR = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"
_COLUMNS = {"len": "name_chars", "parents": "depth", "size": "size_bytes", "childcount": "child_n", "childfilecount": "child_files", "childfoldercount": "child_folders"}


def java_pattern(text: str, insensitive: bool) -> str | None:
    """The pattern in Java's dialect, or None where it uses what a linear-time engine has not (look-around, references).

    Classes and case are Unicode's, a dot stops at newlines only, and $ means the very end.
    """
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|\(\?P[=>]", text):
        return None
    out, in_class, i = [], 0, 0
    multiline = re.search(r"\(\?[a-zA-Z]*m", text) is not None
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        in_class += (c == "[") - (c == "]" and in_class > 0)
        if text.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        out.append(r"\z" if c == "$" and not in_class and not multiline else c)
        i += 1
    return ("(?iuUd)" if insensitive else "(?Ud)") + "".join(out)


def java_valid(spark: SparkSession):
    """A test of patterns by Java's engine, so that a bad one becomes a literal instead of failing at run time."""

    def valid(text: str, insensitive: bool) -> bool:
        pattern = java_pattern(text, insensitive)
        if pattern is None:
            return False
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # noqa: BLE001 - whatever Java has against it
            return False
        return True

    return valid


def parse_for(spark: SparkSession, text: str) -> Query:
    return parse(text, java_valid(spark))


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", text)


def _shape(hay: Column, shape: str, needle: str) -> Column:
    if shape == "whole":
        return hay == F.lit(needle)
    if shape == "prefix":
        return hay.startswith(F.lit(needle))
    if shape == "suffix":
        return hay.endswith(F.lit(needle))
    if shape == "word":
        return hay.rlike(f"(?<!{_WORD_CHAR}){_quote(needle)}(?!{_WORD_CHAR})")
    if shape == "glob":
        body = "".join(".*" if p == "*" else "." if p == "?" else _quote(p) for p in re.split(r"([*?])", needle))
        return hay.rlike(rf"(?s)\A{body}\z")
    return hay.contains(F.lit(needle))


def _between(column: Column, low: int, high: int) -> Column:
    if low > high or low > LONG_MAX:
        return F.lit(False)
    if high >= LONG_MAX:
        return column >= F.lit(low).cast("long")
    return column.between(F.lit(low).cast("long"), F.lit(high).cast("long"))


def leaves(tree) -> list:
    if isinstance(tree, (And, Or)):
        return [x for p in tree.parts for x in leaves(p)]
    return leaves(tree.part) if isinstance(tree, Not) else [tree]


def needs(tree) -> set[str]:
    """Which side tables the tree needs: children, dupe, and (child, text) for every child: condition."""
    out: set = set()
    for x in leaves(tree):
        if x == Flag("empty") or isinstance(x, Number) and x.measure.startswith("child"):
            out.add("children")
        elif x == Flag("dupe"):
            out.add("dupe")
        elif isinstance(x, HasChild):
            out.add(("child", x.text))
    return out


def _cost(tree) -> tuple:
    """Cheap and selective conditions first: generated code stops at the first that fails."""
    if isinstance(tree, Not):
        return (_cost(tree.part)[0] + 3, 0)
    if isinstance(tree, (And, Or)):
        return (max(_cost(p)[0] for p in tree.parts), 0)
    if isinstance(tree, Match):
        slow = tree.shape in ("word", "glob")
        return (2 + 2 * slow + (tree.field == "path"), -len(tree.text))
    return (5, 0) if isinstance(tree, Regex) else (1, 0) if isinstance(tree, Ext) else (0, 0)


def condition(tree, case_sensitive: bool = False) -> Column:
    """The tree as a Column over the entries of a Volume with the side columns that needs() names; never null."""
    again = lambda t: condition(t, case_sensitive)
    if isinstance(tree, All):
        return F.lit(True)
    if isinstance(tree, Not):
        return ~again(tree.part)
    if isinstance(tree, (And, Or)):
        parts = [again(p) for p in (sorted(tree.parts, key=_cost) if isinstance(tree, And) else tree.parts)]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(tree, And) else out | p
        return out
    if isinstance(tree, Match):
        raw = tree.case is True or (tree.case is None and case_sensitive and tree.field == "name")
        hay = F.col(tree.field if raw else f"{tree.field}_fold")
        return _shape(hay, tree.shape, tree.text if raw else fold_needle(tree.text))
    if isinstance(tree, Regex):
        return F.col("path" if tree.over_path else "name").rlike(java_pattern(tree.text, tree.insensitive))
    if isinstance(tree, Ext):
        return F.col("ext").isin(list(tree.names)) & (F.col("ext") != "")
    if isinstance(tree, Number):
        return _between(F.col(_COLUMNS[tree.measure]), tree.low, min(tree.high, U64))
    if isinstance(tree, HasChild):
        return F.col(child_column(tree.text))
    return {
        "kind_file": ~F.col("is_dir"), "kind_folder": F.col("is_dir"), "attrib_d": F.col("is_dir"), "attrib_l": F.col("is_reparse"),
        "root": F.col("at_root"), "dupe": F.col("is_dupe"), "empty": F.when(F.col("is_dir"), F.col("child_n") == 0).otherwise(F.col("clusters") == 0) if tree == Flag("empty") else F.lit(True),
    }[tree.name]


def child_column(text: str) -> str:
    return "has_child_" + text.encode("utf-8", "surrogatepass").hex()
