"""What a result view does with hits: scope, excludes, rules, caps per name, order, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..plans import front


@dataclass(frozen=True)
class Rule:
    pattern: str
    include: bool
    windows_own: bool = True


def rule_from_url(url: str, include: bool, windows_own: bool = True) -> Rule | None:
    r"""A rule from file:///C:\[volume]\folder\: lower case, without the bracketed volume, ending in a separator; None for
    any other kind of URL."""
    if not url.startswith("file:///"):
        return None
    pattern = re.sub(r"\[[^\]]*\]\\?", "", url.removeprefix("file:///").lower(), count=1)
    return Rule(pattern if pattern.endswith("\\") else pattern + "\\", include, windows_own)


def rule_regex(pattern: str) -> str:
    """What lies under a rule's folder: * stands for any run inside one component."""
    return r"\A" + r"[^\\]*".join(re.sub(r"([^0-9a-zA-Z\x80-\U0010ffff])", r"\\\1", part) for part in pattern.split("*"))


def rule_verdict(path: Column, rules: list[Rule], windows_only: bool = False) -> Column:
    """include of the longest rule that covers the path (the last of equally long ones), null where none does."""
    hay = F.concat(path, F.when(path.endswith("\\"), F.lit("")).otherwise(F.lit("\\")))
    out = F.lit(None).cast("boolean")
    ordered = sorted((r for r in rules if r.windows_own or not windows_only), key=lambda r: len(r.pattern.encode()))
    for r in ordered:  # the last one applied is tested first
        out = F.when(hay.rlike(rule_regex(r.pattern)), F.lit(r.include)).otherwise(out)
    return out


def within_scope(path: Column, scope: str) -> Column:
    """The folder itself or anything under it; an empty scope holds everything. Both in one case."""
    if not scope:
        return F.lit(True)
    return (path == F.lit(scope)) | path.startswith(F.lit(scope + "\\")) | path.startswith(F.lit(scope + "/"))


def without_excludes(path: Column, excludes: list[str]) -> Column:
    out = F.lit(True)
    for e in excludes:
        out = out & ~path.contains(F.lit(e))
    return out


def cap_per_name(hits: DataFrame, most: int, order: str = "rank_pos") -> DataFrame:
    """The first `most` rows of every name (last component, lower case); the group limit prunes before the shuffle."""
    w = W.partitionBy(X.leaf(F.lower("path"))).orderBy(order)
    return hits.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def near_first(hits: DataFrame, n: int, order: str = "rank_pos") -> DataFrame:
    """The n hits with the fewest separators, in their old order where equal."""
    return hits.withColumn("separators", X.separators(F.col("path"))).orderBy("separators", order).limit(n)


def folders_then_newest(hits: DataFrame, order: str = "rank_pos") -> list[Column]:
    """Sort columns of a finished list: folders, then newest; unknown times last; old order where equal."""
    return [F.col("is_dir").desc(), F.col("mtime").desc_nulls_last(), F.col(order)]


def page_of(hits: DataFrame, total: int, term: str, scope: str = "", excludes: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Rows a view shows of ranked hits (path, is_dir, mtime, rank_pos): filtered by scope, excludes and rules, at most
    three of a name where `total` makes it a sample, near ones first where it is wide, cut to the page, ordered.

    Filters come before the cut, so a page fills whatever they drop.
    """
    lower = F.lower("path")
    rows = hits.where(within_scope(lower, scope) & without_excludes(lower, excludes or []))
    if rules:
        rows = rows.where(F.coalesce(rule_verdict(lower, rules), F.lit(True)))
    if total > front.SAMPLED_ABOVE:
        rows = cap_per_name(rows, front.PER_NAME)
    n = front.rows_to_show(term)
    rows = near_first(rows, n) if total > front.WIDE_ABOVE else rows.orderBy("rank_pos").limit(n)
    return numbered(rows, folders_then_newest(rows))


def numbered(page: DataFrame, order: list[Column]) -> DataFrame:
    """A page with row_no from 1. A page is bounded, so one task may number it."""
    return page.withColumn("row_no", F.row_number().over(W.orderBy(*order)))


def fetch_rows(page: DataFrame, start: int, count: int) -> DataFrame:
    """Rows start .. start+count-1 (1-based); a negative count reads backwards from start; reads past an end are short."""
    low, high = (start, start + count - 1) if count >= 0 else (start + count + 1, start)
    return page.where(F.col("row_no").between(low, high))


def row_properties(page: DataFrame) -> DataFrame:
    """What a view shows of each row of a page (path, is_dir, size_bytes, mtime, attributes, row_no)."""
    leaf = X.leaf(F.col("path"))
    ext = F.regexp_extract(leaf, r"(?s)(\.[^.]*)\z", 1)
    return page.select(
        F.col("path").alias("parsing_path"), F.col("path").alias("item_id"), leaf.alias("item_name"), F.col("path").alias("path_display"), X.folder(F.col("path")).alias("folder_display"), F.col("row_no").alias("row_id"),
        F.greatest(F.lit(1_000_000) - F.col("row_no"), F.lit(0)).alias("rank"), F.coalesce("attributes", F.when(F.col("is_dir"), 16).otherwise(128)).alias("attributes"),
        F.when(F.col("is_dir"), "Directory").otherwise(ext).alias("item_type"), F.when(F.col("is_dir"), "folder").alias("kind"), F.when(~F.col("is_dir"), F.col("size_bytes")).alias("size"), F.col("mtime").alias("date_modified"),
    )
