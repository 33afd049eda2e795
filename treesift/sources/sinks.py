"""Where results go: one path per line, or a listing with a head and a note of what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.highlight import query_spans
from ..operators.content import line_filter


def write_paths(hits: DataFrame, folder: str) -> None:
    """One path per line as text files below `folder`, in the order of rank_pos if there is one."""
    ordered = hits.orderBy("rank_pos") if "rank_pos" in hits.columns else hits
    ordered.select("path").write.mode("overwrite").text(folder)


def listing(page: DataFrame, total: int, words: list[str] | None = None, mark: tuple[str, str] = ("[", "]")) -> str:
    """A page (path, is_dir, rank_pos) for a terminal: total, paths with the words marked, how many more there are."""
    rows = page.orderBy("rank_pos").select("path", "is_dir").collect()  # a page is bounded by its request
    lines = [f"{total:,} result{'s' if total != 1 else ''}"]
    for r in rows:
        text, at, out = r["path"], 0, ""
        for a, b in query_spans(text, words or []):
            out, at = out + text[at:a] + mark[0] + text[a:b] + mark[1], b
        lines.append(out + text[at:] + ("\\" if r["is_dir"] else ""))
    if total > len(rows):
        lines.append(f"... and {total - len(rows):,} more")
    return "\n".join(lines)


def grouped_lines(hits: DataFrame, pattern: str | None = None, insensitive: bool = True, mark: tuple[str, str] = ("[", "]")) -> DataFrame:
    """(rel_path, lines): matching lines of each text with their numbers right-aligned, ready to print; with the pattern, its
    matches are marked."""
    width = F.length(F.max("line_number").cast("string"))
    if pattern is not None:
        java = line_filter(hits, pattern, insensitive)
        hits = hits.withColumn("text", F.regexp_replace("text", java, f"{mark[0]}$0{mark[1]}"))
    rows = hits.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("line_number", "text"))).alias("m"), width.alias("w"))
    return rows.select("rel_path", F.transform("m", lambda x: F.concat(F.lpad(x["line_number"].cast("string"), F.col("w"), F.lit(" ")), F.lit(": "), x["text"])).alias("lines"))
