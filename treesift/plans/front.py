"""What a caller hands over before a query is parsed: arguments, scopes, excludes, shell conditions and URLs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import percent_decode

# Caps of requests and pages.
MAX_SEARCH_ROWS, MAX_USAGE_ROWS, MAX_USAGE_DEPTH = 100_000, 10_000, 64
PAGE_ROWS, FETCH_ROWS, RESERVE_ROWS = 5_000, 30_000, 3_000
SAMPLED_ABOVE, WIDE_ABOVE, PER_NAME = 500_000, 1_000, 3


def join_arguments(args: list[str]) -> str | None:
    """The query typed as arguments; None (no query at all) differs from an empty one."""
    return " ".join(args) if args else None


def parse_excludes(text: str) -> list[str]:
    """Fragments of an excludes file: one per line, trimmed; blank lines, # comments and a byte-order mark don't count."""
    lines = (line.strip() for line in re.split(r"\r?\n", text.removeprefix("﻿")))
    return [line for line in lines if line and not line.startswith("#")]


def compose_excludes(query: str, excludes: list[str]) -> str:
    """The query as a group, so that a trailing operator can't reach the excludes, followed by one !path: for each."""
    suffix = " ".join(f'!path:"{e}"' for e in excludes)
    return query if not suffix else suffix if not query.strip() else f"<{query}> {suffix}"


def seed_scope(folder: str, query: str | None = None) -> str:
    """`path:FOLDER query`, quoted only where the folder has a space; the root of a drive is no scope."""
    folder = folder.rstrip('"').rstrip("\\")
    if not folder or re.fullmatch(r"[A-Za-z]:", folder):
        return query or ""
    return (f'path:"{folder}" ' if " " in folder else f"path:{folder} ") + (query or "")


def drive_of(path: str) -> str | None:
    m = re.match(r"([A-Za-z]):", path)
    return m[1].upper() if m else None


def servable(path: str, drive: str) -> bool:
    """Whether a volume can answer for a path: it names no drive, or this one."""
    return drive_of(path) in (None, drive.upper())


def shell_query(leaves: list[tuple[str, str]]) -> tuple[str, str] | None:
    """(term, scope) from the (property, value) leaves of a shell condition: all typed words, and the first file: leaf."""
    scope = next((v.removeprefix("file:").replace("/", "\\") for _, v in leaves if v.startswith("file:")), "")
    typed = [v.strip('"').rstrip("*") for p, v in leaves if p.lower() in ("system.generic.string", "system.itemnamedisplay") and v and not v.startswith("file:")]
    term = " ".join(f'"{w}"' if " " in w else w for w in typed if w)
    return (term, scope) if term else None


def _url_parts(url: str) -> list[str]:
    return [p.removeprefix("search-ms:") for p in url.split("&")] if url.lower().startswith("search-ms:") else []


def term_from_url(url: str) -> str | None:
    """The typed text of a search URL: query= wins; else the first crumb that is no location and has it in parentheses or
    after a fullwidth colon."""
    crumbs = []
    for part in _url_parts(url):
        name, _, value = part.partition("=")
        if name == "query" and percent_decode(value).strip():
            return percent_decode(value).strip()
        if name == "crumb" and not value.startswith("location:"):
            m = re.search(r"\((.*)\)", value, re.S)
            found = m[1] if m else value.rpartition("：")[2] if "：" in value and not ("(" in value and ")" in value) else ""
            crumbs += [percent_decode(found).strip()]
    return next((c for c in crumbs if c), None)


def scope_from_url(url: str) -> str | None:
    """The folder of a search URL's location crumb."""
    for part in _url_parts(url):
        name, _, value = part.partition("=")
        if name == "crumb" and value.startswith("location:"):
            return percent_decode(value.removeprefix("location:")).rstrip("\\") or None
    return None


def rows_to_show(term: str, most: int = PAGE_ROWS) -> int:
    """Rows of a page: few for a term too short to be a search yet."""
    return min(most, {0: 200, 1: 200, 2: 1000}.get(len(term), most))


def rows_to_fetch(term: str, most: int = PAGE_ROWS) -> int:
    return min(6 * rows_to_show(term, most), FETCH_ROWS)


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = MAX_SEARCH_ROWS
    case_sensitive: bool = False
    include_orphans: bool = False
    reserve: int = 0

    def clamped(self) -> SearchRequest:
        limit = max(0, min(self.limit, MAX_SEARCH_ROWS))
        return SearchRequest(self.query, limit, self.case_sensitive, self.include_orphans, max(0, min(self.reserve, limit)))


@dataclass(frozen=True)
class UsageRequest:
    path: str
    depth: int = 1
    rows: int = 20
    real: bool = False

    def clamped(self) -> UsageRequest:
        if self.real:
            raise ValueError("sizes by walking the disk are not served")
        return UsageRequest(self.path, max(1, min(self.depth, MAX_USAGE_DEPTH)), max(0, min(self.rows, MAX_USAGE_ROWS)))
