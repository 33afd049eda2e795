"""Keyword-stuffed and link-list pages: advertising made of repeated keywords, links or product tags."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Words of a block: long enough to compress, short enough that a page of prose with one list keeps both apart.
BLOCK_WORDS = 48
#: Redundancy (share of what prose of the language and length keeps when compressed) below which a block is flagged: without
#: any sentence ends, and from SENTENCE_DENSITY ends a word on; in between the bound moves evenly. The three were chosen on
#: one sample, the 10,000 documents of the test tables at scale 0.1.
LIST_REDUNDANCY, SENTENCE_REDUNDANCY, SENTENCE_DENSITY = 0.95, 0.71, 0.03
#: Blocks of a language from which its own line is fitted, and the slope and base where even all together are fewer.
LEAST_BLOCKS = 100
_PRIOR = (-0.093, 1.377)
# Top-level domains by which a name with dots is a link without more.
TOP_DOMAINS = "com net org info biz shop store online site example invalid test".split()

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"<br\s*/?>|</?(?:li|ul|ol|p|div|tr|td|table)\b[^>]*>", re.I)
_CODE = re.compile(r"(?ms)^[ ]{0,3}(```|~~~).*?(?:^[ ]{0,3}\1[^\n]*$|\Z)|<pre>.*?(?:</pre>|\Z)|^(?: {4}|\t)[^\n]*$")
_HIDDEN_DOT = r"\s*[\[(](?:\.|dot)[\])]\s*|\s+dot\s+"
_DOT = rf"(?:\.|{_HIDDEN_DOT}|\s\.\s)"
_LINK = re.compile(
    rf"(?:\bh(?:tt|xx)ps?\s?:\s?//\s?|\bwww{_DOT})[\w-]+(?:{_DOT}[\w-]+)*(?::\d+)?(?:[/?#][^\s\"'<>\])]*)?"
    rf"|\b[\w-]+(?:{_HIDDEN_DOT})[\w-]+(?:{_DOT}[\w-]+)*(?:/\S*)?|\b(?:[\w-]+\.)+(?:{'|'.join(TOP_DOMAINS)})\b(?:/\S*)?"
)
_LINK_SIGNS = ("//", "www", "[.]", "(.)", "dot", *("." + d for d in TOP_DOMAINS))
#: What all links become before compression; the sign tells them from words.
_PLAIN_LINK = "http://00\x01 "
#: What may stand beside the links of a line of bare links: bullets or numbers, separators, tags around them.
_BESIDE_LINKS = re.compile(r"(?:</?pre>|[\s*+•·>|,;<-]|\d+[.)]|http://00\x01)*")
_SENTENCE_END = re.compile(r"[.!?…。]+(?=[\"')\]”»]*(?:\s|$))")
_DIGIT = re.compile(r"\d")
_NUMBERING = re.compile(r"(?m)^\s*0+\.(?=\s)")


def _links_plain(low: str) -> str:
    """Lower-case text with one and the same link for all links."""
    return _LINK.sub(_PLAIN_LINK, low) if any(s in low for s in _LINK_SIGNS) else low


def _is_bare_links(line: str) -> bool:
    """Whether the line holds links and no words beside them, nor quotes or brackets as in code."""
    plain = _links_plain(line.lower())
    return "\x01" in plain and _BESIDE_LINKS.fullmatch(plain) is not None


def _without_code(text: str) -> tuple[int, str]:
    """Words of code (fenced, in <pre>, indented), and the text without it; lines of bare links stay wherever they stand."""
    code = 0

    def cut(m: re.Match) -> str:
        nonlocal code
        bare = []
        if any(s in m[0] for s in _LINK_SIGNS):
            bare = [x for x in m[0].replace("<pre>", "\n").replace("</pre>", "\n").split("\n") if _is_bare_links(x)]
        code += len(_WORD.findall(m[0])) - sum(len(_WORD.findall(x)) for x in bare)
        return "\n".join(["", *bare, ""])

    if "<" in text:
        text = _BREAK.sub("\n", text.replace("<code>", "").replace("</code>", ""))
    if "```" in text or "~~~" in text or "<pre>" in text or "    " in text or "\t" in text:
        text = _CODE.sub(cut, text)
    return code, text


def page_blocks(text: str | None, block_words: int = BLOCK_WORDS) -> list[tuple[str, int, int, int, int, int]]:
    """(kind, words, own words, bytes, packed bytes, sentence ends) of the blocks of a page.

    Blocks of kind text hold about `block_words` words, gathered from whole lines (long lines are cut between words); all
    code makes one block of kind code. Packed is what deflate leaves of a block in lower case once links are all one, digits are
    0 and a sentence that comes again is left out; numbers of list items end no sentence. Own words are those outside of links. The whole text counts; an empty or
    null text has no blocks.
    """
    code, rest = _without_code(text or "")
    out: list[tuple[str, int, int, int, int, int]] = [("code", code, code, 0, 0, 0)] if code else []
    groups: list[tuple[int, list[str]]] = []
    held, lines = 0, []
    for line in rest.lower().split("\n"):
        n = len(_WORD.findall(line))
        if not n:
            continue
        for k, piece in [(n, line)] if n <= 1.5 * block_words else _cut(line, n, block_words):
            held += k
            lines.append(piece)
            if held >= block_words:
                groups.append((held, lines))
                held, lines = 0, []
    if held and groups and held < block_words // 2:
        groups[-1] = groups[-1][0] + held, groups[-1][1] + lines
    elif held:
        groups.append((held, lines))
    return out + [("text", n, *_packed("\n".join(lines), n)) for n, lines in groups]


def _cut(line: str, n: int, block_words: int) -> list[tuple[int, str]]:
    ends = [m.end() for m in _WORD.finditer(line)][block_words - 1 : n - 1 : block_words]
    cuts = [0, *ends, len(line)]
    sizes = [block_words] * len(ends) + [n - block_words * len(ends)]
    return [(k, line[a:b]) for k, a, b in zip(sizes, cuts, cuts[1:], strict=False)]


def _packed(block: str, words: int) -> tuple[int, int, int, int]:
    plain = _links_plain(block)
    links = plain.count("\x01")
    own = words if not links else len(_WORD.findall(plain)) - 2 * links
    sentences = _SENTENCE_END.split(_NUMBERING.sub("0", _DIGIT.sub("0", plain)))
    ends = len(sentences) - 1
    if ends > 1:
        sentences = list(dict.fromkeys(s.strip() for s in sentences))
    raw = ". ".join(sentences).encode("utf-8", "replace")
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    return own, len(raw), len(deflate.compress(raw)) + len(deflate.flush()), ends


_BLOCKS = "doc_id long, lang string, kind string, words int, own int, bytes int, packed int, ends int"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["kind", "words", "own", "bytes", "packed", "ends"]
    for batch in batches:
        rows = [(d, la, *b) for d, la, t in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True) for b in page_blocks(t)]
        yield pd.DataFrame(rows, columns=["doc_id", "lang", *names])


def measure_blocks(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """One row per block of every document (see page_blocks) with `lang` cut to its first two letters, '' where odd."""
    runtime.ship_package(docs.sparkSession)
    two = F.coalesce(F.regexp_extract(F.lower(F.col(lang)), "^([a-z]{2})(?![a-z])", 1), F.lit(""))
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).alias("doc_id"), two.alias("lang"), F.col(text).alias("text")).mapInPandas(_measure, _BLOCKS)


def advertising_pages(docs: DataFrame, doc_id: str, text: str, lang: str, redundancy: float = LIST_REDUNDANCY, in_sentences: float = SENTENCE_REDUNDANCY, density: float = SENTENCE_DENSITY, share: float = 0.5, least_words: int = 12) -> DataFrame:
    """(doc_id, words, list_words, link_words, redundancy) of the pages that are advertising.

    Every text is cut into blocks and compressed block by block. A block's ratio divided by what prose of its language and
    length keeps (a line over the logarithm of the length, fitted to all blocks that have sentence ends; the line of all
    languages where one has fewer than LEAST_BLOCKS) is its redundancy: 1 for prose, the lower the more it repeats. Low
    density of sentence ends confirms: without any, a block counts from `redundancy` down, and the nearer it comes to `density`
    ends a word, the more extreme its redundancy must be, `in_sentences` from there on, since keyword pages may be set
    in full stops. A page is advertising if such blocks hold more than `share` of its words, code included, and at least
    `least_words`. list_words and link_words are the words outside and inside links in those blocks.

    Null ids and texts are left out; a null or odd language forms its own class; repeated ids add up; an empty table gives
    no rows. There are at most 677 languages, so their lines are broadcast.
    """
    blocks = runtime.materialise(measure_blocks(docs, doc_id, text, lang))
    length, ratio, ends = F.log2(F.greatest("bytes", F.lit(1))), F.col("packed") / F.greatest("bytes", F.lit(1)), F.col("ends") / F.col("words")
    rows = blocks.withColumn("length", length).withColumn("ratio", ratio).withColumn("density", ends)
    prose = rows.where((F.col("kind") == "text") & (F.col("own") >= 8) & (F.col("density") >= 0.02))
    line = [F.regr_slope("ratio", "length").alias("slope"), F.regr_intercept("ratio", "length").alias("base"), F.count(F.lit(1)).alias("n")]
    overall = prose.agg(*line).first()
    slope, base = (overall["slope"], overall["base"]) if overall["n"] >= LEAST_BLOCKS and overall["slope"] is not None else _PRIOR
    lines = prose.where("lang <> ''").groupBy("lang").agg(*line).where((F.col("n") >= LEAST_BLOCKS) & F.col("slope").isNotNull()).drop("n")
    rows = rows.join(F.broadcast(lines), "lang", "left")
    usual = F.greatest(F.coalesce("base", F.lit(base)) + F.coalesce("slope", F.lit(slope)) * F.col("length"), F.lit(0.2))
    rows = rows.withColumn("relative", F.col("ratio") / usual)
    bound = F.lit(redundancy) + F.lit(in_sentences - redundancy) * F.least(F.col("density") / density, F.lit(1.0))
    listed = (F.col("kind") == "text") & (F.col("relative") < bound)
    sums = rows.groupBy("doc_id").agg(
        F.sum("words").cast("long").alias("words"), F.sum(F.when(listed, F.col("own")).otherwise(0)).cast("long").alias("list_words"),
        F.sum(F.when(listed, F.col("words") - F.col("own")).otherwise(0)).cast("long").alias("link_words"), F.min(F.when(listed, F.col("relative"))).alias("redundancy"),
    )
    bad = F.col("list_words") + F.col("link_words")
    return sums.where((bad > share * F.col("words")) & (bad >= least_words))
