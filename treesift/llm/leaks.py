"""Evaluation texts that leak into training text: verbatim passages and re-parameterised questions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Words of a passage; an item with fewer counts as a whole.
WINDOW = 12
#: Words that are held as windows at once: short texts go together up to this size, longer ones in blocks that overlap.
BLOCK_WORDS = 100_000
#: Distinct windows of item templates up to which they are broadcast (48 bytes each); beyond it all windows are shuffled.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Words of the anchor by which a template is looked up in a text at most, and candidate windows compared at once.
ANCHOR_WORDS, CANDIDATES = 4, 500_000
# Units that become a placeholder.
UNITS = (
    "gram grams kilogram kilograms ounce ounces pound pounds ton tons metre metres meter meters kilometre kilometres kilometer kilometers "
    "centimetre centimetres mile miles foot feet inch inches litre litres liter liters second seconds minute minutes hour hours day days "
    "week weeks month months year years degree degrees percent dollar dollars euro euros cent cents watt watts volt volts joule joules"
).split()

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_CHARS = 1 << 20


def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_NAME = np.uint64(_code("<name>"))


class Templates(dict):
    """Numbers words by first use; `codes` has the code of each in a template (placeholders for numbers and units) and of the
    word itself."""

    def __init__(self):
        super().__init__()
        self.units = frozenset(UNITS)
        self.template, self.word = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.word):
            self.template, self.word = np.resize(self.template, 2 * n), np.resize(self.word, 2 * n)
        self.template[n] = _code("<number>" if word.isnumeric() else "<unit>" if word in self.units else word)
        self.word[n] = _code(word)
        self[word] = n
        return n

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of template and word; they differ where the word is a number or unit."""
        if len(self) > 500_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.template[at], self.word[at]


def word_blocks(text: str | None, block: int = BLOCK_WORDS, overlap: int = WINDOW - 1) -> Iterator[list[str]]:
    """Lower-case words (longest stretches of letters and digits) of a text, in blocks; each repeats the last `overlap`
    words of the one before, so that no window is lost."""
    low, at = (text or "").lower(), 0
    words: list[str] = []
    while at < len(low):
        end = at + _CHARS
        if end < len(low) and (gap := _GAP.search(low, end)):
            end = gap.start()
        elif end < len(low):
            end = len(low)
        words += _WORD.findall(low, at, end)
        at = end
        while len(words) > block + overlap:
            yield words[: block + overlap]
            words = words[block:]
    if words:
        yield words


_GAP = re.compile(r"[\W_]")


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive codes: a polynomial over 64 bits, made by n shifted additions."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(_BASE) + codes[j : len(codes) - n + 1 + j]
    return out


def _hashed(codes: np.ndarray) -> np.ndarray:
    """The same hash of every row of a matrix of codes."""
    n = codes.shape[1]
    powers = np.array([pow(_BASE, n - 1 - j, 1 << 64) for j in range(n)], np.uint64)
    with np.errstate(over="ignore"):
        return (codes * powers).sum(axis=1, dtype=np.uint64)


class _Anchors:
    """Templates by their anchors of one length: a bit table sorts most places of a text out, a search settles the rest."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("anchor", ignore_index=True)
        anchor = rows["anchor"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(anchor, kind="stable")
        self.keys, self.first, self.count = np.unique(anchor[order], return_index=True, return_counts=True)
        self.offset, self.len, self.mask, self.template = (rows[c].to_numpy(np.int64)[order] for c in ("offset", "len", "mask", "template"))
        bits = len(self.keys).bit_length() + 4
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys >> self.shift] = True

    def candidates(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, len, mask, template) of the windows that may stand where anchors were found, a bounded number at once."""
        at = np.flatnonzero(self.table[found >> self.shift])
        spot = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        hit = self.keys[spot] == found[at]
        at, spot = at[hit], spot[hit]
        upto = np.cumsum(self.count[spot])
        cuts = np.searchsorted(upto, np.arange(CANDIDATES, upto[-1] if len(upto) else 0, CANDIDATES))
        for a, s in zip(np.split(at, cuts), np.split(spot, cuts), strict=True):
            n = self.count[s]
            v = np.repeat(self.first[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(a, n) - self.offset[v], self.len[v], self.mask[v], self.template[v]


class _Texts:
    """The words of some blocks (id, words) and their windows."""

    def __init__(self, blocks: list[tuple[int, list[str]]], templates: Templates):
        self.ids = np.array([i for i, _ in blocks], np.int64)
        sizes = np.array([len(w) for _, w in blocks], np.int64)
        self.words = [x for _, w in blocks for x in w]
        self.template, self.word = templates.codes(self.words)
        self.typed = self.template != self.word
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.owner = np.repeat(np.arange(len(blocks)), sizes)

    def windows(self, start: np.ndarray, n: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, filled) of the windows of n words at `start`, any word but a typed one taken for a name where the mask
        says so; `filled` hashes what stands in the places of names, numbers and units."""
        at = start[:, None] + np.arange(n)
        typed, named = self.typed[at], (mask[:, None] >> np.arange(n) & 1).astype(bool)
        return _hashed(np.where(named & ~typed, _NAME, self.template[at])), _hashed(np.where(named | typed, self.word[at], np.uint64(0)))

    def found(self, start: np.ndarray, n: int, mask: np.ndarray, wanted: np.ndarray | None) -> pd.DataFrame:
        """Rows of _DOC_WINDOWS for those windows that lie in one text and, unless `wanted` is None, have that template."""
        inside = start >= 0
        inside[inside] = start[inside] + n <= self.ends[start[inside]]
        start, mask = start[inside], mask[inside]
        template, filled = self.windows(start, n, mask)
        if wanted is not None:
            same = template.view(np.int64) == wanted[inside]
            start, mask, template, filled = start[same], mask[same], template[same], filled[same]
        slots = pd.Series([self.slots(a, n, m) for a, m in zip(start.tolist(), mask.tolist(), strict=True)], dtype=object)
        rows = pd.DataFrame({"doc_id": self.ids[self.owner[start]], "len": n, "mask": mask, "template": template.view(np.int64), "filled": filled.view(np.int64), "slots": slots})
        return rows.drop_duplicates(["doc_id", "len", "mask", "template", "filled"])

    def slots(self, a: int, n: int, mask: int) -> list[str]:
        return [w if self.typed[a + k] or mask >> k & 1 else "" for k, w in enumerate(self.words[a : a + n])]


_ITEM_WINDOWS = "id long, len int, mask long, template long, filled long, slots array<string>, k int, anchor long, offset int"
_DOC_WINDOWS = "doc_id long, len int, mask long, template long, filled long, slots array<string>"


def _item_windows(batch: pd.DataFrame, templates: Templates, window: int) -> Iterator[pd.DataFrame]:
    """Windows of items (id, text, names); `mask` has the positions of names, unless no word of the template would be left.

    The anchor of a window is the longest stretch without names, of ANCHOR_WORDS at most; of several the one with most
    letters, as short words are common ones.
    """
    for i in range(len(batch)):
        names = frozenset(batch["names"].iloc[i])
        for words in word_blocks(batch["text"].iloc[i]):
            n, texts = min(window, len(words)), _Texts([(int(batch["id"].iloc[i]), words)], templates)
            isname = np.array([w in names for w in words]) & ~texts.typed
            at = np.arange(len(words) - n + 1)[:, None] + np.arange(n)
            named = isname[at] & ~(isname | texts.typed)[at].all(axis=1, keepdims=True)
            start, mask = at[:, 0], (named << np.arange(n)).sum(axis=1)
            weight = np.where(texts.typed, 0, [len(w) for w in words])[at]
            best, k, offset = np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for m in range(1, min(ANCHOR_WORDS, n) + 1):
                for o in range(n - m + 1):
                    score = np.where(named[:, o : o + m].any(axis=1), -1, weight[:, o : o + m].sum(axis=1) + 1_000_000 * m)
                    better = score > best
                    best, k, offset = np.where(better, score, best), np.where(better, m, k), np.where(better, o, offset)
            template, filled = texts.windows(start, n, mask)
            anchor = np.zeros(len(at), np.int64)
            for m in np.unique(k).tolist():
                anchor[k == m] = _rolling(texts.template, m)[(start + offset)[k == m]].view(np.int64)
            slots = [texts.slots(a, n, m) for a, m in zip(start.tolist(), mask.tolist(), strict=True)]
            yield pd.DataFrame({"id": texts.ids[0], "len": n, "mask": mask, "template": template.view(np.int64), "filled": filled.view(np.int64), "slots": slots, "k": k, "anchor": anchor, "offset": offset})


def item_names(items: DataFrame, text: str) -> DataFrame:
    """(word): names in the items, lower case: capitalised words inside a sentence."""
    found = items.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}+"), F.lit(0))).alias("w"))
    return found.select(F.lower("w").alias("word")).distinct()


class LeakSearch:
    """Items against documents through windows of typed templates.

    Both texts become templates: numbers and units turn into typed placeholders, and so do the names of items, wherever they
    stand; there any word of a document may stand but a number or a unit, so names need not be known on its side. A hash
    join on 12-word template windows (all words of an item with fewer) finds candidates; what filled the slots then decides:
    the same words everywhere make a verbatim passage; other words that replace each other one to one throughout the window,
    none of them one that items use otherwise than as a name, a re-parameterised question.

    The distinct item windows are broadcast to the scan of the documents up to a checked count, so that only windows which
    meet one leave it; there they are looked up by an anchor, a few words of the template without names. Beyond that count
    all windows go into the join. Names are found and matched by joins, however many there are. Whole texts are searched,
    long ones in overlapping blocks. Null or empty texts, items without words, repeated rows and other columns are harmless;
    rows with null ids are left out.
    """

    def __init__(self, items: DataFrame, item_id: str, text: str, window: int = WINDOW, most: int = MAX_BROADCAST_WINDOWS):
        runtime.ship_package(items.sparkSession)
        self.most = most

        def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            templates = Templates()
            for batch in batches:
                yield from _item_windows(batch, templates, window)

        rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text")).distinct()
        words = rows.select("id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
        names = item_names(items, text)
        self.common = words.select("word").distinct().join(names, "word", "left_anti")
        named = words.join(names, "word").groupBy("id", "text").agg(F.collect_list("word").alias("names"))
        rows = rows.join(named, ["id", "text"], "left").select("id", "text", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
        self.items = runtime.materialise(rows.mapInPandas(of_items, _ITEM_WINDOWS).distinct())

    def _doc_windows(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Windows of documents that have the template of an item's window, or all of them where there are too many of those."""
        wanted: pd.DataFrame | None = self.items.select("k", "anchor", "offset", "len", "mask", "template").distinct().limit(self.most + 1).toPandas()
        masks: dict[int, list[int]] = {}
        if len(wanted) > self.most:
            wanted = None
            for r in self.items.select("len", "mask").distinct().collect():  # at most 2^len a length, far fewer in texts
                masks.setdefault(r["len"], []).append(r["mask"])
        shared = docs.sparkSession.sparkContext.broadcast(wanted)

        def all_windows(texts: _Texts) -> Iterator[pd.DataFrame]:
            for n, patterns in masks.items():
                for m in patterns:
                    start = np.arange(len(texts.words))
                    yield texts.found(start, n, np.full(len(start), m, np.int64), None)

        def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            templates = Templates()
            anchors = None if shared.value is None else {int(k): _Anchors(g) for k, g in shared.value.groupby("k")}

            def search(blocks: list[tuple[int, list[str]]]) -> Iterator[pd.DataFrame]:
                texts = _Texts(blocks, templates)
                if anchors is None:
                    yield from all_windows(texts)
                    return
                for k, known in anchors.items():
                    for start, size, mask, template in known.candidates(_rolling(texts.template, k)):
                        for n in np.unique(size).tolist():
                            at = size == n
                            yield texts.found(start[at], n, mask[at], template[at])

            blocks, held = [], 0
            for batch in batches:
                for i, t in zip(batch["id"], batch["text"], strict=True):
                    for words in word_blocks(t):
                        blocks.append((i, words))
                        held += len(words)
                        if held >= BLOCK_WORDS:
                            yield from search(blocks)
                            blocks, held = [], 0
            if blocks:
                yield from search(blocks)

        rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        return rows.mapInPandas(of_docs, _DOC_WINDOWS).dropDuplicates(["doc_id", "len", "mask", "template", "filled"])

    def _candidates(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """Windows of documents with the windows of items that have the same template; `same`: their slots are filled alike."""
        mine = self.items.select("len", "mask", "template", F.col("filled").alias("item_filled"), F.col("slots").alias("item_slots"), F.col("id").alias("item_id"))
        both = self._doc_windows(docs, doc_id, text).join(mine, ["len", "mask", "template"])
        return both.withColumn("same", F.col("filled") == F.col("item_filled"))

    def passages(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc_id, item_id, verbatim, reparameterised): how many distinct passages of a document stand in an item word by
        word, and how many with other names, numbers or units; documents and items without either give no row."""
        key = ["doc_id", "len", "mask", "template", "filled"]
        both = runtime.materialise(self._candidates(docs, doc_id, text))
        kinds = lambda c: F.size(F.array_distinct(c))
        pairs = kinds(F.arrays_zip("slots", "item_slots"))
        other = both.where(~F.col("same") & (pairs == kinds("slots")) & (pairs == kinds("item_slots")))
        names = other.select(*key, F.explode(F.expr("filter(slots, (w, i) -> (shiftright(mask, i) & 1) = 1)")).alias("word"))
        other = other.join(names.join(self.common, "word").select(*key).distinct(), key, "left_anti")
        rows = both.where("same").unionByName(other).select("doc_id", "item_id", "same", *key[1:]).distinct()
        return rows.groupBy("doc_id", "item_id").agg(F.count_if("same").alias("verbatim"), F.count_if(~F.col("same")).alias("reparameterised"))

    def verbatim(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc_id, item_id): documents with a passage of the item, word by word; the verbatim part of passages."""
        return self._candidates(docs, doc_id, text).where("same").select("doc_id", "item_id").distinct()

    def reparameterised(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc_id, item_id, n_windows): distinct passages of an item's template whose slots hold other words, consistently."""
        return self.passages(docs, doc_id, text).where(F.col("reparameterised") > 0).select("doc_id", "item_id", F.col("reparameterised").alias("n_windows"))
