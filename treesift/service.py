"""Requests against a volume: search, usage, status; what is served while it is being built; answers kept for a moment."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import usage
from .operators import volume as V
from .plans import front

#: How many answers a view keeps, and for how many seconds.
RECENT_ANSWERS, RECENT_SECONDS = 8, 15.0


class Building(RuntimeError):
    """The volume isn't ready for this request yet."""


@dataclass
class Answer:
    """Hits of one page (path, is_dir, rank_pos), how many there are before any limit, and the phase of the volume."""

    hits: DataFrame
    total: int
    phase: str


@dataclass
class Service:
    """Answers requests from a volume; without one it is building: searches find nothing, usage is refused."""

    spark: SparkSession
    volume: V.Volume | None = None
    cursor: int = 0
    next_usn: int = 0

    @property
    def phase(self) -> str:
        return "building" if self.volume is None else "ready"

    def search(self, request: front.SearchRequest) -> Answer:
        """A page within the caps of requests; count: narrows the page, not the total."""
        r = request.clamped()
        if self.volume is None:
            return Answer(self.spark.createDataFrame([], "path string, is_dir boolean, rank_pos int"), 0, self.phase)
        hits, query = V.search(self.volume, r.query, r.case_sensitive, r.include_orphans)
        page = V.top_ranked(hits, query, r.limit, r.reserve, r.case_sensitive)
        return Answer(page.select("path", "is_dir", "rank_pos"), hits.count(), self.phase)

    def usage(self, request: front.UsageRequest) -> tuple[DataFrame, DataFrame]:
        """(rows, total) of a directory; LookupError where no entry has the path, or the path is on another drive."""
        r = request.clamped()
        if self.volume is None:
            raise Building("sizes aren't known yet")
        found = V.resolve_path(self.volume, r.path).first() if front.servable(r.path, self.volume.drive) else None
        if found is None:
            raise LookupError(r.path)
        return usage.usage_report(self.volume, found["id"], r.depth, r.rows), usage.usage_total(self.volume, found["id"])

    def status(self) -> DataFrame:
        if self.volume is None:
            return V.status(V.empty_volume(self.spark, "-"), 0, 0, self.phase).withColumn("entries", F.lit(0).cast("long"))
        return V.status(self.volume, self.cursor, self.next_usn, self.phase)


@dataclass
class RecentAnswers:
    """The last few answers by (term, scope), each for some seconds; the least recently used goes first."""

    most: int = RECENT_ANSWERS
    seconds: float = RECENT_SECONDS
    clock: Callable[[], float] = time.monotonic
    _kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: tuple[str, str], make: Callable[[], object]) -> object:
        now = self.clock()
        if key in self._kept and now - self._kept[key][0] <= self.seconds:
            self._kept.move_to_end(key)
            return self._kept[key][1]
        self._kept[key] = now, make()
        self._kept.move_to_end(key)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)
        return self._kept[key][1]
