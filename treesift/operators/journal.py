"""Fold a change journal into entries: identity, parents as of each event, sizes that wait to be measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from .changes import has_bits, journal_changes

#: Sizes measured in one poll.
MEASURED_AT_ONCE = 4096
_EARLY = -(1 << 62)


def once_per_usn(journal: DataFrame) -> DataFrame:
    """Events delivered again count once (their least content, should it differ); rows without usn or frn are no events."""
    rows = journal.where(F.col("usn").isNotNull() & F.col("frn").isNotNull())
    return rows.groupBy("usn", "frn").agg(F.min(F.struct("parent_frn", "reason", "name", "attributes")).alias("e")).select("usn", "frn", "e.*")


def lifetimes(records: DataFrame, journal: DataFrame) -> DataFrame:
    """(frn, born, died): spans of usn in which an frn is known; recorded ones are born before all events, died is null for
    those that still live. Renames don't end a life; a delete does, and a create after it starts another."""
    events = journal_changes(journal).select("frn", "usn", "deleted")
    base = records.where(F.col("frn").isNotNull()).select("frn").distinct().select("frn", F.lit(_EARLY).alias("usn"), F.lit(False).alias("deleted"))
    w = W.partitionBy("frn").orderBy("usn")
    steps = base.unionByName(events).withColumn("before", F.lag("deleted").over(w))
    turns = steps.where(F.col("before").isNull() | (F.col("before") != F.col("deleted"))).withColumn("died", F.lead("usn").over(w))
    return turns.where(~F.col("deleted")).select("frn", F.col("usn").alias("born"), "died")


def parents_as_of(records: DataFrame, journal: DataFrame) -> DataFrame:
    """(frn, usn, parent_frn, name, parent_known, born) for every frn whose last state-changing event is no delete.

    The parent counts as of that event: known if the parent was alive at its usn, whatever became of it later; a parent
    created afterwards doesn't adopt. `born` is where the life of the entry began, its identity across renames.
    """
    events = once_per_usn(journal)
    last = journal_changes(events).groupBy("frn").agg(F.max(F.struct("usn", "deleted", "parent_frn", "name")).alias("e"))
    alive = last.where(~F.col("e.deleted")).select("frn", "e.usn", "e.parent_frn", "e.name")
    lives = lifetimes(records, events)
    own = lives.where(F.col("died").isNull()).select("frn", "born")
    spans = lives.select(F.col("frn").alias("__p"), F.col("born").alias("__b"), F.coalesce("died", F.lit((1 << 63) - 1)).alias("__d"))
    inside = (F.col("parent_frn") == F.col("__p")) & (F.col("usn") > F.col("__b")) & (F.col("usn") < F.col("__d"))
    known = alive.join(spans, inside, "left")
    return known.join(own, "frn").select("frn", "usn", "parent_frn", "name", ((F.col("__p").isNotNull()) | (F.col("parent_frn") == S.ROOT_FRN)).alias("parent_known"), "born")


def merge_entries(records: DataFrame, journal: DataFrame) -> DataFrame:
    """(frn, parent_frn, name, is_dead, from_feed): records with all events applied, tombstones kept.

    The newest record or event of an frn gives its name and parent; a deleted one stays as a dead row with what it last had.
    """
    base = records.where(F.col("frn").isNotNull() & F.col("ord").isNotNull()).select("frn", (F.col("ord") + F.lit(_EARLY)).alias("usn"), F.lit(False).alias("deleted"), "parent_frn", "name")
    events = journal_changes(once_per_usn(journal)).select("frn", "usn", "deleted", "parent_frn", "name")
    last = base.unionByName(events).groupBy("frn").agg(F.max(F.struct("usn", "deleted", "parent_frn", "name")).alias("e"))
    return last.select("frn", "e.parent_frn", "e.name", F.col("e.deleted").alias("is_dead"), (F.col("e.usn") >= 0).alias("from_feed"))


def size_backlog(journal: DataFrame) -> DataFrame:
    """(frn, first_usn): files whose size an event may have changed, each once, in order of their first such event."""
    events = once_per_usn(journal)
    touched = has_bits("reason", S.R_CREATE | S.R_EXTEND | S.R_TRUNCATE | S.R_OVERWRITE) & ~has_bits("reason", S.R_DELETE) & ~has_bits("attributes", S.A_DIRECTORY)
    return events.where(touched).groupBy("frn").agg(F.min("usn").alias("first_usn"))


def next_to_measure(backlog: DataFrame, most: int = MEASURED_AT_ONCE) -> DataFrame:
    """The files that have waited longest; those deleted meanwhile use up their turn."""
    return backlog.orderBy("first_usn", "frn").limit(most)


def record_sizes(sizes: DataFrame, measured: DataFrame) -> DataFrame:
    """`sizes` (frn, clusters, truncated) with newly measured ones in their place, saturated and flagged."""
    n = F.coalesce("clusters", F.lit(0))
    new = measured.where(F.col("frn").isNotNull()).select("frn", F.least(n, F.lit(S.MAX_CLUSTERS)).alias("clusters"), (F.coalesce("truncated", F.lit(False)) | (n > S.MAX_CLUSTERS)).alias("truncated"), F.lit(1).alias("new"))
    both = sizes.select("frn", "clusters", "truncated", F.lit(0).alias("new")).unionByName(new)
    return both.groupBy("frn").agg(F.max(F.struct("new", "clusters", "truncated")).alias("s")).select("frn", "s.clusters", "s.truncated")


def discontinuity(cursor: int, journal_id: int, now_id: int, first_usn: int) -> str | None:
    """Why a journal can't be read on from the cursor: another journal, or events trimmed; None if it can."""
    if journal_id != now_id:
        return "another journal"
    return "events were trimmed" if cursor < first_usn else None
