"""Keep a volume current: journal events and newly measured sizes applied to its slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import runtime
from .. import schema as S
from . import journal as J
from . import volume as V
from .changes import journal_changes
from .volume import Volume


def standing(slots: DataFrame) -> DataFrame:
    """The slot that stands for each frn: that of greatest id, unless it is dead."""
    last = slots.groupBy("frn").agg(F.max(F.struct("id", "is_dead")).alias("s"))
    return last.where(~F.col("s.is_dead")).select("frn", F.col("s.id").alias("id"))


def apply_events(volume: Volume, feed: DataFrame, root_frn: int = S.ROOT_FRN) -> Volume:
    """`volume` after all events of `feed` (usn, frn, parent_frn, reason, name, attributes), in order of usn.

    A delete marks the slot that stands for its frn as dead; the slot stays, so what lies below keeps its parent and path. A
    create or new name of a standing frn changes name, parent and attributes of that slot only - other records of the frn
    (hard links) and all sizes stay - and of another frn begins a life with a slot of its own. A parent is what stood for
    its frn at the usn of the event: none makes an orphan for good, whatever is created later. Ids of new slots go on after
    the greatest, lives that still last first, both in order of birth. Repeated events and events of no effect change nothing.
    """
    slots = runtime.materialise(V.slots_of(volume))
    events = runtime.materialise(journal_changes(J.once_per_usn(feed)))
    stands = standing(slots)
    lives = J.lifetimes(stands.select("frn"), events)
    old, new = lives.where(F.col("born") < 0), lives.where(F.col("born") >= 0)
    greatest = slots.agg(F.max("id")).first()[0]
    first = max(-1 if greatest is None else greatest, volume.root_id) + 1
    numbered = number_rows(new.withColumn("__gone", F.col("died").isNotNull()), ["__gone", "born", "frn"], first).drop("__gone")
    known = runtime.materialise(old.join(stands, "frn").select("frn", "born", "died", "id").unionByName(numbered.select("frn", "born", "died", "id")))
    changes = events.where(~F.col("deleted")).select("frn", "usn", "parent_frn", "name", "attributes")
    inside = (F.col("usn") >= F.col("born")) & (F.col("died").isNull() | (F.col("usn") < F.col("died")))
    last = changes.join(known, "frn").where(inside).groupBy("id", "frn").agg(F.max(F.struct("usn", "parent_frn", "name", "attributes")).alias("e"))
    last = last.select("id", "frn", "e.*")
    above = known.select(F.col("frn").alias("__f"), F.col("born").alias("__b"), F.coalesce("died", F.lit((1 << 63) - 1)).alias("__d"), F.col("id").alias("__above"))
    stood = (F.col("parent_frn") == F.col("__f")) & (F.col("usn") > F.col("__b")) & (F.col("usn") < F.col("__d"))
    parent = F.when(F.col("parent_frn") == root_frn, F.lit(volume.root_id)).otherwise(F.col("__above")).cast("long")
    moved = last.join(above, stood, "left").select("id", "frn", parent.alias("__parent"), F.coalesce("name", F.lit("")).alias("__name"), F.coalesce("attributes", F.lit(0)).alias("__attributes"))
    moved = moved.withColumn("__parent", F.when(F.col("__parent") != F.col("id"), F.col("__parent")))
    ends = known.where(F.col("died").isNotNull()).select("id", F.lit(True).alias("__dead"))
    kept = slots.join(moved.drop("frn").withColumn("__hit", F.lit(True)), "id", "left").join(ends, "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    dead = (F.col("is_dead") | F.coalesce("__dead", F.lit(False))).alias("is_dead")
    kept = kept.select("id", "frn", *[F.when(hit, F.col(f"__{n}")).otherwise(F.col(c)).alias(c) for n, c in (("parent", "parent_id"), ("name", "name"), ("attributes", "attributes"))], dead, "sized", "clusters", "truncated")
    born = moved.where(F.col("id") >= first).join(ends, "id", "left")
    size = [F.lit(False).alias("sized"), F.lit(0).cast("long").alias("clusters"), F.lit(False).alias("truncated")]
    born = born.select("id", "frn", F.col("__parent").alias("parent_id"), F.col("__name").alias("name"), F.col("__attributes").alias("attributes"), F.coalesce("__dead", F.lit(False)).alias("is_dead"), *size)
    return V.entries_of(kept.unionByName(born), volume.root_id, volume.drive, volume.cluster_bytes, root_frn)


def record_measured(volume: Volume, measured: DataFrame, root_frn: int = S.ROOT_FRN) -> Volume:
    """`volume` with newly measured sizes (frn, clusters, truncated) at the slots that stand for their frns."""
    slots = V.slots_of(volume)
    fresh = J.record_sizes(measured.limit(0), measured).select("frn", F.col("clusters").alias("__c"), F.col("truncated").alias("__t"))
    fresh = standing(slots).join(fresh, "frn").drop("frn")
    hit = F.col("__c").isNotNull()
    rows = slots.join(fresh, "id", "left")
    return V.entries_of(rows.select("id", "frn", "parent_id", "name", "attributes", "is_dead", (hit | F.col("sized")).alias("sized"), F.coalesce("__c", "clusters").alias("clusters"), F.coalesce("__t", "truncated").alias("truncated")), volume.root_id, volume.drive, volume.cluster_bytes, root_frn)


def number_rows(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """`rows` with `id` from `start` on by `order`: sorted in ranges, then each range's length is added to the next, so no
    task sees all rows. `order` must be unique."""
    cut = runtime.materialise(rows.repartitionByRange(runtime.slots(rows.sparkSession), *order).withColumn("__part", F.spark_partition_id()))
    sums = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offset = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))  # a row for each range
    numbered = cut.withColumn("__i", F.row_number().over(W.partitionBy("__part").orderBy(*order))).join(F.broadcast(offset), "__part")
    return numbered.withColumn("id", (F.lit(start - 1) + F.col("__offset") + F.col("__i")).cast("long")).drop("__part", "__offset", "__i")
