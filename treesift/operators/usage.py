"""Disk usage: subtree totals, and the largest descendants of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .volume import Volume

#: Levels that a report goes down by joins.
NEAR_LEVELS = 4


def directory_totals(volume: Volume) -> DataFrame:
    """(id, below, cut): clusters under each directory, dead entries counting 0 while their children still count; made once
    for a volume."""
    if "totals" not in volume._kept:
        own = volume.entries.where((F.col("id") != volume.root_id) & ~F.col("is_orphan"))
        clusters = F.when(F.col("is_dead"), 0).otherwise(F.col("clusters"))
        direct = own.groupBy(F.col("parent_id").alias("node")).agg(F.sum(clusters).alias("n"), F.max(F.col("size_truncated") & ~F.col("is_dead")).alias("t"))
        spread = volume.chains.join(direct, "node").select(F.explode("chain").alias("id"), "n", "t")
        volume._kept["totals"] = runtime.materialise(spread.groupBy("id").agg(F.sum("n").alias("below"), F.max("t").alias("cut")))
    return volume._kept["totals"]


def _with_totals(volume: Volume, rows: DataFrame) -> DataFrame:
    rows = rows.join(directory_totals(volume), "id", "left")
    return rows.withColumn("total", (F.col("clusters") + F.coalesce("below", F.lit(0))).cast("long")).withColumn("cut", F.col("size_truncated") | F.coalesce("cut", F.lit(False))).drop("below")


def subtree_clusters(volume: Volume) -> DataFrame:
    """Every live, reachable entry with `total` clusters of its subtree and whether any size in it is a lower bound."""
    return _with_totals(volume, volume.live.where(~F.col("is_orphan")))


def _near(volume: Volume, path_id: int, depth: int) -> DataFrame:
    """Live, reachable entries at most `depth` levels under path_id with rel_depth, 1 for its children.

    A few levels are gone down by joins from the children on, so that only what lies there is read on from the scan; for
    more, the ancestors of each directory tell what lies below path_id.
    """
    rows = volume.entries.where(~F.col("is_orphan") & (F.col("id") != volume.root_id))
    if path_id == volume.root_id:
        found = rows.where(F.col("depth") < depth).withColumn("rel_depth", F.col("depth") + 1)
    elif depth <= NEAR_LEVELS:
        step = rows.where(F.col("parent_id") == path_id).withColumn("rel_depth", F.lit(1))
        found = step
        for k in range(2, depth + 1):
            above = step.where(F.col("id") != path_id).select(F.col("id").alias("__p"))
            step = rows.join(above, F.col("parent_id") == F.col("__p")).drop("__p").withColumn("rel_depth", F.lit(k))
            found = found.unionByName(step)
    else:
        above = volume.chains.select(F.col("node").alias("__n"), "chain").where(F.array_contains("chain", F.lit(path_id)))
        inside = rows.join(above, F.col("parent_id") == F.col("__n"))
        found = inside.withColumn("rel_depth", (F.size("chain") - F.array_position("chain", F.lit(path_id)) + 1).cast("int")).drop("__n", "chain").where(F.col("rel_depth") <= depth)
    return found.where(~F.col("is_dead"))


def usage_report(volume: Volume, path_id: int, depth: int = 1, top_n: int = 20) -> DataFrame:
    """(id, name, depth, clusters, size_bytes, truncated): descendants within `depth` levels (at least 1), largest first,
    equal ones by name, then id."""
    rows = _with_totals(volume, _near(volume, path_id, max(1, depth)))
    best = rows.orderBy(F.col("total").desc(), "name", "id").limit(top_n)
    return best.select("id", "name", F.col("rel_depth").alias("depth"), F.col("total").alias("clusters"), (F.col("total") * volume.cluster_bytes).alias("size_bytes"), F.col("cut").alias("truncated"))


def usage_total(volume: Volume, path_id: int) -> DataFrame:
    """One row (clusters, truncated): the whole subtree, the entry itself included."""
    own = volume.entries.where((F.col("id") == path_id) & ~F.col("is_dead")).select("clusters", F.col("size_truncated").alias("cut"))
    if path_id == volume.root_id:
        below = volume.live.where(~F.col("is_orphan")).select("clusters", F.col("size_truncated").alias("cut"))
    else:
        below = directory_totals(volume).where(F.col("id") == path_id).select(F.col("below").alias("clusters"), "cut")
    return below.unionByName(own).agg(F.coalesce(F.sum("clusters"), F.lit(0)).alias("clusters"), F.coalesce(F.max("cut"), F.lit(False)).alias("truncated"))
