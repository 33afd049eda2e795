"""Build a volume's entries from enumerated records and sizes, and search them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import runtime
from .. import schema as S
from ..functions import text as X
from ..functions.fold import fold_column, fold_needle
from ..plans import conditions
from ..plans.syntax import Query
from . import hierarchy

ENTRIES = "id frn parent_id name name_fold ext name_chars is_dir is_reparse is_orphan is_dead at_root sized size_truncated clusters size_bytes depth path path_fold".split()
SLOTS = "id frn parent_id name attributes is_dead sized clusters truncated".split()


@dataclass
class Volume:
    """Entries of one volume (columns ENTRIES, the root among them) with the scalars that go with them."""

    entries: DataFrame
    drive: str
    cluster_bytes: int
    root_id: int
    _kept: dict = field(default_factory=dict)

    @property
    def live(self) -> DataFrame:
        """Entries that are not dead, the root left out."""
        return self.entries.where(~F.col("is_dead") & (F.col("id") != self.root_id))

    @property
    def chains(self) -> DataFrame:
        """(node, chain): ids from the top down to each directory itself, made once for a volume."""
        if "chains" not in self._kept:
            links = self.entries.where((F.col("id") != self.root_id) & ~F.col("is_orphan")).select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))
            forest = self.entries.select(F.col("id").alias("node"), "depth")
            self._kept["chains"] = runtime.materialise(hierarchy.ancestor_arrays(links, forest, F.lit(self.root_id)))
        return self._kept["chains"]


def merge_size_parts(parts: DataFrame) -> DataFrame:
    """(frn, clusters, truncated) from size records that may belong to a base record: sums by base, saturated.

    `parts` has frn, base_frn (null for a base record), clusters, truncated. Parts whose base record is absent are dropped.
    """
    summed = parts.groupBy(F.coalesce("base_frn", "frn").alias("frn")).agg(
        F.sum(F.coalesce("clusters", F.lit(0))).alias("n"), F.max(F.coalesce("truncated", F.lit(False))).alias("truncated"), F.max(F.col("base_frn").isNull()).alias("based")
    )
    return summed.where("based").select("frn", F.least("n", F.lit(S.MAX_CLUSTERS)).alias("clusters"), (F.col("truncated") | (F.col("n") > S.MAX_CLUSTERS)).alias("truncated"))


def run_clusters(runs: Column) -> Column:
    """Clusters of an array of (length, sparse) runs: holes don't count."""
    return F.aggregate(F.filter(runs, lambda r: ~r["sparse"]), F.lit(0).cast("long"), lambda a, r: a + r["length"])


def canonical_ids(records: DataFrame) -> DataFrame:
    """(frn, id): the record of greatest ord stands for its frn."""
    return records.groupBy("frn").agg(F.max("ord").alias("id"))


def link_records(records: DataFrame, sizes: DataFrame, root_frn: int = S.ROOT_FRN) -> tuple[DataFrame, int]:
    """(slots, id of the root) of enumerated `records` (ord, frn, parent_frn, name, attributes) and `sizes` (frn, clusters,
    truncated); slots have the columns SLOTS, parents being ids.

    ord is the id. A record read twice counts once. A parent that is missing, or the record itself, is null. A size goes to the
    record that stands for its frn. A root that has no record gets the id after the greatest. Rows without ord or frn are
    left out; null names are empty.
    """
    once = records.where(F.col("ord").isNotNull() & F.col("frn").isNotNull()).groupBy("ord").agg(F.max(F.struct("frn", "parent_frn", "name", "attributes")).alias("r"))
    rows = runtime.materialise(once.select(F.col("ord").alias("id"), "r.frn", "r.parent_frn", F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.attributes", F.lit(0)).alias("attributes")))
    got = rows.agg(F.max("id"), F.max(F.when(F.col("frn") == root_frn, F.col("id")))).first()
    root_id = got[1] if got[1] is not None else (got[0] if got[0] is not None else -1) + 1
    canon = rows.groupBy("frn").agg(F.max("id").alias("canon"))
    parents = canon.select(F.col("frn").alias("__frn"), F.col("canon").alias("__parent"))
    measured = sizes.where(F.col("frn").isNotNull()).groupBy("frn").agg(F.max(F.struct("clusters", "truncated")).alias("s"))
    measured = canon.join(measured, "frn").select(F.col("canon").alias("id"), F.lit(True).alias("sized"), F.col("s.clusters").alias("clusters"), F.col("s.truncated").alias("truncated"))
    rows = rows.where(F.col("id") != root_id)
    at = F.when(F.col("parent_frn") == root_frn, F.lit(root_id)).otherwise(F.col("__parent"))
    linked = rows.join(parents, F.col("parent_frn") == F.col("__frn"), "left").withColumn("parent_id", at)
    linked = linked.withColumn("parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))).join(measured, "id", "left")
    filled = [F.coalesce("sized", F.lit(False)).alias("sized"), F.coalesce("clusters", F.lit(0)).cast("long").alias("clusters"), F.coalesce("truncated", F.lit(False)).alias("truncated")]
    return linked.select("id", "frn", F.col("parent_id").cast("long").alias("parent_id"), "name", "attributes", F.lit(False).alias("is_dead"), *filled), root_id


def build_entries(records: DataFrame, sizes: DataFrame, drive: str, cluster_bytes: int, root_frn: int = S.ROOT_FRN) -> Volume:
    """A Volume from enumerated records and sizes, see link_records and entries_of."""
    slots, root_id = link_records(records, sizes, root_frn)
    return entries_of(slots, root_id, drive, cluster_bytes, root_frn)


def entries_of(slots: DataFrame, root_id: int, drive: str, cluster_bytes: int, root_frn: int = S.ROOT_FRN) -> Volume:
    """A Volume of `slots` (columns SLOTS, without the root).

    A null or absent parent makes an orphan, as does a chain that doesn't reach the root; dead slots keep their place, so
    what lies below them keeps its path. Saturated sizes keep their flag; unmeasured files have 0.
    """
    linked = runtime.materialise(slots.select(*SLOTS))
    links = linked.select(F.col("id").alias("node"), F.col("parent_id").alias("parent"), "name")
    root = F.lit(root_id).cast("long")
    forest = runtime.materialise(hierarchy.resolve_forest(links.select("node", "parent"), root))
    paths = hierarchy.materialise_paths(links, forest, root, f"{drive}:").select(F.col("node").alias("id"), "top", "depth", "path")
    full = linked.join(paths, "id").select(
        "id", "frn", "parent_id", "name", F.col("attributes").bitwiseAND(S.A_DIRECTORY).alias("d"), F.col("attributes").bitwiseAND(S.A_REPARSE).alias("l"),
        (F.col("top") != root).alias("is_orphan"), "is_dead", F.coalesce(F.col("parent_id") == root, F.lit(False)).alias("at_root"), "sized", "truncated", "clusters", "depth",
        F.coalesce("path", F.concat(F.lit("<orphan>\\"), "name")).alias("path"),
    )
    # The root row takes the schema of the others; its one row costs no shuffle.
    top = slots.sparkSession.range(1).select(
        root.alias("id"), F.lit(root_frn).cast("long").alias("frn"), root.alias("parent_id"), F.lit("").alias("name"), F.lit(1).alias("d"), F.lit(0).alias("l"), F.lit(False).alias("is_orphan"), F.lit(False).alias("is_dead"), F.lit(False).alias("at_root"),
        F.lit(False).alias("sized"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("clusters"), F.lit(-1).alias("depth"), F.lit(f"{drive}:\\").alias("path"),
    )
    full = full.unionByName(top).select(
        "id", "frn", "parent_id", "name", (F.col("d") != 0).alias("is_dir"), (F.col("l") != 0).alias("is_reparse"), "is_orphan", "is_dead", "at_root", "sized",
        F.col("truncated").alias("size_truncated"), F.col("clusters").cast("long").alias("clusters"), (F.col("clusters") * cluster_bytes).cast("long").alias("size_bytes"), "depth", "path",
    )
    full = full.withColumn("name_fold", fold_column(F.col("name"))).withColumn("path_fold", fold_column(F.col("path")))
    full = full.withColumn("ext", X.extension(F.col("name_fold"))).withColumn("name_chars", F.length("name"))
    return Volume(runtime.materialise(full.select(*ENTRIES)), drive, cluster_bytes, root_id)


def slots_of(volume: Volume) -> DataFrame:
    """The slots that a volume's entries were made of."""
    bit = lambda c, mask: F.when(F.col(c), F.lit(mask)).otherwise(F.lit(0))
    attributes = bit("is_dir", S.A_DIRECTORY).bitwiseOR(bit("is_reparse", S.A_REPARSE)).alias("attributes")
    return volume.entries.where(F.col("id") != volume.root_id).select("id", "frn", "parent_id", "name", attributes, "is_dead", "sized", "clusters", F.col("size_truncated").alias("truncated"))


def empty_volume(spark: SparkSession, drive: str, cluster_bytes: int = 4096) -> Volume:
    """Only the root: what is served while a volume is being built."""
    none = spark.createDataFrame([], S.RECORDS), spark.createDataFrame([], S.SIZES)
    return build_entries(*none, drive, cluster_bytes)


def with_side_columns(volume: Volume, rows: DataFrame, wanted: set, case_sensitive: bool = False) -> DataFrame:
    """`rows` with what conditions.needs asked for; every joined column is filled, so that NOT is safe."""
    live = volume.live
    if "children" in wanted:
        kids = live.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("__p")).agg(F.count_if(~F.col("is_dir")).alias("__f"), F.count_if(F.col("is_dir")).alias("__d"))
        rows = rows.join(kids, F.col("id") == F.col("__p"), "left")
        files, folders = F.coalesce("__f", F.lit(0)), F.coalesce("__d", F.lit(0))
        rows = rows.withColumn("child_files", files).withColumn("child_folders", folders).withColumn("child_n", files + folders).drop("__p", "__f", "__d")
    if "dupe" in wanted:
        twice = volume.entries.where(~F.col("is_dead")).groupBy(F.col("name_fold").alias("__n")).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").drop("__c")
        rows = rows.join(twice, F.col("name_fold") == F.col("__n"), "left").withColumn("is_dupe", F.col("__n").isNotNull()).drop("__n")
    for text in sorted(w[1] for w in wanted if isinstance(w, tuple)):
        hay = F.col("name").contains(F.lit(text)) if case_sensitive else F.col("name_fold").contains(F.lit(fold_needle(text)))
        has = live.where(hay & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("__h")).distinct()
        rows = rows.join(has, F.col("id") == F.col("__h"), "left").withColumn(conditions.child_column(text), F.col("__h").isNotNull()).drop("__h")
    return rows


def search(volume: Volume, text: str, case_sensitive: bool = False, include_orphans: bool = False) -> tuple[DataFrame, Query]:
    """The live entries that match, unordered, and the parsed query. Only side tables that the query mentions are joined."""
    query = conditions.parse_for(volume.entries.sparkSession, text)
    rows = volume.live if include_orphans else volume.live.where(~F.col("is_orphan"))
    rows = with_side_columns(volume, rows, conditions.needs(query.tree), case_sensitive)
    return rows.where(conditions.condition(query.tree, case_sensitive)), query


def search_literal(volume: Volume, text: str, insensitive: bool = True, include_orphans: bool = False) -> DataFrame:
    """Entries whose name contains one literal text, taken as it is."""
    rows = volume.live if include_orphans else volume.live.where(~F.col("is_orphan"))
    return rows.where(F.col("name_fold").contains(F.lit(fold_needle(text))) if insensitive else F.col("name").contains(F.lit(text)))


def rank_class(query: Query, case_sensitive: bool = False) -> Column:
    """0 for a name equal to the needle, 1 for one that starts with it, else 2; the needle is the query's longest positive
    word in bytes, the last of equals."""
    if not query.words:
        return F.lit(2)
    needle = max(enumerate(query.words), key=lambda w: (len(w[1].encode("utf-8", "surrogatepass")), w[0]))[1]
    hay = F.col("name" if case_sensitive else "name_fold")
    needle = needle if case_sensitive else fold_needle(needle)
    return F.when(hay == F.lit(needle), 0).when(hay.startswith(F.lit(needle)), 1).otherwise(2)


def top_ranked(hits: DataFrame, query: Query, limit: int, reserve: int = 0, case_sensitive: bool = False) -> DataFrame:
    """The best `limit` hits (or fewer, by count:) with `rank_pos` from 1: by class, path length, id.

    `reserve` keeps that many places for hits inside a name (class 2), if there are as many: the last others make room. Both
    kinds are cut to `limit` rows by bounded top-k first, so what is numbered afterwards is at most two pages.
    """
    limit = min(limit, query.limit if query.limit is not None else limit)
    reserve = max(0, min(reserve, limit))
    keyed = hits.withColumn("class", rank_class(query, case_sensitive)).withColumn("path_len", X.path_length(F.col("path")))
    order = ["class", "path_len", "id"]
    if not reserve:
        best = keyed.orderBy(*order).limit(limit)
    else:
        a = keyed.where(F.col("class") < 2).orderBy(*order).limit(limit)
        b = keyed.where(F.col("class") == 2).orderBy(*order).limit(limit)
        both = W.partitionBy(F.lit(1))
        n = F.row_number().over(W.partitionBy(F.col("class") == 2).orderBy(*order))
        rows = a.unionByName(b).withColumn("n", n).withColumn("near", F.count_if(F.col("class") < 2).over(both)).withColumn("inside", F.count_if(F.col("class") == 2).over(both))
        have = F.least(F.greatest(F.lit(limit) - F.col("near"), F.lit(0)), F.col("inside"))
        kept = F.greatest(have, F.least(F.lit(reserve), "inside"))
        best = rows.where(F.when(F.col("class") == 2, F.col("n") <= kept).otherwise(F.col("n") <= F.lit(limit) - kept)).drop("n", "near", "inside")
    return best.withColumn("rank_pos", F.row_number().over(W.orderBy(*order)))


def resolve_path(volume: Volume, path: str) -> DataFrame:
    """The entry at a path (either separator, any case; the lowest id of several); none for another drive."""
    wanted = path.replace("/", "\\").rstrip("\\")
    if len(wanted) == 2 and wanted[1] == ":":
        wanted += "\\"
    folded = "".join(c.lower() for c in wanted)
    return volume.entries.where(~F.col("is_dead") & ~F.col("is_orphan") & (F.col("path_fold") == F.lit(folded))).orderBy("id").limit(1)


def path_of_frn(volume: Volume, frn: int) -> DataFrame:
    """The path of the entry that stands for an frn."""
    return volume.entries.where(~F.col("is_dead") & (F.col("frn") == frn)).orderBy(F.col("id").desc()).limit(1).select("id", "path")


def statistics(volume: Volume) -> DataFrame:
    """One row of counters of the live entries."""
    live = volume.entries.where(~F.col("is_dead"))
    waits = ~F.col("is_dir") & ~F.col("sized")
    return live.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("is_dir")).alias("folders"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if(F.col("is_orphan")).alias("orphans"),
        F.count_if(waits).alias("unsized_files"), F.count_if(F.col("is_dir") | F.col("sized")).alias("sizes_resolved"), F.count_if(F.col("size_truncated")).alias("truncated"), F.sum("clusters").alias("clusters"),
    )


def size_shortfall(stats: DataFrame) -> DataFrame:
    """How many live entries lack a size, and whether a usage total deserves a warning (under nine tenths are known)."""
    missing = F.greatest(F.col("entries") - F.col("sizes_resolved"), F.lit(0))
    return stats.select("entries", "sizes_resolved", missing.alias("missing"), ((F.col("entries") > 0) & (F.col("sizes_resolved") * 10 < F.col("entries") * 9)).alias("warn"))


def status(volume: Volume, cursor: int, next_usn: int, phase: str = "ready") -> DataFrame:
    """One row: phase, counters, and how far the journal is ahead of the cursor (never negative)."""
    return statistics(volume).withColumn("phase", F.lit(phase)).withColumn("drive", F.lit(volume.drive)).withColumn("lag", F.lit(max(0, next_usn - cursor)))


def tombstone_ratio(volume: Volume) -> DataFrame:
    """Bytes of dead names over bytes of all names: the share that a rewrite of the table would free."""
    n = F.octet_length("name")
    return volume.entries.agg((F.coalesce(F.sum(F.when(F.col("is_dead"), n)), F.lit(0)) / F.greatest(F.sum(n), F.lit(1))).alias("ratio"))
