"""References to records that do not exist: find orphan references, with their reason."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..runtime import materialise
from .changes import has_bits, journal_state

#: Bits of one Bloom filter (8 MB, the most that Spark's aggregate makes), and how many are made at most: 64 MB together.
#: Beyond that every reference takes the exact join.
FILTER_BITS, MAX_FILTERS = 1 << 26, 8


def key_filter(keys: DataFrame, key: str, n_keys: int, fpp: float = 0.02, max_filters: int | None = None):
    """A function Column -> Column that tests longs against Bloom filters of `key`; false proves that a value is no key.

    The filters are scalar subqueries: partial ones in every task, merged once, sent to the tasks with the query that uses
    them. Keys beyond one filter's room are spread over several by a hash. None where more than `max_filters` would be
    needed. Null keys are ignored.
    """
    from pyspark.sql.classic.column import Column as Classic

    if not n_keys:
        return lambda c: F.lit(False)
    bits = math.ceil(-n_keys * math.log(fpp) / math.log(2) ** 2)
    parts = -(-bits // FILTER_BITS)
    if parts > (MAX_FILTERS if max_filters is None else max_filters):
        return None
    jvm = keys.sparkSession._jvm
    wrap, tree = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    plain = lambda c: wrap.expression(c._jc)
    part_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    count = [plain(F.lit(x).cast("long")) for x in (-(-n_keys // parts), max(64, -(-bits // parts)))]
    longs = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"))

    def of_part(i: int) -> Column:
        made = tree.aggregate.BloomFilterAggregate(plain(F.col("k")), *count).toAggregateExpression()
        return (longs.where(part_of(F.col("k")) == i) if parts > 1 else longs).select(Classic(wrap.column(made)).alias("f")).scalar()

    filters = [of_part(i) for i in range(parts)]

    def might_contain(column: Column) -> Column:
        column = column.cast("long")
        tests = [Classic(wrap.column(tree.BloomFilterMightContain(plain(f), plain(column)))) for f in filters]
        out = tests[-1]
        for i, t in enumerate(tests[:-1]):
            out = F.when(part_of(column) == i, t).otherwise(out)
        return out

    return might_contain


def resolve_references(refs: DataFrame, ref: str, keys: DataFrame, key: str, facts: list[str], max_filters: int | None = None) -> DataFrame:
    """Left-join `refs` to the unique `keys` on ref = key, taking the columns `facts` and `found` (boolean).

    References that the broadcast filter rejects are orphans for certain and skip the join and its shuffle; only the
    others, a few false positives among them, are joined exactly. `keys` must be materialised (it is read three times).
    Defined cases: a null reference is not found; repeated references stay repeated; empty keys find nothing.
    """
    facts_of = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in facts], F.lit(True).alias("__found"))
    kinds = dict(keys.dtypes)
    test = key_filter(keys, key, keys.count(), max_filters=max_filters)

    def out(df: DataFrame) -> DataFrame:
        return df.select(*refs.columns, *[F.col(f"__{f}").alias(f) for f in facts], F.coalesce(F.col("__found"), F.lit(False)).alias("found"))

    if test is None:
        return out(refs.join(facts_of, F.col(ref) == F.col("__key"), "left"))
    maybe = F.coalesce(test(F.col(ref)), F.lit(False))
    joined = out(refs.where(maybe).join(facts_of, F.col(ref) == F.col("__key"), "left"))
    absent = refs.where(~maybe).select(*refs.columns, *[F.lit(None).cast(kinds[f]).alias(f) for f in facts], F.lit(False).alias("found"))
    return joined.unionByName(absent)


def record_orphans(records: DataFrame, journal: DataFrame, root: Column) -> DataFrame:
    """Orphan references of enumerated records: (row_key, parent, why, at), one row per ord.

    `deleted`: the feed's last state-changing event of the parent is a delete; `late`: no record has the parent's frn, but
    the feed has it alive; `missing`: neither. Null parents and the root are no references. Of rows with one ord the latest
    seen counts for `at` and the greatest parent for the reference; rows without ord are left out.
    """
    rows = records.where(F.col("ord").isNotNull()).select("ord", "parent_frn", "seen_at")
    rows = rows.where(F.col("parent_frn").isNotNull() & (F.col("parent_frn") != root))
    rows = rows.groupBy(F.col("ord").alias("row_key")).agg(F.max("parent_frn").alias("parent"), F.max("seen_at").alias("at"))
    known = records.where(F.col("frn").isNotNull()).select("frn", F.lit(True).alias("recorded"), F.lit(None).cast("boolean").alias("deleted"))
    fed = journal_state(journal).select("frn", F.lit(False).alias("recorded"), "deleted")
    keys = materialise(known.unionByName(fed).groupBy("frn").agg(F.max("recorded").alias("recorded"), F.max("deleted").alias("deleted")))
    # The verdict hangs on the parent alone: judge each distinct parent once, then give it to the rows.
    rows = materialise(rows)
    judged = resolve_references(rows.select("parent").distinct(), "parent", keys, "frn", ["recorded", "deleted"])
    why = F.when(F.col("deleted"), "deleted").when(F.col("recorded"), None).when(F.col("deleted").isNotNull(), "late").otherwise("missing")
    verdict = judged.select(F.col("parent").alias("__parent"), why.alias("why")).where(F.col("why").isNotNull())
    return rows.join(verdict, F.col("parent") == F.col("__parent")).select("row_key", "parent", "why", "at")


def entry_orphans(entries: DataFrame, root: Column) -> DataFrame:
    """Orphan references of index entries: (row_key, parent, why, at), one row per id.

    Only rows that are not dead and have a parent other than null, the sentinel and the root count. `missing`: no row has
    the parent's id; `deleted`: the parent row is dead; `late`: both times are known and the parent's is the later. Of rows
    with one id the greatest (parent, flags, added_at) counts; a null flag means no bits.
    """
    rows = entries.where(F.col("id").isNotNull()).select("id", "parent", F.coalesce("flags", F.lit(0)).alias("flags"), "added_at").groupBy("id").agg(F.max(F.struct("parent", "flags", "added_at")).alias("r"))
    rows = materialise(rows.select("id", "r.parent", has_bits(F.col("r.flags"), S.F_DEAD).alias("dead"), F.col("r.added_at").alias("added_at")))
    refs = rows.where(~F.col("dead") & F.col("parent").isNotNull() & (F.col("parent") != S.NO_PARENT) & (F.col("parent") != root))
    refs = refs.select(F.col("id").alias("row_key"), "parent", F.col("added_at").alias("at"))
    keys = rows.select("id", F.col("dead").alias("parent_dead"), F.col("added_at").alias("parent_at"))
    why = F.when(~F.col("found"), "missing").when(F.col("parent_dead"), "deleted").when(F.col("parent_at") > F.col("at"), "late")
    judged = resolve_references(refs, "parent", keys, "id", ["parent_dead", "parent_at"])
    return judged.select("row_key", "parent", why.alias("why"), "at").where(F.col("why").isNotNull())


def count_by_period(orphans: DataFrame, period: str = "day") -> DataFrame:
    """(tab, period, why, n): orphan references per table, period of `at` (UTC; null where unknown) and reason."""
    return orphans.groupBy("tab", F.date_trunc(period, "at").alias("period"), "why").agg(F.count(F.lit(1)).alias("n"))
