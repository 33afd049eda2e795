"""Change feeds: rebuild the current state of a table from inserts, updates and deletes in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def fold_changes(feed: DataFrame, key: str, sequence: str, deleted: str, payload: list[str], base: DataFrame | None = None) -> DataFrame:
    """State of every key once all changes are applied, tombstones included.

    A commutative fold: per key the greatest struct (sequence, deleted, payload...) wins, so order of arrival and repeated
    delivery do not matter, and maps combine before the shuffle (a key with a third of all changes sends one row per task).
    `base` holds state rows in the same columns, such as an earlier result of this function; its tombstones keep a late
    change with a smaller sequence from reviving a deleted key. Result: key, sequence, deleted, payload columns.

    Defined cases: rows with null key or null sequence are no changes; a null `deleted` counts as false; of two changes with
    one sequence the delete wins, then the greater payload (null least); other columns of the inputs are ignored; an empty
    feed gives the base, or nothing.
    """
    columns = [key, sequence, deleted, *payload]
    rows = feed.select(*columns)
    if base is not None:
        rows = rows.unionByName(base.select(*columns))
    rows = rows.where(F.col(key).isNotNull() & F.col(sequence).isNotNull())
    change = F.struct(F.col(sequence), F.coalesce(F.col(deleted), F.lit(False)).alias(deleted), *[F.col(p) for p in payload])
    return rows.groupBy(key).agg(F.max(change).alias("__last")).select(key, *[F.col("__last")[c].alias(c) for c in columns[1:]])


def current_rows(state: DataFrame, deleted: str = "deleted") -> DataFrame:
    """The live rows of a state, without the tombstone column."""
    return state.where(~F.col(deleted)).drop(deleted)


def has_bits(column: Column | str, mask: int) -> Column:
    """Whether any bit of `mask` is set; null counts as no bits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(0).cast("long")).bitwiseAND(F.lit(mask).cast("long")) != 0


def journal_changes(journal: DataFrame) -> DataFrame:
    """State-changing events of a change journal with the flag `deleted`.

    A delete counts whatever else its reason has; otherwise a create or new name counts unless it is a bare old name.
    """
    deleted = has_bits("reason", S.R_DELETE)
    changes = has_bits("reason", S.R_CREATE) | has_bits("reason", S.R_NEW_NAME)
    bare_old = has_bits("reason", S.R_OLD_NAME) & ~has_bits("reason", S.R_NEW_NAME)
    return journal.where(deleted | (changes & ~bare_old)).withColumn("deleted", deleted)


def journal_state(journal: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(frn, usn, deleted, parent_frn) after all events of `journal`, see fold_changes."""
    return fold_changes(journal_changes(journal), "frn", "usn", "deleted", ["parent_frn"], base)


def records_as_base(records: DataFrame) -> DataFrame:
    """Enumerated records as base rows of a fold: before every event, the greatest ord standing for its frn.

    Sequences of the base are negative (ord - 2^62), so any event of the feed is later than any record.
    """
    early = F.lit(-(1 << 62))
    return records.where(F.col("ord").isNotNull()).select("frn", (F.col("ord") + early).alias("usn"), F.lit(False).alias("deleted"), "parent_frn")
