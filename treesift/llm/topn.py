"""Top N items within every group, ties settled the same way every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_of_copies(df: DataFrame, same: list[str], row_id: str) -> DataFrame:
    """Of rows equal in `same` (nulls are equal) the one with the least `row_id`; rank 1 prunes copies before the shuffle."""
    w = W.partitionBy(*same).orderBy(F.col(row_id).asc_nulls_last())
    return df.withColumn("__copy", F.row_number().over(w)).where(F.col("__copy") == 1).drop("__copy")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group by `order`, with their `rank` from 1.

    A row_number window under a rank filter: the optimiser's group limit keeps n rows per group in every task before the
    shuffle and again after it, so a group with a third of all rows sends n rows per task. `order` must end in a unique
    column for a fixed result. Null groups form groups; n < 1 or an empty table gives no rows; a `rank` column is replaced.
    """
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def largest_rows(df: DataFrame, same: list[str], group: list[str], size: str, name: str, row_id: str, n: int) -> DataFrame:
    """The n largest rows of every group: rows without size left out, copies counted once, ties by name, then row id.

    Strings compare by their UTF-8 bytes; a null name comes first.
    """
    rows = first_of_copies(df.where(F.col(size).isNotNull()), same, row_id)
    return top_n(rows, group, [F.col(size).desc(), F.col(name).asc_nulls_first(), F.col(row_id).asc()], n)
