"""Repeated consecutive events: collapse each run of alike events into one with its count and duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import runtime
from .. import schema as S


def canonical_reason(reason: Column) -> Column:
    """The reason without CLOSE, its three data-change bits taken for one."""
    r = reason.bitwiseAND(F.lit(~S.R_CLOSE & 0x7FFFFFFFFFFFFFFF))
    data = S.R_OVERWRITE | S.R_EXTEND | S.R_TRUNCATE
    return F.when(r.bitwiseAND(F.lit(data)) != 0, r.bitwiseAND(F.lit(~data & 0x7FFFFFFFFFFFFFFF)).bitwiseOR(F.lit(S.R_OVERWRITE))).otherwise(r)


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs within each group of `keys` by the difference of two row numbers; one shuffle serves all steps."""
    rows = rows.repartition(*keys).groupBy(*keys, "seq").agg(F.min("value").alias("value"), F.min("at").alias("at"))
    whole = W.partitionBy(*keys).orderBy("seq")
    alike = W.partitionBy(*keys, "value").orderBy("seq")
    rows = rows.withColumn("island", (F.row_number().over(whole) - F.row_number().over(alike)).cast("long"))
    return rows.groupBy(*keys, "value", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _stitch(parts: DataFrame) -> DataFrame:
    """Global runs from the runs of blocks: both row numbers go on from one block to the next, so do their differences."""
    before = W.orderBy("block").rangeBetween(W.unboundedPreceding, -1)
    per_block = parts.groupBy("entity", "block").agg(F.sum("n").alias("n"))
    rows_before = per_block.select("entity", "block", F.coalesce(F.sum("n").over(before.partitionBy("entity")), F.lit(0)).alias("__e"))
    per_value = parts.groupBy("entity", "value", "block").agg(F.sum("n").alias("n"))
    alike_before = per_value.select("entity", F.col("value").alias("__value"), "block", F.coalesce(F.sum("n").over(before.partitionBy("entity", "value")), F.lit(0)).alias("__v"))
    joined = parts.join(rows_before, ["entity", "block"])
    same = [joined["entity"] == alike_before["entity"], joined["block"] == alike_before["block"], joined["value"].eqNullSafe(alike_before["__value"])]
    joined = joined.join(alike_before, same).select(joined["*"], "__v")
    joined = joined.withColumn("island", F.col("island") + F.col("__e") - F.col("__v"))
    return joined.groupBy("entity", "value", "island").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def collapse_runs(events: DataFrame, entity: str, sequence: str, value: Column, at: str | None = None, blocks: int | None = None) -> DataFrame:
    """(entity, value, first_seq, last_seq, n, first_at, last_at, seconds): every run of alike consecutive events of an entity.

    `value` is the canonical form by which events are alike; events with equal sequence are one event (its least value and
    time). `seconds` spans the least and greatest known time of a run, null without any, so a clock set back cannot make
    it negative. An entity with more than 1/blocks of all rows (at most 1024 blocks; 4 per shuffle partition unless given)
    is cut into blocks of equal size along the sequence; block-local row numbers and prefix sums over the blocks give the
    same differences as numbering the whole entity in one task.

    Defined cases: rows with null entity or sequence are no events; null values are alike; other columns are ignored;
    an empty table gives no rows.
    """
    spark = events.sparkSession
    blocks = blocks or min(1024, 4 * runtime.slots(spark))
    time = F.col(at) if at else F.lit(None).cast("timestamp")
    rows = events.where(F.col(entity).isNotNull() & F.col(sequence).isNotNull()).select(F.col(entity).alias("entity"), F.col(sequence).alias("seq"), value.alias("value"), time.alias("at"))
    hot = runtime.hot_keys(rows, "entity", blocks)
    is_hot = F.col("entity").isin(hot)
    keep = ["entity", "value", "first_seq", "last_seq", "n", "first_at", "last_at"]
    runs = _islands(rows.where(~is_hot) if hot else rows, ["entity"]).select(*keep)
    if hot:
        large = rows.where(is_hot)
        cuts = runtime.equal_blocks(large, "seq", blocks)
        parts = runtime.materialise(_islands(large.withColumn("block", runtime.block_of(F.col("seq"), cuts)), ["entity", "block"]))
        runs = runs.unionByName(_stitch(parts).select(*keep))
    seconds = (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(1e6)
    return runs.withColumn("seconds", seconds)
