"""Where records, sizes and journals come from."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..runtime import read_table


class VolumeSource(Protocol):
    """What a volume must give: all records, sizes, and events from a cursor on."""

    drive: str
    cluster_bytes: int
    root_frn: int
    journal_id: int

    def records(self) -> DataFrame: ...
    def sizes(self) -> DataFrame: ...
    def journal(self, start: int = 0) -> DataFrame: ...
    def live_sizes(self) -> DataFrame: ...
    def first_usn(self) -> int: ...
    def next_usn(self) -> int: ...


@dataclass
class ParquetVolume:
    """A volume whose tables lie as Parquet in one folder."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        row = read_table(self.spark, self.folder, "volume_info").first()
        self.drive, self.root_frn, self.cluster_bytes, self.journal_id = (row["drive"], row["root_frn"], row["cluster_bytes"], row["journal_id"]) if row else ("C", S.ROOT_FRN, 4096, 0)

    def records(self) -> DataFrame:
        return read_table(self.spark, self.folder, "raw_record").select("ord", "frn", "parent_frn", F.col("name_utf16").alias("name"), "attributes")

    def sizes(self) -> DataFrame:
        return read_table(self.spark, self.folder, "size_row").select("frn", "clusters", "truncated")

    def journal(self, start: int = 0) -> DataFrame:
        rows = read_table(self.spark, self.folder, "usn_event").select("usn", "frn", "parent_frn", "reason", "name", "attributes")
        return rows.where(F.col("usn") >= start) if start else rows

    def live_sizes(self) -> DataFrame:
        return self.sizes()

    def first_usn(self) -> int:
        return self.journal().agg(F.min("usn")).first()[0] or 0

    def next_usn(self) -> int:
        return (self.journal().agg(F.max("usn")).first()[0] or -1) + 1


@dataclass
class MemoryVolume:
    """A volume held in lists, for tests: rows as in schema.RECORDS, SIZES and JOURNAL."""

    spark: SparkSession
    record_rows: list[tuple] = field(default_factory=list)
    size_rows: list[tuple] = field(default_factory=list)
    events: list[tuple] = field(default_factory=list)
    live_rows: list[tuple] | None = None
    drive: str = "C"
    cluster_bytes: int = 4096
    root_frn: int = S.ROOT_FRN
    journal_id: int = 1
    trimmed_before: int = 0

    def records(self) -> DataFrame:
        return self.spark.createDataFrame(self.record_rows, S.RECORDS)

    def sizes(self) -> DataFrame:
        return self.spark.createDataFrame(self.size_rows, S.SIZES)

    def journal(self, start: int = 0) -> DataFrame:
        return self.spark.createDataFrame([e for e in self.events if e[0] >= max(start, self.trimmed_before)], S.JOURNAL)

    def live_sizes(self) -> DataFrame:
        return self.spark.createDataFrame(self.size_rows if self.live_rows is None else self.live_rows, S.SIZES)

    def first_usn(self) -> int:
        return self.trimmed_before

    def next_usn(self) -> int:
        return max((e[0] for e in self.events), default=-1) + 1
