"""Keep the state of a change feed current with Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..operators import journal as J
from ..operators import live
from ..operators import volume as V
from ..operators.changes import fold_changes, journal_state
from ..operators.volume import Volume
from ..sources import snapshot
from ..sources.volumes import VolumeSource

EVENTS = "usn long, frn long, parent_frn long, reason long, name string, attributes int, ts timestamp, read_at timestamp"
STATE = "frn long, usn long, deleted boolean, parent_frn long"
#: Batches after which the state of a stream is written whole.
COMPACT_AFTER = 16
#: Share of dead names from which a volume is built anew.
COMPACT_ABOVE = 0.3


@dataclass
class StateTable:
    """The state of a change feed below one folder: a base and the folded batches since.

    The fold is commutative and idempotent, so the state is the fold of the newest base with all later batches, in any
    order. A batch costs what it holds; after COMPACT_AFTER of them a new base is written. Only folders that were written to
    their end count, so a table opened anew goes on where the last one stopped.
    """

    spark: SparkSession
    folder: str

    def _complete(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = [n for n in names if n.startswith(f"{kind}-") and n[len(kind) + 1 :].isdigit()]
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n[len(kind) + 1 :]) for n in found if done(n))

    def _versions(self) -> tuple[int, list[int]]:
        base = max(self._complete("base"), default=-1)
        return base, [d for d in self._complete("delta") if d > base]

    @property
    def version(self) -> int:
        """The newest batch that the state holds, -1 for none."""
        base, deltas = self._versions()
        return max([base, *deltas])

    def read(self) -> DataFrame:
        base, deltas = self._versions()
        paths = [f"{self.folder}/base-{base}"] * (base >= 0) + [f"{self.folder}/delta-{d}" for d in deltas]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(*paths)
        return rows if not deltas else fold_changes(rows, "frn", "usn", "deleted", ["parent_frn"])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch in; one that runs again, late events and repeats change nothing."""
        base, deltas = self._versions()
        if batch_id <= base or batch_id in deltas:
            return
        journal_state(batch.select("usn", "frn", "parent_frn", "reason")).select("frn", "usn", "deleted", "parent_frn").write.mode("overwrite").parquet(f"{self.folder}/delta-{batch_id}")
        if len(deltas) + 1 >= COMPACT_AFTER:
            self.compact()

    def compact(self) -> None:
        """Write a new base; what the base before it had replaced is deleted, so readers of that one are not cut off."""
        base, deltas = self._versions()
        if not deltas:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base-{deltas[-1]}")
        for kind in ("base", "delta"):
            for old in self._complete(kind):
                if old < base or kind == "delta" and old <= base:
                    runtime.discard(self.spark, f"{self.folder}/{kind}-{old}")


def stream_state(spark: SparkSession, events_path: str, folder: str | None = None, max_files: int = 8) -> StateTable:
    """Read every event file that is there as a stream, fold batch after batch, and return the table of the state.

    Tombstones stay in the state, so a late change of a deleted key is recognised in any later batch. Offsets and state lie
    in the shared folder.
    """
    folder = folder or f"{runtime.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = StateTable(spark, f"{folder}/table")
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files)
    where = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a source wants folders
        events_path, name = events_path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    stream = reader.parquet(events_path)
    run = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    return table


@dataclass
class Watched:
    """A volume that follows its journal: a cursor, files that wait to be measured, and what to do when the journal breaks off."""

    source: VolumeSource
    volume: Volume
    cursor: int
    journal_id: int
    backlog: DataFrame | None = None
    _made: list[str] = field(default_factory=list)

    def _replace(self, make: Callable[[], Volume]) -> None:
        """Put another volume in this one's place. What was written on the way to it is discarded; of the volumes made here
        the last two stay, for those who still read the one before."""
        spark = self.volume.entries.sparkSession
        with runtime.scratch() as written:
            self.volume = make()
        kept = runtime.folder_of(self.volume.entries)
        self._made += [kept] * (kept is not None)
        for path in [p for p in written if p != kept] + self._made[:-2]:
            runtime.discard(spark, path)
        self._made = self._made[-2:]

    @classmethod
    def build(cls, source: VolumeSource) -> Watched:
        """Enumerate; the cursor is taken before, so that changes made meanwhile are applied afterwards."""
        cursor, journal_id = source.next_usn(), source.journal_id
        return cls(source, V.build_entries(source.records(), source.sizes(), source.drive, source.cluster_bytes, source.root_frn), cursor, journal_id)

    @classmethod
    def resume(cls, source: VolumeSource, folder: str) -> Watched:
        """Go on from a snapshot, under the drive letter of now, if the journal still holds everything since; else enumerate. A
        snapshot in which more than half of the files lack a size reads all sizes again."""
        loaded = snapshot.load(source.records().sparkSession, folder, source.drive)
        if not snapshot.resumable(loaded, source.journal_id, source.first_usn()):
            return cls.build(source)
        volume = loaded.volume
        files = volume.live.where(~F.col("is_dir"))
        missing, n = files.agg(F.count_if(~F.col("sized")), F.count(F.lit(1))).first()
        if missing * 2 > n:
            volume = live.record_measured(volume, source.sizes(), source.root_frn)
        return cls(source, volume, loaded.next_usn, loaded.journal_id)

    def sync(self) -> str | None:
        """Apply all events from the cursor on and measure what has waited longest, or say why that can't be done, with
        nothing applied."""
        why = J.discontinuity(self.cursor, self.journal_id, self.source.journal_id, self.source.first_usn())
        if why:
            return why
        ahead = self.source.next_usn()
        if ahead > self.cursor:
            feed = self.source.journal(self.cursor).where(F.col("usn") < ahead)
            self._replace(lambda: live.apply_events(self.volume, feed, self.source.root_frn))
            waiting = J.size_backlog(feed)
            if self.backlog is not None:
                waiting = waiting.unionByName(self.backlog).groupBy("frn").agg(F.min("first_usn").alias("first_usn"))
            self._wait(waiting)
            self.cursor = ahead
        if self.backlog is not None and self.backlog.limit(1).count():
            turn = runtime.materialise(J.next_to_measure(self.backlog))
            measured = self.source.live_sizes().join(turn.select("frn"), "frn", "left_semi")
            self._replace(lambda: live.record_measured(self.volume, measured, self.source.root_frn))
            self._wait(self.backlog.join(turn.select("frn"), "frn", "left_anti"))
            runtime.discard(turn.sparkSession, runtime.folder_of(turn))
        return None

    def _wait(self, rows: DataFrame) -> None:
        old, self.backlog = self.backlog, runtime.materialise(rows)
        if old is not None:
            runtime.discard(rows.sparkSession, runtime.folder_of(old))

    def recover(self) -> None:
        """Build anew beside the old volume, then take its place."""
        cursor, journal_id = self.source.next_usn(), self.source.journal_id
        self._replace(lambda: V.build_entries(self.source.records(), self.source.sizes(), self.source.drive, self.source.cluster_bytes, self.source.root_frn))
        self.cursor, self.journal_id, self.backlog = cursor, journal_id, None

    def save(self, folder: str) -> None:
        snapshot.save(folder, self.volume, self.journal_id, self.cursor)

    def run(self, polls: int, folder: str | None = None, seconds: float = 1.0, save_seconds: float = 300.0) -> list[str]:
        """Follow the journal for a number of polls: sync, build anew after a gap or where too many names are dead, save now
        and then. Returns what happened at each poll: synced or the reason of a rebuild."""
        told, saved = [], time.monotonic()
        for i in range(polls):
            why = self.sync()
            if why is None and V.tombstone_ratio(self.volume).first()[0] > COMPACT_ABOVE:
                why = "many names are dead"
            if why:
                self.recover()
            told.append(why or "synced")
            if folder and (i == polls - 1 or time.monotonic() - saved >= save_seconds):
                self.save(folder)
                saved = time.monotonic()
            if i < polls - 1:
                time.sleep(seconds)
        return told
