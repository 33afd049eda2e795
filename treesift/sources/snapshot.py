"""Snapshots of a volume: Parquet versions and numbered manifests, each written after its version."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.volume import ENTRIES, Volume

FORMAT, VERSION = "treesift-snapshot", 1


@dataclass
class Loaded:
    volume: Volume
    journal_id: int
    next_usn: int


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _fs(spark: SparkSession, text: str):
    return _path(spark, text).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the manifests of a folder; a plain manifest.json comes before all numbered ones."""
    fs, where = _fs(spark, folder), _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    numbered = [(int(n[9:-5]), f"{folder}/{n}") for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()]
    return sorted(numbered + [(-1, f"{folder}/manifest.json")] * ("manifest.json" in names))


def _write_text(spark: SparkSession, where: str, text: str) -> bool:
    """Write a new file in one step; False if there is one already."""
    fs, part = _fs(spark, where), f"{where}.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, part), True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(_path(spark, where)) and fs.rename(_path(spark, part), _path(spark, where)):
        return True
    fs.delete(_path(spark, part), False)
    return False


def save(folder: str, volume: Volume, journal_id: int, next_usn: int) -> str:
    """Write a new version below `folder`, then a manifest with the next number; returns the version's name. The greatest
    number counts and no manifest is ever replaced, so at any moment a reader sees the old version or the new one; older
    versions stay for readers that still use them."""
    spark = volume.entries.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    volume.entries.write.parquet(f"{folder}/{version}")
    manifest = {"format": FORMAT, "version": VERSION, "entries": version, "journal_id": journal_id, "next_usn": next_usn, "drive": volume.drive, "cluster_bytes": volume.cluster_bytes, "root_id": volume.root_id}
    number = max((n for n, _ in _manifests(spark, folder)), default=-1) + 1
    while not _write_text(spark, f"{folder}/manifest-{number:08}.json", json.dumps(manifest)):
        number += 1
    return version


def load(spark: SparkSession, folder: str, drive: str | None = None) -> Loaded:
    """The version the newest manifest names; ValueError for a manifest of another kind or version, or with a missing column.
    A volume takes on the drive letter it has now, if one is given, in its paths too."""
    found = _manifests(spark, folder)
    if not found:
        raise FileNotFoundError(f"{folder}/manifest.json")
    where = found[-1][1]
    try:
        m = json.loads("\n".join(r[0] for r in spark.read.text(where, wholetext=True).limit(1).collect()))
    except ValueError as e:
        raise ValueError(f"{where} is no manifest") from e
    if not isinstance(m, dict) or m.get("format") != FORMAT or m.get("version") != VERSION:
        raise ValueError(f"{where} is of another kind or version")
    entries: DataFrame = spark.read.parquet(f"{folder}/{m['entries']}")
    if set(entries.columns) != set(ENTRIES):
        raise ValueError(f"{folder}/{m['entries']} has other columns")
    if drive and drive != m["drive"]:
        for column, old, new in (("path", f"{m['drive']}:", f"{drive}:"), ("path_fold", f"{m['drive'].lower()}:", f"{drive.lower()}:")):
            rest = F.substring(F.col(column), F.lit(len(old) + 1), F.length(column))
            entries = entries.withColumn(column, F.when(F.col(column).startswith(old), F.concat(F.lit(new), rest)).otherwise(F.col(column)))
    return Loaded(Volume(entries.select(*ENTRIES), drive or m["drive"], m["cluster_bytes"], m["root_id"]), m["journal_id"], m["next_usn"])


def resumable(loaded: Loaded, journal_id: int, first_usn: int) -> bool:
    """Whether a snapshot can be brought up to date from the journal, or the volume must be enumerated again."""
    return loaded.journal_id == journal_id and loaded.next_usn >= first_usn
