"""Session, shared-folder and skew helpers used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    Where the session names none, a temporary folder serves, but only with a local master: on a cluster that would lose
    data with the machine that holds it.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="treesift-")
        _FOLDERS[app] = f"{base.rstrip('/')}/treesift-{app}"
        atexit.register(_forget, spark, app)
    return _FOLDERS[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        discard(spark, _FOLDERS.pop(app))
    except Exception:  # noqa: BLE001 - the session may have gone already
        pass


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that materialise writes inside, so that a loop can discard those it needs no more."""
    made: list[str] = []
    _WRITTEN.append(made)
    try:
        yield made
    finally:
        _WRITTEN.remove(made)


def folder_of(df: DataFrame) -> str | None:
    """The folder that `df` was written to, if materialise returned it."""
    return getattr(df, "_treesift_folder", None)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there, and a lost executor costs only a read.

    Unlike checkpoint(), which holds row objects, this keeps a compressed columnar copy with sizes that the optimiser can use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for made in _WRITTEN:
        made.append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._treesift_folder = path
    return back


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for an application; operators with Python code call it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="treesift-code-")) / "treesift.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(packed))


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of this session, at least 8."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, parts: int, least: int = 1000) -> list:
    """Keys that hold more than 1/parts of all rows (and more than `least` rows).

    By counting there are fewer than `parts` of them, whatever the input, so the list is small enough for the driver. One
    pass over one column, combined before the shuffle. Null keys are never reported.
    """
    above = max(least, df.count() // parts)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > above).select(key).collect()]


def equal_blocks(df: DataFrame, order: str, parts: int) -> list:
    """Up to parts - 1 values of `order` that cut `df` into blocks of about equal size (one pass, a fixed-size sketch)."""
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    return sorted(set(cuts))


def block_of(column: Column, cuts: list) -> Column:
    """How many of the sorted `cuts` lie at or below the value, as int; nulls lie in block 0. A tree of comparisons finds it
    in as many steps as the number of cuts has digits in binary."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(cuts[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return below(0, len(cuts)) if cuts else F.lit(0)
