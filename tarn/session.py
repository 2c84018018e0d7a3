"""Session construction and the shared scratch area.

Anything that must be cut out of a lineage goes to the folder that the cluster
names in ``spark.checkpoint.dir``: driver and executors all see it, so a lost
executor never loses it.  Only a session on one machine may go without that
setting (unit tests, a laptop); it uses a temporary local folder.  What a
session writes there goes when it ends, rounds of an iteration as soon as the
next ones are written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarn")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no installation of their own."""
    context, root = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(context.applicationId)
    packed = Path(tempfile.mkdtemp(prefix="tarn-package-")) / "tarn-package.zip"  # the driver serves it to executors
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(packed))


#: Rows and bytes of an Arrow batch. Texts may be long, so batches are kept far below Spark's defaults (10,000 rows, 2 GB).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make ready for Python workers: bound what one Arrow batch holds, unless the session asks for less, and send them this package."""
    ship_package(spark)
    for key, default, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 2**31 - 1, BATCH_BYTES)):
        now = _number_of(spark.conf.get(key, str(default)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _number_of(size: str) -> int:
    """The number that a setting says, with or without a unit."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", size.lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (see the module docstring)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarn-scratch-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_ENDING: set[str] = set()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder, which is deleted when the session ends."""
    own = f"{shared_dir(spark)}/tarn-{spark.sparkContext.applicationId}"
    if own not in _ENDING:
        _ENDING.add(own)
        files, at = hadoop_path(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    files, at = hadoop_path(spark, path)
    return files.exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete scratch that nothing will read again."""
    files, at = hadoop_path(spark, path)
    files.delete(at, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (to ``path`` there, if given) and read it back: lineage is cut, the rows survive executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the files of materialized frames that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "__dict__", {}).get("_scratch")
        if path:
            discard(frame.sparkSession, path)
