"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.skew import HOT_LEAST, HOT_SHARE, join_hot
from tarn.session import materialize, ship_package

__all__ = ["BATCH_ROWS", "HOT_LEAST", "HOT_SHARE", "RID", "SPACE_CLASS", "WORD_CLASS", "carried", "hash60", "join_hot", "numbered", "read", "small_batches", "without"]

#: The white space of every contract here: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch. Texts may be long, so batches are kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 256
#: A row's number in a table that was written once.
RID = "__tarn_rid"
_FILE, _ROW, _NO = "__tarn_file", "__tarn_row", "__tarn_no"
#: Up to so many row numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Files have fewer rows than 2 ** ROW_BITS; up to so many files are broadcast.
ROW_BITS, BROADCAST_FILES = 40, 100_000


def carried(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` that an operator passes on: all but those whose name (in any case) it makes itself."""
    taken = {x.lower() for x in made}
    return [c for c in df.columns if c.lower() not in taken]


def numbered(df: DataFrame, name: str, scanned: bool = False) -> DataFrame:
    """``df`` with a number for each row, ``__tarn_rid``, that is the same however often it is read.

    Numbers that a scan hands out depend on its splits, and those on how many
    executors there are.  So rows are numbered once, in a written copy.  Where
    ``df`` is a plain read of files (``scanned``), no copy is needed: a row's
    number is made of its file's and its place in the file, which splits don't
    change.
    """
    names = carried(df, [RID])
    files = _files(df) if scanned else None
    if files is None:
        return materialize(df.select(F.monotonically_increasing_id().alias(RID), *names), name)
    told = df.select(*names, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
    met = told.join(F.broadcast(files) if files.count() <= BROADCAST_FILES else files, _FILE)
    return met.select((F.shiftleft(_NO, ROW_BITS) + F.col(_ROW)).alias(RID), *names)


def _files(df: DataFrame) -> DataFrame | None:
    """(file, number) of the files that ``df`` reads; None if it reads none."""
    try:
        found = df.select(F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index")).select(_FILE).distinct()
    except AnalysisException:
        return None
    at = Window.orderBy(_FILE)  # one row a file
    return materialize(found.withColumn(_NO, F.row_number().over(at).cast("long") - 1), "files")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` but for those whose number is in ``dropped`` (written already): by broadcast where they are few, so that texts stay where they are."""
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, RID, "left_anti")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make ready for Python workers: bound what one Arrow batch holds, unless the session asks for less, and send them this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash60(*columns: Column) -> Column:
    """A non-negative hash of 60 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)
