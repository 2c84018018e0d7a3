"""A stored table of chunks that changes rewrite only where they touch it.

Rows lie in buckets by a hash of their document, one partition folder each.  A
change reads the buckets of its documents and writes what they hold afterwards
by dynamic partition overwrite, which moves it in place at the end: all other
files stay as they are, with their names.  A bucket that is left empty loses its
folder.  One writer changes a store at a time; a reader that must see one state
while it is changed reads a snapshot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tarn.session import discard, exists, hadoop_path, materialize, release, scratch_path

DOCUMENT = ["organization_id", "knowledge_base_id", "document_id"]
CHUNK = [*DOCUMENT, "chunk_id"]
#: Rows that a bucket holds about, and the most buckets of a store.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 8192


class ChunkStore:
    """Chunks in buckets of documents under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "chunks")).rstrip("/")

    def create(self, chunks: DataFrame, buckets: int | None = None) -> ChunkStore:
        """Write all ``chunks``; the number of buckets stays, so choose it for the size that is to come."""
        n = buckets or min(MOST_BUCKETS, max(1, math.ceil(chunks.count() / BUCKET_ROWS)))
        about = self.spark.createDataFrame([(n, chunks.schema.json())], "buckets int, schema string")
        about.coalesce(1).write.parquet(f"{self.root}/about")
        self._write(chunks.withColumn("bucket", _bucket(n)).repartition(_tasks(n), "bucket"))
        return self

    def _about(self) -> tuple[int, StructType]:
        import json

        told = self.spark.read.parquet(f"{self.root}/about").first()
        return told.buckets, StructType.fromJson(json.loads(told.schema))

    def _write(self, dealt: DataFrame) -> None:
        """Put rows, dealt by bucket, in the place of what their buckets hold."""
        ordered = dealt.sortWithinPartitions("bucket", *DOCUMENT)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/rows")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All chunks, or those of some buckets."""
        _, schema = self._about()
        if not exists(self.spark, f"{self.root}/rows"):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(f"{self.root}/rows")
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("bucket")

    def _change(self, new: DataFrame, by: list[str]) -> list[int]:
        """Rows with the keys of ``new`` give way to its rows that are ``__fresh``; the numbers of the buckets that were rewritten.

        Old and new rows are dealt once and sorted once, as they are stored; what gives way
        is told there.  Spark writes beside the store and moves whole buckets in at the end, so what is read stays until then.
        """
        n, _ = self._about()
        buckets = sorted(r.bucket for r in new.select(_bucket(n).alias("bucket")).distinct().collect())  # MOST_BUCKETS at most
        if not buckets:
            return []
        before = self.files()
        both = self.read(buckets).withColumns({"__new": F.lit(0), "__fresh": F.lit(True)}).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        same = Window.partitionBy("bucket", *by)
        dealt = both.withColumn("bucket", _bucket(n)).repartition(_tasks(len(buckets)), "bucket")
        kept = dealt.withColumn("__last", F.max("__new").over(same)).where("__new = __last AND __fresh").drop("__new", "__last", "__fresh")
        self._write(kept)
        for b in _folders(before & self.files()) & {f"bucket={b}" for b in buckets}:  # nothing took their place
            discard(self.spark, f"{self.root}/rows/{b}")
        return buckets

    def replace_documents(self, new: DataFrame) -> list[int]:
        """All rows of the documents in ``new`` give way to it; the buckets that were rewritten."""
        new = materialize(new.select(*self._about()[1].names), "new-chunks")
        changed = self._change(new.withColumn("__fresh", F.lit(True)), DOCUMENT)
        release(new)
        return changed

    def upsert(self, new: DataFrame) -> list[int]:
        """Chunks of ``new`` take the place of those with the same key; rows without organisation or document are refused, of repeated keys one is taken."""
        valid = new.where((F.coalesce("organization_id", F.lit("")) != "") & F.col("document_id").isNotNull())
        new = materialize(valid.select(*self._about()[1].names).dropDuplicates(CHUNK), "new-chunks")
        changed = self._change(new.withColumn("__fresh", F.lit(True)), CHUNK)
        release(new)
        return changed

    def delete_documents(self, doomed: DataFrame) -> list[int]:
        """Drop these documents; unknown ones are ignored."""
        keys = materialize(doomed.select(*DOCUMENT).distinct(), "doomed-documents")
        changed = self._change(keys.withColumn("__fresh", F.lit(False)), DOCUMENT)
        release(keys)
        return changed

    def files(self) -> set[str]:
        """Names of the store's files, by bucket."""
        files, at = hadoop_path(self.spark, f"{self.root}/rows")
        folders = [f.getPath() for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []
        return {f"{p.getName()}/{f.getPath().getName()}" for p in folders for f in files.listStatus(p)}


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in DOCUMENT]), F.lit(n)).cast("int")


def _tasks(buckets: int) -> int:
    """Buckets are dealt by hash: with more tasks than buckets, fewer of them meet in one task's sort."""
    return max(buckets, min(4 * buckets, 512))


def _folders(files: set[str]) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in files}
