"""Documents, jobs and knowledge bases, and changes to stored tables.

Parquet has no row updates: a change is a new snapshot, written whole to a new
place and swapped by the caller, so readers never see half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["organization_id", "knowledge_base_id", "document_id", "chunk_id"]


def latest_jobs(jobs: DataFrame, include_deleted: bool = False) -> DataFrame:
    """The newest job of each document. One aggregate, no sort."""
    rest = [c for c in jobs.columns if c not in KEY[:3]]
    newest = jobs.groupBy(*KEY[:3]).agg(F.max(F.struct("updated_at", *[c for c in rest if c != "updated_at"])).alias("j"))
    out = newest.select(*KEY[:3], *[F.col(f"j.{c}").alias(c) for c in rest])
    return out if include_deleted else out.where("status <> 'deleted'")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("count"))


def document_counts(chunks: DataFrame) -> DataFrame:
    """Content chunks of each document."""
    content = chunks.where(~F.coalesce(F.col("is_summary"), F.lit(False)))
    return content.groupBy(*KEY[:3]).agg(F.count("*").alias("chunks"))


def documents(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The document list: newest jobs with stored counts, then stored documents that no job knows."""
    counts = document_counts(chunks)
    known = latest_jobs(jobs).select(*KEY[:3], "status", "updated_at")
    listed = known.join(counts, KEY[:3], "left").withColumn("vectors_in_store", F.coalesce("chunks", F.lit(0))).drop("chunks")
    orphans = counts.join(jobs.select(*KEY[:3]).distinct(), KEY[:3], "left_anti").select(
        *KEY[:3], F.lit("completed").alias("status"), F.lit(None).cast(known.schema["updated_at"].dataType).alias("updated_at"), F.col("chunks").alias("vectors_in_store")
    )
    return listed.unionByName(orphans)


def knowledge_bases(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per knowledge base: what jobs say, corrected by what can be searched."""
    by = KEY[:2]
    known = latest_jobs(jobs).groupBy(*by).agg(
        F.count("*").alias("jd"), F.sum("chunks").alias("jc"), F.sum("tokens").alias("tokens"),
        F.sum((F.col("status") == "completed").cast("long")).alias("completed"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"),
        F.sum((~F.col("status").isin("completed", "failed")).cast("long")).alias("processing"), F.max("updated_at").alias("updated_at"),
    )
    stored = document_counts(chunks).groupBy(*by).agg(F.count("*").alias("sd"), F.sum("chunks").alias("sc"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = known.join(stored, by, "full_outer")
    none = zero("completed") + zero("processing") + zero("failed") == 0
    out = met.select(
        *by, F.greatest(zero("jd"), zero("sd")).alias("documents"), F.when(zero("sc") > 0, F.col("sc")).otherwise(zero("jc")).alias("chunks"), zero("tokens").alias("tokens"),
        F.when(none, zero("sd")).otherwise(zero("completed")).alias("completed"), zero("processing").alias("processing"), zero("failed").alias("failed"), "updated_at",
    )
    return out.where((F.col("knowledge_base_id") != "") & ((F.col("documents") > 0) | (F.col("processing") > 0)))


def replace_document(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after all rows of the documents in ``new`` gave way to it."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_documents(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """New rows win over stored ones of the same key; rows without organisation or document are refused."""
    valid = new.where((F.coalesce(keys[0], F.lit("")) != "") & F.col("document_id").isNotNull())
    return table.join(valid.select(*keys), keys, "left_anti").unionByName(valid)


def missing(source: DataFrame, target: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows that a migration still has to copy."""
    return source.join(target.select(*keys), keys, "left_anti")


def document_chunks(chunks: DataFrame, document_id, include_summary: bool = False) -> DataFrame:
    """One document's chunks in order: by index, else by the digits that end the chunk's name."""
    rows = chunks.where(F.col("document_id") == document_id)
    if not include_summary:
        rows = rows.where(~F.coalesce(F.col("is_summary"), F.lit(False)))
    place = F.coalesce(F.col("chunk_index"), F.regexp_extract("chunk_id", r"_(\d+)$", 1).try_cast("int"), F.lit(0))
    return rows.orderBy(place, "chunk_id")


#: Fixed value: the namespace of addresses in name-based identifiers.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(*path: Column, prefix: str = "") -> Column:
    """A stable identifier of a chunk: a name-based UUID (version 5) of its tenant, knowledge base, document and own name; nulls count as empty."""
    name = F.concat(F.lit(prefix), F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in path]))
    made = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), name.cast("binary")))
    variant = F.translate(F.substring(made, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")  # its two highest bits are 1 and 0
    return F.concat_ws("-", F.substring(made, 1, 8), F.substring(made, 9, 4), F.concat(F.lit("5"), F.substring(made, 14, 3)), F.concat(variant, F.substring(made, 18, 3)), F.substring(made, 21, 12))


def by_keys(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Late materialisation: whole rows of (document_id, chunk_id) keys; the first of each key."""
    asked = keys.select("document_id", "chunk_id").distinct()
    return chunks.join(asked, ["document_id", "chunk_id"], "left_semi").dropDuplicates(["document_id", "chunk_id"])
