"""Questions that got no answer: upsert by question, views and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import query_key
from tarn.operators.skew import join_hot

KEYS = ["organization_id", "knowledge_base_id", "query_key"]
#: Pieces that an organisation's time is cut into when its oldest questions go.
PARTS = 1024
#: Fixed values.
STATUSES = ("open", "resolved")


def upsert(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The table after ``events`` (organization_id, knowledge_base_id, query, reason, best_score, ts, seq).

    A question is counted again under its key: the newest text, reason and
    score stand, the first sighting stays, and it is open again.  One shuffle.
    """
    rows = events.select(
        "organization_id",
        F.coalesce("knowledge_base_id", F.lit("")).alias("knowledge_base_id"),
        F.substring(query_key(F.col("query")), 1, 500).alias("query_key"),
        F.struct("ts", "seq", F.substring(F.trim("query"), 1, 2000).alias("query"), F.coalesce("reason", F.lit("")).alias("reason"), F.round("best_score", 4).alias("best_score")).alias("last"),
        F.lit(1).cast("long").alias("count"),
        F.col("ts").alias("first_seen"),
        F.lit("open").alias("status"),
    ).where((F.col("query_key") != "") & F.col("organization_id").isNotNull() & (F.col("organization_id") != ""))
    if existing is not None:
        old = F.struct(F.col("last_seen").alias("ts"), F.lit(-1).cast("long").alias("seq"), "query", "reason", "best_score")
        rows = rows.unionByName(existing.select(*KEYS, old.alias("last"), "count", "first_seen", "status"))
    merged = rows.groupBy(*KEYS).agg(
        F.max("last").alias("last"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max_by("status", F.col("last")).alias("status")
    )
    return merged.select(*KEYS, "last.query", "last.reason", "last.best_score", "count", "status", "first_seen", F.col("last.ts").alias("last_seen"))


def frequent(table: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return table.orderBy(F.desc("count"), F.desc("last_seen"), *KEYS).offset(offset).limit(limit)


def recent(table: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return table.orderBy(F.desc("last_seen"), *KEYS).offset(offset).limit(limit)


def status_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("status").agg(F.count("*").alias("count"), F.countDistinct("knowledge_base_id").alias("knowledge_bases"))


def with_status(table: DataFrame, org: str, key: str, status: str, note: str | None = None) -> DataFrame:
    hit = (F.col("organization_id") == org) & (F.col("query_key") == key)
    return table.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def without(table: DataFrame, doomed: DataFrame) -> DataFrame:
    return table.join(doomed, KEYS, "left_anti")


def purge(table: DataFrame, since, newest: int) -> DataFrame:
    """Rows seen since then, the ``newest`` of each organisation.

    An organisation's time is cut into ``PARTS``; counts tell which parts are
    kept whole and in which one the cut lies, so only that part is sorted.
    """
    org, at = "organization_id", F.unix_micros(F.col("last_seen").cast("timestamp"))
    young = table.where(F.col("last_seen") >= F.lit(since))
    ends = young.groupBy(org).agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.count("*").alias("__n"))
    ends = ends.withColumn("__all", F.col("__n"))
    told = join_hot(young, ends, [org], "__n", young.count(), KEYS)
    part = F.floor((F.col("__last") - at) / (F.col("__last") - F.col("__first") + 1) * PARTS).cast("int")
    told = told.withColumn("__part", part)
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(org).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = told.groupBy(org, "__part").agg(F.count("*").alias("__n")).withColumn("__before", before)  # PARTS rows an organisation
    parts = parts.where(F.col("__before") < newest).withColumn("__cut", F.col("__before") + F.col("__n") > newest)
    met = told.join(parts.drop("__n"), [org, "__part"])
    place = F.row_number().over(Window.partitionBy(org, "__part").orderBy(F.desc("last_seen"), *KEYS)) + F.col("__before")
    kept = met.where("NOT __cut").unionByName(met.where("__cut").withColumn("__place", place).where(F.col("__place") <= newest).drop("__place"))
    return kept.select(*table.columns)


def filtered(table: DataFrame, organization_id: str, knowledge_base_id: str | None = None, allowed: tuple[str, ...] = (), status: str | None = None, search: str = "") -> DataFrame:
    """One organisation's questions, narrowed by knowledge base, by what the caller may see, by status and by words of the question; an unknown status is ignored."""
    found = table.where(F.col("organization_id") == organization_id)
    if knowledge_base_id:
        found = found.where(F.col("knowledge_base_id") == knowledge_base_id)
    if allowed:
        found = found.where(F.col("knowledge_base_id").isin(*allowed))
    if status in STATUSES:
        found = found.where(F.col("status") == status)
    if search:
        found = found.where(F.contains("query_key", F.regexp_replace(query_key(F.lit(search)), "[%_]", "")))
    return found
