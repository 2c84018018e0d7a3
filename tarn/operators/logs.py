"""Request-log analytics. Columns: id, ts (timestamp), status, latency_ms, method, path, client_ip, key_id, application_id, user_id, credential, knowledge_base_id, country, host, user_agent, origin, referer, query, request_id, detail, error_code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that a free search looks at; a chart's minutes and the width of its bars in seconds.
BUCKETS = ((15, 15), (60, 60), (360, 300), (1440, 1800), (10080, 10800))
WIDEST = 21600
SEARCHED = (
    "path", "query", "client_ip", "origin", "referer", "user_agent", "application_id", "user_id", "key_id", "knowledge_base_id", "request_id", "detail", "error_code", "host",
)


def bucket_seconds(minutes: int) -> int:
    return next((seconds for limit, seconds in BUCKETS if minutes <= limit), WIDEST)


def status_class(name: str) -> Column:
    s = F.col("status")
    if name == "429":
        return s == 429
    if name == "errors":
        return s >= 400
    return (s >= int(name[0]) * 100) & (s < (int(name[0]) + 1) * 100)


def filtered(log: DataFrame, since=None, status: str | None = None, search: str | None = None, labelled_keys: list[str] | None = None, **exact) -> DataFrame:
    """Rows that meet every filter; ``search`` is looked for in any text column, or in a key's label."""
    found = log
    if since is not None:
        found = found.where(F.col("ts") >= F.lit(since))
    if status:
        found = found.where(status_class(status))
    for column, value in exact.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    if search:
        pattern = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        there = [F.col(c).ilike(pattern) for c in SEARCHED if c in log.columns]
        if labelled_keys:
            there.append(F.col("key_id").isin(*labelled_keys))
        found = found.where(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in there]), F.lit(False)))
    return found


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


LIMITED = lambda: F.col("status") == 429
FAILED = lambda: (F.col("status") >= 400) & (F.col("status") != 429)


def totals(log: DataFrame) -> DataFrame:
    s = F.col("status")
    return log.agg(
        F.count("*").alias("total"),
        _sum((s >= 200) & (s < 400)).alias("ok"),
        _sum(LIMITED()).alias("rate_limited"),
        _sum((s >= 400) & (s < 500) & (s != 429)).alias("client_errors"),
        _sum(s >= 500).alias("server_errors"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.max("latency_ms"), 2).alias("max_latency_ms"),
        F.countDistinct("client_ip").alias("clients"),
    )


def series(log: DataFrame, seconds: int) -> DataFrame:
    at = F.floor(F.unix_timestamp("ts") / F.lit(max(1, seconds))).cast("long") * max(1, seconds)
    return log.groupBy(at.alias("t")).agg(F.count("*").alias("count"), _sum(LIMITED()).alias("rate_limited"), _sum(FAILED()).alias("errors"))


def top_by(log: DataFrame, keys: list[str], top: int, *more: Column) -> DataFrame:
    """The most frequent values of ``keys``; ties by key."""
    grouped = log.groupBy(*keys).agg(
        F.count("*").alias("count"), _sum(LIMITED()).alias("rate_limited"), _sum(FAILED()).alias("errors"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"), *more
    )
    return grouped.orderBy(F.desc("count"), *keys).limit(top)


def by_source(log: DataFrame, top: int = 20) -> DataFrame:
    keys = [c for c in ("client_ip", "key_id", "application_id", "user_id", "credential") if c in log.columns]
    return top_by(log, keys, top, F.max("ts").alias("last_seen"))


def by_path(log: DataFrame, top: int = 20) -> DataFrame:
    return top_by(log, ["method", "path"], top)


def by_knowledge_base(log: DataFrame, top: int = 20) -> DataFrame:
    caller = F.concat_ws("|", F.coalesce("key_id", F.lit("")), F.coalesce("client_ip", F.lit("")))
    return top_by(log.where(F.coalesce("knowledge_base_id", F.lit("")) != ""), ["knowledge_base_id"], top, F.countDistinct(caller).alias("callers"), F.max("ts").alias("last_seen"))


def latency_at(log: DataFrame, share: float) -> DataFrame:
    """One row: the latency at place floor(n * share), from 0, of the sorted list.

    Found by counting: latencies are grouped by value, so what is sorted is
    distinct values, and only running counts are compared.
    """
    values = log.where(F.col("latency_ms").isNotNull()).groupBy("latency_ms").agg(F.count("*").alias("c"))
    n = values.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    # rough ranges first, so that no task sorts all values
    cut = values.crossJoin(F.broadcast(values.agg(F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("latency_ms") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1023)).otherwise(0).cast("int")
    cut = cut.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("part").agg(F.sum("c").alias("pc")).withColumn("base", F.coalesce(F.sum("pc").over(before), F.lit(0)))  # 1024 rows at most
    inside = Window.partitionBy("part").orderBy("latency_ms")
    run = cut.join(F.broadcast(parts), "part").withColumn("upto", F.col("base") + F.sum("c").over(inside))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share)).cast("long"))
    return run.crossJoin(F.broadcast(n)).where(F.col("upto") > place).agg(F.round(F.min("latency_ms"), 2).alias("latency_ms"))


def snapshot(log: DataFrame, last: int = 2048) -> DataFrame:
    """avg, p95, p99 and max of the last samples (a ring of ``last`` values)."""
    tail = log.orderBy(F.desc("ts"), F.desc("id")).limit(last).agg(F.sort_array(F.collect_list("latency_ms")).alias("v"))
    n = F.size("v")
    at = lambda p: F.element_at("v", F.greatest(F.lit(1), F.least(n, F.round(F.lit(p / 100) * n).cast("int"))))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n
    return tail.select(F.round(mean, 4).alias("avg"), F.round(at(95), 4).alias("p95"), F.round(at(99), 4).alias("p99"), F.round(F.element_at("v", -1), 4).alias("max"))


def page(log: DataFrame, limit: int, offset: int = 0, after_id: int | None = None) -> DataFrame:
    rows = log if after_id is None else log.where(F.col("id") > after_id)
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit)


def retained(log: DataFrame, since, newest: int) -> DataFrame:
    """Rows young enough, and among the ``newest`` by id."""
    young = log.where(F.col("ts") >= F.lit(since))
    least = young.orderBy(F.desc("id")).limit(newest).agg(F.min("id").alias("least"))
    return young.crossJoin(F.broadcast(least)).where(F.col("id") >= F.col("least")).drop("least")


def in_last(log: DataFrame, by: str, seconds: int, out: str = "in_last") -> DataFrame:
    """Each request with how many of the same ``by`` came in the ``seconds`` up to it.

    Time is cut into slices of that width; a request counts in its own slice
    and the next one, so a busy caller is spread over slices.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.withColumn("__at", at).withColumn("__own", F.floor(F.col("__at") / width))
    both = rows.withColumn("__slice", F.explode(F.array("__own", F.col("__own") + 1)))
    window = Window.partitionBy(by, "__slice").orderBy("__at").rangeBetween(-width, 0)
    return both.withColumn(out, F.count("*").over(window)).where("__slice = __own").drop("__at", "__own", "__slice")


def with_labels(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row with its key's label, if it has one."""
    return log.join(labels, "key_id", "left")


def recorded(requests: DataFrame, skipped: tuple[str, ...] = (), own: str = "/logs") -> DataFrame:
    """Requests that a log keeps: none to a skipped path or below one, none to the log's own pages (by their prefix)."""
    path = F.col("path")
    found = ~F.startswith(path, F.lit(own))
    for item in (s.strip() for s in skipped if s.strip()):
        found &= ~((path == item) | F.startswith(path, F.lit(item.rstrip("/") + "/")))
    return requests.where(found)
