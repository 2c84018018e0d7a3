"""Log analytics over ``events`` as a request log, unanswered questions over ``conversations``."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import logs, unanswered

SINCE = datetime.datetime(2024, 1, 10)
SEARCHES = ["E_li", "REQ-1", "page for user 1", "h2.EXAMPLE", '"k": 8', "10.0.0.7", "kb3", "key_", "cred1", "post", "%", "x_y"]


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind, user = F.col("event_type"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(kind == "error", 500).when(F.col("event_id") % 10 == 3, 429).when(F.col("event_id") % 17 == 0, 404).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), kind).alias("path"),
        F.concat(F.lit("10.0.0."), user.cast("string")).alias("client_ip"),
        F.when(user % 3 != 0, F.concat(F.lit("key"), (user % 7).cast("string"))).alias("key_id"),
        F.when(user % 5 != 0, F.concat(F.lit("kb"), (user % 4).cast("string"))).alias("knowledge_base_id"),
        F.col("props").alias("query"),
        F.concat(F.lit("req-"), F.hex("event_id")).alias("request_id"),
        F.when(F.col("event_id") % 10 == 3, "E_LIMIT").when(kind == "error", "E_SERVER").alias("error_code"),
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("No page for user "), user.cast("string"))).alias("detail"),
        F.concat(F.lit("h"), (user % 3).cast("string"), F.lit(".example")).alias("host"),
        F.concat(F.lit("cred"), (user % 2).cast("string")).alias("credential"),
        F.when(user % 2 == 0, "ID").otherwise("NL").alias("country"),
    )


LOG = """WITH l AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 3 THEN 429 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status,
  value AS latency_ms, 'POST' AS method, '/' || event_type AS path, '10.0.0.' || user_id AS client_ip, CASE WHEN user_id % 3 <> 0 THEN 'key' || (user_id % 7) END AS key_id,
  CASE WHEN user_id % 5 <> 0 THEN 'kb' || (user_id % 4) END AS knowledge_base_id,
  props AS query, 'req-' || hex(event_id) AS request_id, CASE WHEN event_id % 10 = 3 THEN 'E_LIMIT' WHEN event_type = 'error' THEN 'E_SERVER' END AS error_code,
  CASE WHEN event_id % 17 = 0 THEN 'No page for user ' || user_id END AS detail, 'h' || (user_id % 3) || '.example' AS host, 'cred' || (user_id % 2) AS credential, CASE WHEN user_id % 2 = 0 THEN 'ID' ELSE 'NL' END AS country FROM events)
"""
COUNTS = "count(*) AS count, count(*) FILTER (WHERE status = 429) AS rate_limited, count(*) FILTER (WHERE status >= 400 AND status <> 429) AS errors"


def _of(f, *args, **kw):
    return lambda spark, d: f(_log(spark, d), *args, **kw)


def log_filter(spark, d):
    return logs.filtered(_log(spark, d), since=SINCE, status="errors", search="Y3", method="POST").select("id", "status", "path")


def log_search(spark, d):
    """A free search in each of the columns that it looks at, and in two that it doesn't."""
    found = [logs.filtered(_log(spark, d), search=s).groupBy().agg(F.count("*").alias("count"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids")).withColumn("search", F.lit(s)) for s in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def log_by_source(spark, d):
    return logs.by_source(_log(spark, d), 15).select("client_ip", "key_id", "count", "rate_limited", "errors", "avg_latency_ms")


def log_by_knowledge_base(spark, d):
    return logs.by_knowledge_base(_log(spark, d), 10).select("knowledge_base_id", "count", "callers", "errors")


def log_labels(spark, d):
    labels = spark.createDataFrame([("key1", "app one"), ("key2", "app two")], "key_id string, label string")
    return logs.with_labels(_log(spark, d), labels).groupBy("label").agg(F.count("*").alias("count"))


def log_retention(spark, d):
    return logs.retained(_log(spark, d), SINCE, 500).select("id", "status")


def log_windows(spark, d):
    """Tumbling and sliding event-time windows over the same log."""
    log = _log(spark, d)
    tumbling = log.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum((F.col("status") >= 400).cast("long")).alias("errors"))
    return tumbling.select(F.col("window.start").cast("string").alias("start"), "n", "errors")


def rolling_minute(spark, d):
    """For each request, how many its client sent in the 60 seconds up to it."""
    return logs.in_last(_log(spark, d), "client_ip", 60, "in_minute").select("id", "in_minute")


def _asked(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    return c.select(
        F.lit("org").alias("organization_id"),
        F.concat(F.lit("kb"), (F.col("conv_id") % 3).cast("string")).alias("knowledge_base_id"),
        F.col("text").alias("query"),
        F.when(F.col("turn") == 0, "no_candidates").otherwise("below_min_relevance").alias("reason"),
        (F.col("turn") / 10.0).alias("best_score"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
    )


def unanswered_upsert(spark, d):
    asked = _asked(spark, d)
    early, late = asked.where("seq % 2 = 0"), asked.where("seq % 2 = 1")
    table = unanswered.upsert(late, unanswered.upsert(early))
    return table.select("knowledge_base_id", "query_key", "query", "reason", "best_score", "count", "status")


def unanswered_frequent(spark, d):
    return unanswered.frequent(unanswered.upsert(_asked(spark, d)), 25).select("knowledge_base_id", "query_key", "count")


def unanswered_recent(spark, d):
    return unanswered.recent(unanswered.upsert(_asked(spark, d)), 25).select("knowledge_base_id", "query_key", "count")


def unanswered_status_counts(spark, d):
    table = unanswered.upsert(_asked(spark, d))
    marked = table.withColumn("status", F.when(F.col("count") > 1, "resolved").otherwise(F.col("status")))
    return unanswered.status_counts(marked)


def unanswered_purge(spark, d):
    return unanswered.purge(unanswered.upsert(_asked(spark, d)), datetime.datetime(2024, 1, 1, 1), 40).select("knowledge_base_id", "query_key")


ASKED = r"""WITH a AS (SELECT 'kb' || (conv_id % 3) AS knowledge_base_id, text AS query, CASE WHEN turn = 0 THEN 'no_candidates' ELSE 'below_min_relevance' END AS reason,
  round(turn / 10.0::DOUBLE, 4) AS best_score, conv_id * 100 + turn AS seq, conv_id * 60 + turn AS t FROM conversations WHERE role = 'user'),
k AS (SELECT *, substr(regexp_replace(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), 1, 500) AS query_key FROM a),
u AS (SELECT knowledge_base_id, query_key, substr(trim(arg_max(query, t * 100000 + seq)), 1, 2000) AS query, arg_max(reason, t * 100000 + seq) AS reason, arg_max(best_score, t * 100000 + seq) AS best_score,
  count(*) AS count, 'open' AS status, max(t) AS last_seen FROM k WHERE query_key <> '' GROUP BY ALL)
"""

QUERIES = {
    "log_totals": _of(logs.totals),
    "log_series": _of(logs.series, 10800),
    "log_by_path": _of(logs.by_path, 10),
    "log_p95": _of(logs.latency_at, 0.95),
    "metrics_snapshot": _of(logs.snapshot),
    "log_page": _of(logs.page, 20, 40, 100),
    **{
        f.__name__: f
        for f in (
            log_filter, log_search, log_by_source, log_by_knowledge_base, log_labels, log_retention, log_windows, rolling_minute, unanswered_upsert, unanswered_frequent,
            unanswered_recent, unanswered_status_counts, unanswered_purge,
        )
    },
}
ORACLE_SQL = {
    "log_totals": LOG + """SELECT count(*) AS total, count(*) FILTER (WHERE status < 400) AS ok, count(*) FILTER (WHERE status = 429) AS rate_limited, count(*) FILTER (WHERE status >= 400 AND status < 500 AND status <> 429) AS client_errors,
count(*) FILTER (WHERE status >= 500) AS server_errors, round(avg(latency_ms), 2) AS avg_latency_ms, round(max(latency_ms), 2) AS max_latency_ms, count(DISTINCT client_ip) AS clients FROM l""",
    "log_series": LOG + f"SELECT floor(epoch(ts) / 10800)::BIGINT * 10800 AS t, {COUNTS} FROM l GROUP BY 1",
    "log_by_path": LOG + f"SELECT method, path, {COUNTS}, round(avg(latency_ms), 2) AS avg_latency_ms FROM l GROUP BY ALL ORDER BY count DESC, method, path LIMIT 10",
    "log_p95": LOG + ", r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n FROM l WHERE latency_ms IS NOT NULL) SELECT round(max(latency_ms), 2) AS latency_ms FROM r WHERE k = least(n - 1, floor(n * 0.95)::BIGINT)",
    "metrics_snapshot": LOG + """, v AS (SELECT list_sort(list(latency_ms)) AS v FROM (SELECT latency_ms FROM l ORDER BY ts DESC, id DESC LIMIT 2048))
SELECT round(list_sum(v) / len(v), 4) AS avg, round(v[round(0.95 * len(v))::INT], 4) AS p95, round(v[round(0.99 * len(v))::INT], 4) AS p99, round(v[-1], 4) AS max FROM v""",
    "log_page": LOG + "SELECT * FROM l WHERE id > 100 ORDER BY id DESC LIMIT 20 OFFSET 40",
    "log_filter": LOG + "SELECT id, status, path FROM l WHERE ts >= TIMESTAMP '2024-01-10' AND status >= 400 AND (path ILIKE '%y3%' OR client_ip ILIKE '%y3%' OR coalesce(key_id ILIKE '%y3%', false) OR coalesce(knowledge_base_id ILIKE '%y3%', false) OR coalesce(query ILIKE '%y3%', false) OR request_id ILIKE '%y3%' OR coalesce(detail ILIKE '%y3%', false) OR coalesce(error_code ILIKE '%y3%', false) OR host ILIKE '%y3%')",
    "log_search": LOG + " UNION ALL ".join(f"SELECT '{x}' AS search, count(*) AS count, coalesce(sum(id), 0)::BIGINT AS ids FROM l WHERE contains(lower(concat_ws(chr(1), path, query, client_ip, key_id, knowledge_base_id, request_id, detail, error_code, host)), lower('{x}'))" for x in SEARCHES),
    "log_by_source": LOG + f"SELECT client_ip, key_id, {COUNTS}, round(avg(latency_ms), 2) AS avg_latency_ms FROM l GROUP BY ALL ORDER BY count DESC, client_ip, key_id LIMIT 15",
    "log_by_knowledge_base": LOG + "SELECT knowledge_base_id, count(*) AS count, count(DISTINCT coalesce(key_id, '') || '|' || client_ip) AS callers, count(*) FILTER (WHERE status >= 400 AND status <> 429) AS errors FROM l WHERE knowledge_base_id IS NOT NULL GROUP BY 1",
    "log_labels": LOG + "SELECT CASE key_id WHEN 'key1' THEN 'app one' WHEN 'key2' THEN 'app two' END AS label, count(*) AS count FROM l GROUP BY 1",
    "log_retention": LOG + "SELECT id, status FROM l WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY id DESC LIMIT 500",
    "log_windows": LOG + "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE status >= 400) AS errors FROM l GROUP BY 1",
    "rolling_minute": LOG + "SELECT id, count(*) OVER (PARTITION BY client_ip ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute FROM l",
    "unanswered_upsert": ASKED + "SELECT knowledge_base_id, query_key, query, reason, best_score, count, status FROM u",
    "unanswered_frequent": ASKED + "SELECT knowledge_base_id, query_key, count FROM u ORDER BY count DESC, last_seen DESC, knowledge_base_id, query_key LIMIT 25",
    "unanswered_recent": ASKED + "SELECT knowledge_base_id, query_key, count FROM u ORDER BY last_seen DESC, knowledge_base_id, query_key LIMIT 25",
    "unanswered_status_counts": ASKED + "SELECT CASE WHEN count > 1 THEN 'resolved' ELSE 'open' END AS status, count(*) AS count, count(DISTINCT knowledge_base_id) AS knowledge_bases FROM u GROUP BY 1",
    "unanswered_purge": ASKED + "SELECT knowledge_base_id, query_key FROM u WHERE last_seen >= 3600 ORDER BY last_seen DESC, knowledge_base_id, query_key LIMIT 40",
}
