"""Replay of a sliding-window rate limit. Refused requests don't count, so each identity's requests are folded in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 60.0


def decide(times: list[float], limit: int, window: float = WINDOW) -> list[bool]:
    """Which of the requests at ``times`` (ascending seconds) pass."""
    recent: deque[float] = deque()
    out = []
    for now in times:
        while recent and recent[0] < now - window:
            recent.popleft()
        passed = limit <= 0 or len(recent) < limit
        if passed and limit > 0:
            recent.append(now)
        out.append(passed)
    return out


def replay(requests: DataFrame, limit: int) -> DataFrame:
    """(identity, id, seconds, passed) of (identity, id, seconds).

    A request looks back one minute at most, so an empty minute parts what can
    be decided apart: an identity's runs of minutes with requests go to tasks of
    their own.  Sorted partitions are streamed; a task holds the last minute of
    one run, never a whole group.  Only a run without any idle minute is bound
    to one task, as its every decision rests on the one before.
    """
    kind = requests.schema["id"].dataType.simpleString()
    rows = requests.select("identity", "id", "seconds", F.floor(F.col("seconds") / WINDOW).alias("minute"))
    busy = rows.select("identity", "minute").distinct()
    before = Window.partitionBy("identity").orderBy("minute")
    begins = (F.col("minute") - F.coalesce(F.lag("minute").over(before), F.lit(-2)) > 1).cast("long")
    runs = busy.withColumn("begins", begins).withColumn("run", F.sum("begins").over(before)).drop("begins")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent = None, deque()
        for pdf in batches:
            passed = []
            for identity, part, now in zip(pdf["identity"], pdf["run"], pdf["seconds"], strict=True):
                if (identity, part) != who:
                    who, recent = (identity, part), deque()
                while recent and recent[0] < now - WINDOW:
                    recent.popleft()
                ok = limit <= 0 or len(recent) < limit
                if ok:
                    recent.append(now)
                passed.append(ok)
            yield pdf.assign(passed=passed)[["identity", "id", "seconds", "passed"]]

    dealt = rows.join(runs, ["identity", "minute"]).repartition("identity", "run").sortWithinPartitions("identity", "run", "seconds", "id")
    return dealt.select("identity", "id", "seconds", "run").mapInPandas(run, f"identity string, id {kind}, seconds double, passed boolean")


def concurrent(requests: DataFrame, slice_width: int = 3_600_000_000) -> DataFrame:
    """The most requests (identity, start, end) that an identity had open at once: a running sum of starts and ends.

    Times are cut into slices; what is open when a slice begins is the sum of
    all slices before it, so a busy identity is spread over its slices.
    """
    ends = requests.select("identity", F.col("end").alias("at"), F.lit(-1).alias("d"))
    steps = requests.select("identity", F.col("start").alias("at"), F.lit(1).alias("d")).union(ends).withColumn("slice", F.floor(F.col("at") / slice_width))
    before = Window.partitionBy("identity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    open_ = steps.groupBy("identity", "slice").agg(F.sum("d").alias("net")).select("identity", "slice", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    run = F.sum("d").over(Window.partitionBy("identity", "slice").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("run", run).join(open_, ["identity", "slice"]).groupBy("identity").agg(F.max(F.col("base") + F.col("run")).alias("most_open"))
