"""Connected components by alternating large and small stars.

Edges stay distributed; every round is written to the shared folder, so a lost
executor costs one round at most and plans stay short.  The centre of a star may
have a third of all nodes around it: its edges are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import join_hot
from tarn.session import discard, materialize, scratch_path


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large star: link each node's larger neighbours to its smallest one. Small star: the smaller ones, and itself."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("copies"))
    met = join_hot(edges, least, ["u"], "copies", total, ["v"])
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select("v", "m").union(least.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v), label being the smallest node it can reach.

    Self-loops and repeated edges are allowed. No edges give no rows.  Labels of
    an earlier run, as edges, settle in few rounds.
    """
    spark = edges.sparkSession
    order = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    path = scratch_path(spark, "edges")
    now, mark = materialize(edges.where("u <> v").select(*order).distinct(), "edges", path), None
    for _ in range(most_rounds):
        n = now.count()
        if not n:
            break
        last, path = path, scratch_path(spark, "edges")
        now = materialize(_star(_star(now, True, 2 * n).distinct(), False, n).distinct(), "edges", path)
        discard(spark, last)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen.n, seen.s):
            break
        mark = seen.n, seen.s
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
