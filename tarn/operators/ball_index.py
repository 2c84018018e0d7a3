"""Exact nearest vectors by dot product without scanning all of them: a ball index.

Vectors are dealt to cells by their nearest pivot and written cell by cell; a cell
is known by its pivot and its radius, the distance of its farthest vector.  By
Cauchy and Schwarz no vector of a cell has a larger product with a question ``q``
than ``q.p + |q| r``.  A question is scored in the cells with the highest bounds
first; of the others only those whose bound reaches the score then found at its
last place are read.  Results are those of a full scan.

Pivots are a bounded sample by a hash of the key, so both they and the bounds fit
any task; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.session import exists, materialize, scratch_path, ship_package

#: The most pivots, and the vectors that a cell has about.
MOST_PIVOTS, CELL_ROWS = 4096, 2000
#: Cells that a question is scored in first; vectors and questions of a cell that meet in one unit.
FIRST_CELLS, UNIT_VECTORS, UNIT_QUESTIONS = 2, 20_000, 2000
#: Bounds and products are sums in different orders.
SLACK = 1e-6


class BallIndex:
    """Vectors in cells under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "balls")).rstrip("/")

    def build(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> BallIndex:
        """Index all ``vectors`` (one row a key); null vectors are left out."""
        ship_package(self.spark)
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        rows.select("key").limit(0).write.parquet(f"{self.root}/about")
        n = rows.count()
        wanted = cells or min(MOST_PIVOTS, max(1, math.ceil(n / CELL_ROWS)), max(1, math.isqrt(n)))
        picked = rows.orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(wanted).collect()  # MOST_PIVOTS vectors at most
        pivots = np.array([r.vector for r in picked])

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = (pivots * pivots).sum(axis=1)
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["vector"].to_numpy())
                cell = (size[None, :] - 2 * x @ pivots.T).argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), far=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))

        kind = rows.schema["key"].dataType.simpleString()
        dealt = rows.mapInPandas(deal, f"key {kind}, vector array<double>, cell int, far double")
        if not n:
            self.spark.createDataFrame([], "cell int, radius double, n long, pivot array<double>").write.parquet(f"{self.root}/cells")
            return self
        spread = max(1, math.ceil(n / max(1, wanted) / UNIT_VECTORS))
        dealt.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(spread))).write.partitionBy("cell").parquet(f"{self.root}/vectors")
        written = self.spark.read.schema(f"key {kind}, vector array<double>, far double, cell int").parquet(f"{self.root}/vectors")
        told = written.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        pivot = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
        told.join(F.broadcast(pivot), "cell").write.parquet(f"{self.root}/cells")
        return self

    def _vectors(self) -> DataFrame:
        key = self.spark.read.parquet(f"{self.root}/about").schema["key"].dataType.simpleString()
        if not exists(self.spark, f"{self.root}/vectors"):
            return self.spark.createDataFrame([], f"key {key}, vector array<double>, cell int")
        return self.spark.read.schema(f"key {key}, vector array<double>, cell int").parquet(f"{self.root}/vectors")

    def search_many(self, asked: DataFrame, top_k: int, stats: dict | None = None) -> DataFrame:
        """(query_id, key, score, rank) of ``asked`` (query_id, query_vector): nearest vectors other than a question's own. ``stats`` gets pairs of questions and cells: read, and in all."""
        asked = materialize(asked.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")), "asked-vectors")
        cells = self.spark.read.parquet(f"{self.root}/cells").drop("n").collect()  # MOST_PIVOTS rows at most
        numbers, radius = np.array([c.cell for c in cells], dtype=np.int32), np.array([c.radius for c in cells])
        pivots = np.array([c.pivot for c in cells])
        kind = asked.schema["query_id"].dataType.simpleString()

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(numbers):
                    continue
                q = np.stack(pdf["query_vector"].to_numpy())
                most = q @ pivots.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
                order = np.argsort(-most, axis=1, kind="stable")
                yield pd.DataFrame({
                    "query_id": np.repeat(pdf["query_id"].to_numpy(), len(numbers)), "cell": numbers[order].reshape(-1),
                    "bound": np.take_along_axis(most, order, axis=1).reshape(-1), "place": np.tile(np.arange(len(numbers)), len(pdf)),
                })

        bounds = materialize(asked.mapInPandas(bound, f"query_id {kind}, cell int, bound double, place long"), "cell-bounds")
        first = self._scored(asked, bounds.where(F.col("place") < FIRST_CELLS), top_k)
        first = materialize(first, "products-first")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        least = first.withColumn("rank", rank).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        rest = bounds.where(F.col("place") >= FIRST_CELLS).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        rest = materialize(rest.select("query_id", "cell"), "cells-more")
        if stats is not None:
            stats |= {"read": bounds.where(F.col("place") < FIRST_CELLS).count() + rest.count(), "all": bounds.count()}
        both = first.union(self._scored(asked, rest, top_k))
        return both.withColumn("rank", rank).where(F.col("rank") <= top_k)

    def _scored(self, asked: DataFrame, needed: DataFrame, top_k: int) -> DataFrame:
        """(query_id, key, score): the best of each needed cell for each question; cells meet their questions in units of bounded size."""
        met = needed.select("query_id", "cell").join(asked, "query_id")
        sizes = met.groupBy("cell").agg(F.count("*").alias("questions")).join(self.spark.read.parquet(f"{self.root}/cells").select("cell", "n"), "cell")
        units = materialize(sizes.select("cell", F.ceil(F.col("n") / UNIT_VECTORS).cast("int").alias("i_n"), F.ceil(F.col("questions") / UNIT_QUESTIONS).cast("int").alias("j_n")), "ball-units")
        units = F.broadcast(units)  # MOST_PIVOTS rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = met.join(units, "cell").select("cell", every("i_n").alias("i"), part("query_id", "j_n").alias("j"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(self._vectors().schema["key"].dataType).alias("key"), F.col("query_vector").alias("vector"))
        v = self._vectors().join(units, "cell").select("cell", part("key", "i_n").alias("i"), every("j_n").alias("j"), F.lit(1).alias("side"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "key", "vector")
        id_kind, key_kind = asked.schema["query_id"].dataType.simpleString(), self._vectors().schema["key"].dataType.simpleString()

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            mine, theirs = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"query_id": [], "key": [], "score": []})
            ids, keys = mine["query_id"].to_numpy(), theirs["key"].to_numpy()
            scores = np.stack(theirs["vector"].to_numpy()) @ np.stack(mine["vector"].to_numpy()).T
            scores[keys[:, None] == ids[None, :]] = -np.inf
            least = np.partition(scores, -min(top_k, len(keys)), axis=0)[-min(top_k, len(keys))]
            at, of = np.nonzero((scores >= least[None, :]) & (scores > -np.inf))
            return pd.DataFrame({"query_id": ids[of], "key": keys[at], "score": scores[at, of]})

        return q.union(v).groupBy("cell", "i", "j").applyInPandas(best, f"query_id {id_kind}, key {key_kind}, score double")
