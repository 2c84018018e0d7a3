"""Joins on keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds over 1/HOT_SHARE of all rows (and over HOT_LEAST), so there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 2000, 256
_SALTS, _SALT = "__tarn_salts", "__tarn_salt"


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], copies: str, total: int, spread_by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which has one row a key and says in ``copies`` how many of ``rows`` carry it.

    The rows of a hot key are dealt over salts by a hash of ``spread_by``, and
    its row of ``side`` is repeated for each salt, so no task meets more than
    about ``total / HOT_SHARE`` rows of one key.  ``copies`` is dropped.
    """
    hot_from = max(HOT_LEAST, total // HOT_SHARE)
    salts = F.when(F.col(copies) > hot_from, F.ceil(F.col(copies) / hot_from)).otherwise(1).cast("int")
    side = side.withColumn(_SALTS, salts).drop(copies)
    hot = F.broadcast(side.where(F.col(_SALTS) > 1).select(*keys, _SALTS))  # fewer than HOT_SHARE rows
    salted = rows.join(hot, keys, "left").withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col(_SALTS), F.lit(1))).cast("int")).drop(_SALTS)
    spread = side.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.col(_SALTS) - 1))).drop(_SALTS)
    return salted.join(spread, [*keys, _SALT], how).drop(_SALT)
