"""Exact quantiles and top-k without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlake.operators.ordered import running


def exact_quantile(df: DataFrame, column: str, probs: dict[str, float], width: float,
                   by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group; ``width`` is the value range of one sorted slice.

    Values are counted first; their running count is taken per value slice, so a large group is sorted
    by many tasks.  An empty input gives no row per group, or one row of NULLs without ``by``.
    """
    values = (df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    ranked = running(values, list(by), "_v", [], width, {"_cum": ("sum", "_c")})
    totals = values.groupBy(*by).agg(F.sum("_c").alias("_n"))
    joined = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))
    parts = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("_n") - 1)
        parts += [F.min(F.when(F.col("_cum") > F.floor(place), F.col("_v"))).alias(f"_lo_{name}"),
                  F.min(F.when(F.col("_cum") > F.ceil(place), F.col("_v"))).alias(f"_hi_{name}"),
                  F.max(place - F.floor(place)).alias(f"_f_{name}")]
    found = joined.groupBy(*by).agg(*parts)
    return found.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: Sequence[str],
          rank: str | None = None, salts: int = 64) -> DataFrame:
    """First ``k`` rows per key.  Every salted part keeps its own first k, so the last step sees at most
    ``salts * k`` rows of a key."""
    part = F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int")
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    kept = (df.withColumn("_salt", part).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
            .drop("_rn", "_salt").withColumn(name, F.row_number().over(last)).filter(F.col(name) <= k))
    return kept if rank else kept.drop(name)
