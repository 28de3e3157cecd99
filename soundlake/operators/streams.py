"""Block streams in batch form: generations, retention, shedding, levels and live state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.operators.ordered import edge_window, running
from soundlake.operators.quantiles import top_k


def stream_generations(blocks: DataFrame, keys: Sequence[str], first: str, frames: str, width: int) -> DataFrame:
    """A block that does not start where the previous one ended opens a new generation, in which
    positions restart at zero."""
    ends = edge_window(blocks, keys, first, [], width, 1, lambda w: {
        "_end": F.lag(F.col(first) + F.col(frames)).over(w)})
    opened = F.col("_end").isNull() | (F.col(first) != F.col("_end"))
    flagged = ends.withColumns({"_opened": opened.cast("bigint"), "_origin": F.when(opened, F.col(first))})
    counted = running(flagged, keys, first, [], width, {
        "_count": ("sum", "_opened"), "_start": ("last", "_origin")})
    return (counted.withColumn("stream_generation", F.col("_count") - 1)
            .withColumn("generation_sample", F.col(first) - F.col("_start"))
            .withColumn("discontinuity", F.col("_opened") == 1)
            .drop("_end", "_opened", "_origin", "_count", "_start"))


def generation_losses(blocks: DataFrame, keys: Sequence[str], first: str, frames: str, width: int, *, limit: int, keep: int) -> DataFrame:
    """Generations with counted losses (columns endpoint, lost, available besides): a gap or another endpoint resets the stream,
    frames lost to an overflow and a backlog over ``limit``, cut to ``keep``, each open a further generation."""
    ends = edge_window(blocks, keys, first, [], width, 1, lambda w: {
        "_end": F.lag(F.col(first) + F.col(frames)).over(w), "_endpoint": F.lag("endpoint").over(w)})
    reset = F.col("_end").isNull() | (F.col(first) != F.col("_end")) | ~F.col("endpoint").eqNullSafe(F.col("_endpoint"))
    flagged = ends.withColumns({"reset": reset, "overflow": F.col("lost") > 0, "shed": F.col("available") > limit})
    opened = F.col("reset").cast("bigint") + F.col("overflow").cast("bigint") + F.col("shed").cast("bigint")
    flagged = flagged.withColumns({"_opened": opened, "_origin": F.when(opened > 0, F.col(first)),
                                   "_gone": F.when(F.col("shed"), F.col("available") - keep).otherwise(0).cast("bigint"), "_lost": F.col("lost").cast("bigint")})
    counted = running(flagged, keys, first, [], width, {
        "_count": ("sum", "_opened"), "_start": ("last", "_origin"), "lost_total": ("sum", "_lost"), "discarded_total": ("sum", "_gone")})
    return counted.withColumns({"stream_generation": F.col("_count") - 1, "generation_sample": F.col(first) - F.col("_start")}).drop(
        "_end", "_endpoint", "_opened", "_origin", "_gone", "_lost", "_count", "_start")


def retained(blocks: DataFrame, keys: Sequence[str], first: str, frames: str, capacity: int) -> DataFrame:
    """The part of each block inside the newest ``capacity`` positions of its stream."""
    newest = blocks.groupBy(*keys).agg(F.max(F.col(first) + F.col(frames)).alias("_newest"))
    joined = blocks.join(newest, list(keys))
    oldest = F.greatest(F.lit(0), F.col("_newest") - capacity)
    start = F.greatest(F.col(first), oldest)
    kept = joined.withColumn("retained_first", start).withColumn(
        "retained_frames", F.col(first) + F.col(frames) - start)
    return kept.filter(F.col("retained_frames") > 0).drop("_newest")


def backlog_audit(reads: DataFrame, available: str, limit: int, keep: int) -> DataFrame:
    """Reads with a backlog over ``limit`` keep the newest ``keep`` frames and open a new generation."""
    over = F.col(available) > limit
    return reads.withColumns({"shed": over, "discarded": F.when(over, F.col(available) - keep).otherwise(0)})


def block_levels(blocks: DataFrame, samples: str) -> DataFrame:
    """RMS and peak of each block's samples, on the row."""
    x = F.col(samples)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    peak = F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    n = F.size(x)
    return blocks.withColumns({"rms": F.when(n > 0, F.sqrt(square / n)).otherwise(F.lit(0.0)), "peak": peak})


def signal_levels(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same over one row per sample."""
    x = F.col(value)
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"))


def latency_stats(times: DataFrame, keys: Sequence[str], value: str, order: str, latest: int = 256) -> DataFrame:
    """Last, maximum and p95 (by floor index, not interpolated) of each stream's latest times."""
    recent = top_k(times, keys, [F.col(order).desc()], latest, [order])
    sums = recent.groupBy(*keys).agg(F.max_by(value, order).alias("last_ms"), F.max(value).alias("max_ms"),
                                     F.sort_array(F.collect_list(value)).alias("_all"))
    index = F.least(F.size("_all") - 1, F.floor(F.size("_all") * 0.95).cast("int"))
    return sums.withColumn("p95_ms", F.get("_all", index)).drop("_all")


def live_state(trace: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The latest row of every stream."""
    latest = F.max_by(F.struct(*columns), F.struct(*order))
    return trace.groupBy(*keys).agg(latest.alias("s")).select(*keys, "s.*")


def policy_join(rows: DataFrame, policies: DataFrame, keys: Sequence[str], at: str, since: str, width: int) -> DataFrame:
    """Each row with the policy version in force: the latest one that started before it.

    ``policies`` has ``keys``, ``since`` and the policy columns.  A version applies from the next row on.
    """
    extra = [c for c in policies.columns if c not in (*keys, since)]
    names = [c for c in rows.columns if c not in keys]
    left = rows.select(*keys, F.col(at).cast("bigint").alias("_p"), F.lit(0).alias("_side"), F.struct(*names).alias("_row"),
                       F.lit(None).alias("_policy"))
    right = policies.select(*keys, F.col(since).cast("bigint").alias("_p"), F.lit(1).alias("_side"),
                            F.lit(None).alias("_row"), F.struct(*extra).alias("_policy"))
    both = running(left.unionByName(right), keys, "_p", ["_side"], width, {"_now": ("last", "_policy")})
    return both.filter("_side = 0").select(*keys, *[F.col(f"_row.{n}").alias(n) for n in names],
                                           *[F.col(f"_now.{n}").alias(n) for n in extra])
