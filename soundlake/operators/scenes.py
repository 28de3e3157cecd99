"""Events to scenes: span-bounded clusters, their status and what is shown of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators.ordered import chain
from soundlake.operators.quantiles import top_k

KEYS = ("session_id",)


def assign_scenes(events: DataFrame, join: int = params.SCENE_JOIN, pre_anchor: int = params.SCENE_PRE_ANCHOR,
                  length: int = params.SCENE_SAMPLES, width: int | None = None, keys: Sequence[str] = KEYS,
                  pos: str = "onset_sample", ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Every event with its scene.  A scene opens at its first event and takes events up to ``join`` later
    (inclusive); unlike a gap-based session its span cannot grow beyond that.  (key, anchor) names it."""
    marked = chain(events, keys, pos, ties, width or 256 * max(join, 1), join)
    start = F.greatest(F.lit(0), F.col("_anchor") - pre_anchor).cast("bigint")
    return (marked.withColumn("anchor_sample", F.col("_anchor")).withColumn("scene_start", start)
            .withColumn("scene_end", F.col("scene_start") + length).drop("_anchor"))


def scene_table(assigned: DataFrame, keys: Sequence[str] = KEYS, oldest: Column | int = 0,
                pos: str = "onset_sample") -> DataFrame:
    """One row per scene with counts; members stay in the event table."""
    edge = oldest if isinstance(oldest, Column) else F.lit(oldest)
    return (assigned.groupBy(*keys, "anchor_sample", "scene_start", "scene_end")
            .agg(F.count(F.lit(1)).alias("event_count"), F.max(pos).alias("last_onset"))
            .withColumn("audio_available", F.col("scene_start") >= edge))


def scene_fanout(assigned: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each scene's result on every member event."""
    return assigned.join(results.drop("scene_start", "scene_end"), [*keys, "anchor_sample"])


def class_enabled(class_index: Column, mask: Column) -> Column:
    """Is the class's bit set in the enabled mask?"""
    return F.getbit(mask, class_index) == 1


def scene_status(mask: Column, model_available: Column, audio_available: Column, failed: Column,
                 source_count: Column) -> Column:
    return (F.when(mask == 0, "disabled").when(~model_available, "model-unavailable")
            .when(~audio_available, "audio-unavailable").when(failed, "inference-failed")
            .when(source_count >= 1, "estimated").otherwise("low-confidence"))


def visible_interval(events: DataFrame, now: Column, span: Column | int, start: str = "onset_sample",
                     end: str = "end_sample") -> DataFrame:
    """Events whose interval meets [now - span, now]."""
    begin = F.greatest(F.lit(0), now - span)
    return events.filter((F.col(end) >= begin) & (F.col(start) <= now))


def recent_events(events: DataFrame, keys: Sequence[str], k: int, order: str = "sequence") -> DataFrame:
    """The newest ``k`` rows per stream, newest first (rank 1)."""
    return top_k(events, keys, [F.col(order).desc()], k, [order], rank="recency")


def active_markers(scenes: DataFrame, now: Column, lifetimes: dict[str, float], default_lifetime: float,
                   created: str = "created_seconds") -> DataFrame:
    """Markers younger than their class lifetime, with fade and visible confidence."""
    lifetime = F.lit(default_lifetime)
    for name, seconds in lifetimes.items():
        lifetime = F.when(F.col("class") == name, F.lit(seconds)).otherwise(lifetime)
    age = now - F.col(created)
    fade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age / F.greatest(F.lit(0.1), lifetime)))
    shown = F.when(F.col("status") == "estimated", F.greatest(F.lit(0.25), F.col("confidence"))).otherwise(
        F.greatest(F.lit(0.16), F.col("confidence") * 0.65))
    return (scenes.filter(F.col("status").isin("estimated", "low-confidence") & (age >= 0) & (age < lifetime))
            .withColumns({"fade": fade, "visible_confidence": shown}))
