"""Score traces to events: local maxima over a threshold, minimum spacing, source and scene tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators.ordered import chain, edge_window

KEYS = ("session_id", "class")


def local_maxima(trace: DataFrame, lookahead: int, width: int, keys: Sequence[str] = KEYS,
                 ties: Sequence[str] = ()) -> DataFrame:
    """Rows that are the first maximum of the ``lookahead`` rows around them.  Independent of any
    threshold, so a threshold sweep runs this once.  ``_detected``: the row where the peak is certain."""
    p = F.col("probability")

    def columns(w):
        return {
            "_around": F.max(p).over(w.rowsBetween(-lookahead, lookahead)),
            "_before": F.max(p).over(w.rowsBetween(-lookahead, -1)),
            "_detected": F.last("sample").over(w.rowsBetween(Window.currentRow, lookahead)),
        }
    scored = edge_window(trace, keys, "sample", ties, width, lookahead, columns)
    first = F.col("_before").isNull() | (p > F.col("_before"))
    return scored.filter((p >= F.col("_around")) & first).drop("_around", "_before")


def over_threshold(cutoff: Column | float, quiet: Column | float, busy: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    level = F.when(F.col("activity") < as_col(cutoff), as_col(quiet)).otherwise(as_col(busy))
    return F.col("probability") >= level


def local_peaks(trace: DataFrame, quiet, busy, cutoff, lookahead: int, width: int,
                keys: Sequence[str] = KEYS, ties: Sequence[str] = ()) -> DataFrame:
    maxima = local_maxima(trace, lookahead, width, keys, ties)
    return maxima.filter(over_threshold(cutoff, quiet, busy))


def min_spacing(candidates: DataFrame, spacing: Column | int, width: int, keys: Sequence[str] = KEYS,
                ties: Sequence[str] = ()) -> DataFrame:
    """Keep one candidate per burst: a closer one replaces the kept one only when strictly higher."""
    return chain(candidates, keys, "sample", ties, width, spacing, score="probability")


def argmax_source(probs: Column, names: Sequence[str] = params.SOURCE_NAMES) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]),
                        F.array_position(probs, F.array_max(probs)).cast("int"))


def suppress_self(events: DataFrame, threshold: float, probs: str = "source_probs",
                  names: Sequence[str] = params.SOURCE_NAMES) -> DataFrame:
    """Source hint by arg-max; events the player caused are flagged and forced to ``self``."""
    mine = F.element_at(F.col(probs), names.index("self") + 1)
    flagged = mine >= threshold
    return events.withColumns({
        "suppressed": flagged,
        "source_hint": F.when(flagged, F.lit("self")).otherwise(argmax_source(F.col(probs), names)),
        "source_confidence": F.when(flagged, mine).otherwise(F.array_max(F.col(probs))),
    })


def scene_state(activity: Column, cutoff) -> Column:
    return F.when(activity < cutoff, F.lit("quiet")).otherwise(F.lit("busy"))


def peak_events(trace: DataFrame, *, quiet=0.5, busy=0.5, cutoff=0.5, spacing: Column | int = 1680,
                lookahead: int = 2, onset_offset: Column | int = 512, pulse: int = 2400,
                self_threshold: float = 0.95, width: int = 480_000, include_suppressed: bool = True,
                keys: Sequence[str] = KEYS, ties: Sequence[str] = ()) -> DataFrame:
    """Trace rows to discrete events."""
    offset = onset_offset if isinstance(onset_offset, Column) else F.lit(onset_offset)
    kept = min_spacing(local_peaks(trace, quiet, busy, cutoff, lookahead, width, keys, ties),
                       spacing, width, keys, ties)
    tagged = suppress_self(kept, self_threshold)
    events = tagged.withColumns({
        "onset_sample": F.greatest(F.lit(0), F.col("sample") - offset).cast("bigint"),
        "confidence": F.col("probability"),
        "detected_sample": F.col("_detected"),
        "scene_mode": scene_state(F.col("activity"), cutoff),
    }).withColumn("end_sample", F.col("onset_sample") + pulse)
    if not include_suppressed:
        events = events.filter(~F.col("suppressed"))
    carried = [c for c in ties if c not in keys]
    return events.select(*keys, *carried, "sample", "onset_sample", "end_sample", "confidence", "detected_sample",
                         "source_hint", "source_confidence", "scene_mode", "suppressed")
