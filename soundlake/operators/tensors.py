"""Overlapping windows of frames as tensors, without a copy of a frame for each window it lies in.

Frames meet window ends in blocks of positions.  A block also gets the ``context - 1`` frames before it, so a frame is shuffled
``1 + (context - 1) / block`` times, whatever the number of windows; in the task a window is a strided view of the block's frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake.operators.ordered import segment_starts

CONTEXT = 128
BLOCK = 4096
BATCH = 64      # windows of an Arrow batch


def _cut(keys: Sequence[str], shape: tuple[int, int], context: int, block: int, pad: np.ndarray, reduce: Callable[[np.ndarray], np.ndarray] | None = None):
    by = [*keys, "_block", "_side"]
    channels, bands = shape

    def tensors(buffer: np.ndarray, known: np.ndarray, rows: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        views = np.lib.stride_tricks.sliding_window_view(buffer, context, axis=0)  # [window, value, frame]
        for a in range(0, rows.num_rows, BATCH):
            part = rows.slice(a, BATCH)
            last = part["_p"].to_numpy() - first
            there = known[last]
            cut = views[last[there] - context + 1].reshape(-1, channels, bands, context).swapaxes(2, 3)
            if reduce is not None:
                cut = np.asarray(reduce(cut), np.float64).reshape(int(there.sum()), -1)
            size = int(np.prod(cut.shape[1:]))
            ends = pa.array(np.r_[0, np.cumsum(np.where(there, size, 0))].astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(cut).ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*[part[k].combine_chunks() for k in keys], part["_row"].combine_chunks(), lists], names=[*keys, "_row", "tensor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first = None, 0
        buffer, known = np.empty((block + context - 1, channels * bands), np.float32), np.zeros(block + context - 1, bool)
        buffer[:] = pad
        for batch in batches:
            table = pa.Table.from_batches([batch])
            begin = np.flatnonzero(segment_starts(table, by))
            for a, b in zip(begin, [*begin[1:], table.num_rows]):
                rows = table.slice(a, b - a)
                group = tuple(rows[c][0].as_py() for c in by[:-1])
                if group != current:
                    current, first = group, group[-1] * block - context + 1
                    buffer[known], known[:] = pad, False  # only what the last block filled
                if rows["_side"][0].as_py() == 0:
                    at = rows["_p"].to_numpy() - first
                    values = rows["_v"].combine_chunks()
                    buffer[at], known[at] = values.flatten().to_numpy().reshape(len(at), -1), True
                else:
                    yield from tensors(buffer, known, rows, first)
    return run


def window_tensors(frames: DataFrame, ends: DataFrame, vector: str, shape: tuple[int, int], *, context: int = CONTEXT, keys: Sequence[str] = ("session_id",),
                   pos: str = "frame_idx", end: str = "window_end", pad: Sequence[float] = (0.0, -100.0, 0.0, 0.0, 0.0), block: int = BLOCK, out: str = "tensor",
                   reduce: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``ends`` with ``out``: the last ``context`` frames before the end as a flat float array [channel][frame][band].

    ``vector`` is an array [channel][band] of each frame; what lies before the first frame, and frames that are missing, are filled
    with the channel's ``pad``.  With ``reduce``, a function of float tensors [window, channel, frame, band] to numbers per window, ``out`` has
    these, as doubles, and the tensors stay in the task.  A window whose last frame is missing gets null.  Gains, domains and the like are further ``keys``.
    """
    channels, bands = shape
    filled = np.repeat(np.asarray(pad, np.float32)[:channels], bands)
    place = F.col(pos).cast("bigint")
    rows = [c for c in ends.columns if c not in keys]
    payload = F.struct(*rows)
    kind = ends.select(payload.alias("_row")).schema["_row"].dataType
    values = frames.select(*keys, place.alias("_p"), F.flatten(vector).cast("array<float>").alias("_v"), F.explode(F.sequence(
        F.floor(place / block), F.floor((place + context - 1) / block))).alias("_block"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"))
    last = F.col(end).cast("bigint") - 1
    asked = ends.select(*keys, last.alias("_p"), F.lit(None).cast("array<float>").alias("_v"), F.floor(last / block).alias("_block"), F.lit(1).alias("_side"), payload.alias("_row"))
    both = values.unionByName(asked).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_side", "_p")
    schema = T.StructType([*[T.StructField(k, ends.schema[k].dataType) for k in keys], T.StructField("_row", kind), T.StructField("tensor", T.ArrayType(T.FloatType() if reduce is None else T.DoubleType()))])
    made = both.mapInArrow(_cut(keys, shape, context, block, filled, reduce), schema)
    return made.select(*keys, *[F.col("_row")[c].alias(c) for c in rows], F.col("tensor").alias(out))


def training_tensors(features: DataFrame, windows: DataFrame, gains: Sequence[float], vector: str = "planes", shape: tuple[int, int] = (5, 64), **how) -> DataFrame:
    """Tensors of every training window at every gain: ``features`` has a row per (session_id, gain_db, frame_idx), ``windows`` a row per
    (session_id, window_end) with its labels; the gain is a column of the result."""
    each = windows.withColumn("gain_db", F.explode(F.array(*[F.lit(float(g)) for g in gains])))
    return window_tensors(features, each, vector, shape, keys=("session_id", "gain_db"), **how)
