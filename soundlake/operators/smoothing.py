"""Recursive and windowed averages over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake import params
from soundlake.operators.ordered import SLICE, add_slice, edge_window


BLOCK = 64


@lru_cache(maxsize=256)
def _weights(factor: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each of ``size`` values adds to each later one, and what is left of the state before them."""
    steps = np.arange(size)
    return np.tril((1.0 - factor) * factor ** np.maximum(steps[:, None] - steps[None, :], 0)), (factor ** (steps + 1))[:, None]


def _advance(values: np.ndarray, start, keep) -> np.ndarray:
    """The recursion over rows: inside blocks by a triangular matrix, from block to block by what it carries."""
    flat = values.reshape(len(values), -1)
    keep = np.broadcast_to(np.asarray(keep, dtype=np.float64), flat.shape[1:])
    state = np.broadcast_to(np.asarray(start, dtype=np.float64).ravel(), flat.shape[1:])
    out = np.empty(flat.shape, dtype=np.float64)
    for factor in dict.fromkeys(keep.tolist()):
        some = keep == factor
        carried = state[some]
        for at in range(0, len(flat), BLOCK):
            x = flat[at:at + BLOCK, some]
            inside, fading = _weights(factor, len(x))
            y = inside @ x + fading * carried
            out[at:at + BLOCK, some] = y
            carried = y[-1]
    return out.reshape(values.shape)


def _runs(batch: pd.DataFrame, by: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows with equal keys, in arrival order."""
    changed = np.zeros(len(batch), dtype=bool)
    for name in by:
        column = batch[name].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    cuts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield tuple(batch[name].iloc[lo] for name in by), batch.iloc[lo:hi]


def _values(run: pd.DataFrame, column: str, vector: bool) -> np.ndarray:
    if vector:
        return np.stack(run[column].to_list()).astype(np.float64)
    return run[column].to_numpy(dtype=np.float64)


def exponential_smooth(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], width: int,
                       column: str, weight: float | tuple[float, float], out: str) -> DataFrame:
    """y0 = x0, then y = (1 - w) * y + w * x, per key in order; scalar or array column.  A pair of weights
    is for arrays: the second one applies to the last element, the first to the others.

    The recursion is affine, so a slice maps the value on entry to ``keep^n * entry + b``.  Slices report
    (n, b), the per-key fold runs over those summaries, and each slice then replays from its entry value.
    """
    keys = list(keys)
    vector = isinstance(df.schema[column].dataType, T.ArrayType)
    value_type = T.ArrayType(T.DoubleType()) if vector else T.DoubleType()
    by, order = [*keys, SLICE], [pos, *ties]
    key_fields = [df.schema[k] for k in keys]
    ordered = add_slice(df, pos, width).repartition(*by).sortWithinPartitions(*by, *order)

    def kept(values: np.ndarray):
        if not isinstance(weight, tuple):
            return 1.0 - weight
        return 1.0 - np.r_[np.full(values.shape[-1] - 1, weight[0]), weight[1]]

    def plain(x):
        return x.tolist() if vector else float(x)

    def summarize(batches):
        current, count, first, total = None, 0, None, None
        for batch in batches:
            done = []
            for group, run in _runs(batch, by):
                values = _values(run, column, vector)
                if group != current:
                    if current is not None:
                        done.append((*current, count, plain(first), plain(total)))
                    current, count, first, total = group, 0, values[0], np.zeros_like(values[0])
                count += len(values)
                total = _advance(values, total, kept(values))[-1]
            if done:
                yield pd.DataFrame(done, columns=[*by, "n", "first", "b"])
        if current is not None:
            yield pd.DataFrame([(*current, count, plain(first), plain(total))], columns=[*by, "n", "first", "b"])

    def scan(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for group, run in _runs(batch, keys):
                if group != current:
                    current, state = group, None
                for piece, n, first, b in zip(run[SLICE], run["n"], run["first"], run["b"]):
                    entry = np.asarray(first if state is None else state, dtype=np.float64)
                    done.append((*group, piece, plain(entry)))
                    state = kept(entry) ** n * entry + np.asarray(b, dtype=np.float64)
            if done:
                yield pd.DataFrame(done, columns=[*by, "entry"])

    names = df.columns

    def replay(batches):
        current, state = None, None
        for batch in batches:
            results = []
            for group, run in _runs(batch, by):
                if group != current:
                    current = group
                    state = np.asarray(run["entry"].iloc[0], dtype=np.float64)
                values = _values(run, column, vector)
                smooth = _advance(values, state, kept(values))
                state = smooth[-1]
                results.extend(list(smooth) if vector else smooth.tolist())
            yield batch[names].assign(**{out: results})

    summary = ordered.select(*by, *order, column).mapInPandas(summarize, T.StructType([
        *key_fields, T.StructField(SLICE, T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("first", value_type), T.StructField("b", value_type)]))
    entries = (summary.repartition(*keys).sortWithinPartitions(*by)
               .mapInPandas(scan, T.StructType([*key_fields, T.StructField(SLICE, T.LongType()),
                                                T.StructField("entry", value_type)])))
    joined = add_slice(df, pos, width).join(entries, by).repartition(*by).sortWithinPartitions(*by, *order)
    return joined.mapInPandas(replay, T.StructType([*df.schema.fields, T.StructField(out, value_type)]))


def one_pole(df, keys, pos, ties, width, column, coefficient, out):
    """y = c * x + (1 - c) * y: exponential smoothing named by its low-pass coefficient."""
    return exponential_smooth(df, keys, pos, ties, width, column, coefficient, out)


def instantaneous_activity(mean_db: Column) -> Column:
    return F.least(F.greatest((mean_db + 80.0) / 60.0, F.lit(0.0)), F.lit(1.0))


def scene_activity(df: DataFrame, keys, pos, ties, width, mean_db: str, out: str = "activity",
                   frames: int = params.ACTIVITY_FRAMES) -> DataFrame:
    """Causal 0..1 activity from the mean level in dB."""
    level = df.withColumn("_instant", instantaneous_activity(F.col(mean_db)))
    weight = 2.0 / (max(1, frames) + 1.0)
    return exponential_smooth(level, keys, pos, ties, width, "_instant", weight, out).drop("_instant")


def trailing_window(coefficient: float) -> int:
    return int(min(max(round(2.0 / max(coefficient, 0.02)), 3), 64))


def trailing_mean(df: DataFrame, keys, pos, ties, width, column: str, coefficient: float, out: str) -> DataFrame:
    """Causal moving average, partial at the start of a key."""
    rows = trailing_window(coefficient)
    return edge_window(df, keys, pos, ties, width, rows - 1, lambda w: {
        out: F.avg(column).over(w.rowsBetween(-(rows - 1), Window.currentRow))})
