"""Applying a model to windows or scenes, and comparing stored outputs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scorer(Protocol):
    """``load`` runs once per task and returns a function from a batch [n, ...] to outputs [n, ...]."""

    def load(self) -> Callable[[np.ndarray], np.ndarray]: ...


class MeanContrast:
    """Closed-form scorer: how far the last frame stands out from the window's mean."""

    def __init__(self, scale: float = 100.0):
        self.scale = scale

    def load(self):
        def score(windows: np.ndarray) -> np.ndarray:
            last, mean = windows[:, -1].mean(axis=1), windows.mean(axis=(1, 2))
            return np.clip((last - mean) / self.scale + 0.5, 0.0, 1.0)[:, None]
        return score


def _stack(values, depth: int) -> np.ndarray:
    if depth == 1:
        return np.asarray(values.tolist() if hasattr(values, "tolist") else values, dtype=np.float64)
    return np.stack([_stack(v, depth - 1) for v in values])


def _depth(data_type) -> int:
    return 1 + _depth(data_type.elementType) if isinstance(data_type, T.ArrayType) else 0


def score(rows: DataFrame, column: str, scorer: Scorer, keep: Sequence[str], out: str = "scores",
          shape: Sequence[int] | None = None, clamp: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Batch scores of an array column with a fixed shape; wrong shapes and non-finite outputs are errors.

    Runs on whatever partitions the input has: no shuffle.  ``batch_ms`` is the batch time per row.
    """
    keep = list(keep)
    depth = _depth(rows.schema[column].dataType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer.load()
        for batch in batches:
            if not len(batch):
                continue
            values = _stack(batch[column].tolist(), depth + 1) if depth == 0 else np.stack([_stack(v, depth) for v in batch[column]])
            if shape is not None and values.shape[1:] != tuple(shape):
                raise ValueError(f"expected windows of shape {tuple(shape)}, got {values.shape[1:]}")
            started = time.perf_counter()
            outputs = np.asarray(model(values), dtype=np.float64)
            took = (time.perf_counter() - started) * 1000.0 / len(batch)
            if not np.isfinite(outputs).all():
                raise ValueError("model returned non-finite scores")
            if clamp is not None:
                outputs = np.clip(outputs, *clamp)
            yield batch[keep].assign(**{out: list(outputs.reshape(len(batch), -1)), "batch_ms": took})
    fields = [rows.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField("batch_ms", T.DoubleType())])
    return rows.select(*keep, column).mapInPandas(run, schema)


def score_windows(windows: DataFrame, scorer: Scorer, keep: Sequence[str], column: str = "window", **options) -> DataFrame:
    return score(windows, column, scorer, keep, **options)


def score_scenes(scenes: DataFrame, scorer: Scorer, keep: Sequence[str], column: str = "planes", classes: int = 2,
                 tracks: int = 3, **options) -> DataFrame:
    """One [class][track][xyz] output per scene."""
    flat = score(scenes, column, scorer, keep, out="_flat", clamp=None, **options)
    nested = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(tracks - 1)), lambda t: F.slice("_flat", c * (3 * tracks) + t * 3 + 1, 3)))
    return flat.select(*keep, nested.alias("tracks"), "batch_ms")


def flatten_all(column: Column, depth: int) -> Column:
    for _ in range(depth - 1):
        column = F.flatten(column)
    return column


def parity_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, tol: float) -> DataFrame:
    """Per key: largest absolute difference of two output vectors and whether it is within ``tol``.
    A missing side, another length or a non-finite value fails."""
    a, b = left.select(*keys, F.col(column).alias("_a")), right.select(*keys, F.col(column).alias("_b"))
    rows = a.join(b, list(keys), "full")
    diff = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b"))
    finite = F.coalesce(diff < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(diff), F.lit(True))
    return rows.select(*keys, F.when(same, diff).alias("max_diff"), (same & finite & (diff <= tol)).alias("within")).withColumn(
        "within", F.coalesce("within", F.lit(False)))
