"""Table functions for SQL users, to be called per row with LATERAL:  ``register(spark)``, then

    SELECT c.session_id, f.* FROM chunks c, LATERAL frames_of(c.first_sample, c.samples, c.length, 1024, 240) f

Each call works on one row, so nothing of a key is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _positive(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, T.IntegralType):
        raise ValueError(f"{name} must be a whole number")
    if argument.isConstantExpression and (argument.value is None or argument.value < 1):
        raise ValueError(f"{name} must be positive")


class FramesOf:
    """The samples of a chunk with every whole frame they lie in and their place there; a frame over several chunks comes in parts."""

    @staticmethod
    def analyze(first: AnalyzeArgument, samples: AnalyzeArgument, length: AnalyzeArgument, fft: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(samples.dataType, T.ArrayType):
            raise ValueError("samples must be an array")
        _positive(fft, "fft")
        _positive(hop, "hop")
        return AnalyzeResult(T.StructType().add("frame_idx", T.LongType()).add("offset", T.IntegerType()).add("value", samples.dataType.elementType))

    def eval(self, first, samples, length, fft, hop):
        if first is None or samples is None or length is None:
            return
        last = min((first + len(samples) - 1) // hop, (length - fft) // hop)
        for frame in range(max(0, -(-(first - fft + 1) // hop)), last + 1):
            start = frame * hop
            for at in range(max(first, start), min(first + len(samples), start + fft)):
                yield frame, at - start, samples[at - first]


class WindowEndsOf:
    """Window ends of a sequence of frames: every ``stride``-th from the first, the last, and those after the given frames."""

    @staticmethod
    def analyze(frames: AnalyzeArgument, stride: AnalyzeArgument, positives: AnalyzeArgument) -> AnalyzeResult:
        _positive(stride, "stride")
        if not isinstance(positives.dataType, (T.ArrayType, T.NullType)):
            raise ValueError("positives must be an array of frame numbers")
        return AnalyzeResult(T.StructType().add("window_end", T.LongType()))

    def eval(self, frames, stride, positives):
        if not frames or frames < 1:
            return
        ends = {*range(1, frames + 1, stride), frames, *(p + 1 for p in positives or () if p is not None and 0 <= p < frames)}
        for end in sorted(ends):
            yield (end,)


def register(spark: SparkSession) -> None:
    """Make ``frames_of`` and ``window_ends_of`` known to SQL."""
    from pyspark.sql.functions import udtf
    spark.udtf.register("frames_of", udtf(FramesOf))
    spark.udtf.register("window_ends_of", udtf(WindowEndsOf))
