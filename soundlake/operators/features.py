"""Signals to time-frequency features.

Recordings are rows of consecutive chunks (``session_id, first_sample, left, right``).  Framing regroups
them by block of ``block`` positions; a chunk sends to each block the samples that block's frames touch,
so a task sees one block plus one frame length and a long recording is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake import params
from soundlake.functions import scalar as s
from soundlake.operators.ordered import edge_window, ordinal, running
from soundlake.operators.smoothing import exponential_smooth, instantaneous_activity
from soundlake.session import cut_lineage


def mel_filterbank(rate: int = params.SAMPLE_RATE, fft: int = params.FFT_SIZE, bands: int = params.MEL_BINS,
                   low: float = params.MEL_MIN_HZ, high: float = params.MEL_MAX_HZ) -> np.ndarray:
    """[band, bin] triangular weights, equally spaced in mel, without area normalisation."""
    mel = np.linspace(2595.0 * np.log10(1.0 + low / 700.0), 2595.0 * np.log10(1.0 + high / 700.0), bands + 2)
    edges = 700.0 * (10.0 ** (mel / 2595.0) - 1.0)
    hz = np.arange(fft // 2 + 1) * (rate / fft)
    up = (hz[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz[None, :]) / np.diff(edges)[1:, None]
    return np.clip(np.minimum(up, down), 0.0, None)


def blocks_of(chunks: DataFrame, block: int, tail: int, extra: Sequence[str] = ()) -> DataFrame:
    """Pieces of chunks per block: block b covers ``[b * block, (b + 1) * block + tail)``."""
    end = F.col("first_sample") + F.size("left")
    first = F.greatest(F.lit(0), F.floor((F.col("first_sample") - tail) / block)).cast("bigint")
    last = F.floor((end - 1) / block).cast("bigint")
    rows = chunks.filter(F.size("left") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("first_sample"), F.col("block") * block)
    stop = F.least(F.col("first_sample") + F.size("left"), (F.col("block") + 1) * block + tail)
    cut = lambda c: F.slice(c, (start - F.col("first_sample") + 1).cast("int"), (stop - start).cast("int"))
    return rows.filter(stop > start).select("session_id", *extra, "block", start.alias("piece_start"),
                                            cut("left").alias("left"), cut("right").alias("right"))


def _frames(block: int, start: int, samples: np.ndarray, fft: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers that start inside the block and fit, and their samples [frame, fft, 2]."""
    first = -(-start // hop)
    count = (start + len(samples) - fft) // hop - first + 1
    numbers = first + np.arange(max(count, 0))
    numbers = numbers[numbers * hop < block]
    index = (numbers * hop - start)[:, None] + np.arange(fft)[None, :]
    return numbers, samples[index] if len(numbers) else np.zeros((0, fft, 2))


STFT_SCHEMA = ("session_id {key}, frame_idx bigint, start_sample bigint, left_re array<double>, left_im array<double>, "
               "right_re array<double>, right_im array<double>")
MEL_SCHEMA = ("session_id {key}, frame_idx bigint, start_sample bigint, left_mel array<double>, right_mel array<double>, "
              "cross_re array<double>, cross_im array<double>")


FRAMES_PER_BATCH = 4096


def _list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _per_block(chunks: DataFrame, fft: int, hop: int, block_frames: int, schema: str, work) -> DataFrame:
    """Frame every block and hand ``work`` the spectra of many frames at a time.

    Pieces arrive sorted, so a task holds one block of samples and one batch of frames.
    """
    block = block_frames * hop
    key = chunks.schema["session_id"].dataType.simpleString()
    window = np.hanning(fft)[None, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, waiting, current, begin, parts = [], 0, None, 0, []
        key_type = None

        def close():
            samples = np.concatenate(parts)
            index, frames = _frames((current[1] + 1) * block, begin, samples, fft, hop)
            if len(index):
                ready.append((current[0], index, frames))
            return len(index)

        def emit():
            index = np.concatenate([r[1] for r in ready])
            spectrum = np.fft.rfft(np.concatenate([r[2] for r in ready]) * window, axis=1)
            sessions = pa.array([r[0] for r in ready for _ in r[1]], type=key_type)
            columns = {"session_id": sessions, "frame_idx": pa.array(index), "start_sample": pa.array(index * hop)}
            columns.update({name: _list_column(values) for name, values in work(spectrum).items()})
            ready.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            key_type = batch.column("session_id").type
            keys = zip(batch.column("session_id").to_pylist(), batch.column("block").to_pylist())
            starts = batch.column("piece_start").to_pylist()
            sides = [(c.offsets.to_numpy(), c.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
                     for c in (batch.column("left"), batch.column("right"))]
            for i, group in enumerate(keys):
                if group != current:
                    if current is not None:
                        waiting += close()
                    current, begin, parts = group, starts[i], []
                    at = begin
                if starts[i] != at:
                    raise ValueError("chunks of one recording must be consecutive")
                piece = np.stack([values[offsets[i]:offsets[i + 1]] for offsets, values in sides], axis=1)
                parts.append(piece)
                at += len(piece)
                if waiting >= FRAMES_PER_BATCH:
                    yield emit()
                    waiting = 0
        if current is not None:
            close()
        if ready:
            yield emit()
    pieces = blocks_of(chunks, block, max(fft - hop, 0))
    ordered = pieces.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "piece_start")
    return ordered.mapInArrow(run, schema.format(key=key))


def stft(chunks: DataFrame, fft: int = params.FFT_SIZE, hop: int = params.HOP_SIZE, block_frames: int = 512) -> DataFrame:
    """Complex spectrum of every whole frame, per channel, with a symmetric Hann window."""
    def work(spectrum):
        return {"left_re": spectrum[:, :, 0].real, "left_im": spectrum[:, :, 0].imag,
                "right_re": spectrum[:, :, 1].real, "right_im": spectrum[:, :, 1].imag}
    return _per_block(chunks, fft, hop, block_frames, STFT_SCHEMA, work)


def mel_project(chunks: DataFrame, rate: int = params.SAMPLE_RATE, fft: int = params.FFT_SIZE, hop: int = params.HOP_SIZE,
                bands: int = params.MEL_BINS, block_frames: int = 512) -> DataFrame:
    """Mel energy of both channels and the mel-banded cross spectrum of every frame."""
    weights = mel_filterbank(rate, fft, bands).T

    def work(spectrum):
        left, right = spectrum[:, :, 0], spectrum[:, :, 1]
        cross = left * np.conj(right) / fft ** 2
        return {"left_mel": np.abs(left) ** 2 / fft ** 2 @ weights, "right_mel": np.abs(right) ** 2 / fft ** 2 @ weights,
                "cross_re": cross.real @ weights, "cross_im": cross.imag @ weights}
    return _per_block(chunks, fft, hop, block_frames, MEL_SCHEMA, work)


def log_mel(chunks: DataFrame, rate: int = params.SAMPLE_RATE, fft: int = params.FFT_SIZE, hop: int = params.HOP_SIZE,
            bands: int = params.MEL_BINS, block_frames: int = 512) -> DataFrame:
    """log1p(1e4 * mel) of the mean of both channels (opposite phases cancel)."""
    weights = mel_filterbank(rate, fft, bands).T

    def work(spectrum):
        return {"log_mel": np.log1p(1e4 * (np.abs(spectrum.mean(axis=2)) ** 2 / fft ** 2 @ weights))}
    schema = "session_id {key}, frame_idx bigint, start_sample bigint, log_mel array<double>"
    return _per_block(chunks, fft, hop, block_frames, schema, work)


def onset_features(mel: DataFrame, gain_db: float = 0.0, block_frames: int = 512, hop: int = params.HOP_SIZE,
                   fft: int = params.FFT_SIZE, activity_frames: int = params.ACTIVITY_FRAMES) -> DataFrame:
    """Mel rows to the five planes (PCEN, level, channel level difference, coherence re/im) and activity.

    A gain acts on the energies, so features at several gains come from one mel table.
    """
    gain = 10.0 ** (gain_db / 10.0)
    energy = F.zip_with("left_mel", "right_mel", lambda a, b: (a + b) * (0.5 * gain))
    # The mel rows are read by the summary and the replay of the smoothing: computed once, kept as a table.
    rows = cut_lineage(mel).withColumn("energy", energy)
    level = F.transform("energy", s.power_db)
    mean_db = F.aggregate(level, F.lit(0.0), lambda a, x: a + x) / F.size("energy")
    # Band energies and activity are smoothed together, each with its own weight.
    rows = rows.withColumn("_x", F.concat("energy", F.array(instantaneous_activity(mean_db))))
    weights = (params.PCEN_SMOOTHING, 2.0 / (max(1, activity_frames) + 1.0))
    smooth = exponential_smooth(rows.drop("energy"), ["session_id"], "frame_idx", [], block_frames, "_x", weights, "_y")
    smooth = smooth.withColumns({"energy": energy, "smooth": F.slice("_y", 1, F.size("_y") - 1)})
    pair = F.arrays_zip("left_mel", "right_mel", "cross_re", "cross_im")
    planes = F.array(
        F.zip_with("energy", "smooth", lambda e, m: s.pcen(e, m)), F.transform("energy", s.power_db),
        F.zip_with("left_mel", "right_mel", s.level_difference),
        F.transform(pair, lambda p: s.coherence(p["cross_re"], p["left_mel"], p["right_mel"])),
        F.transform(pair, lambda p: s.coherence(p["cross_im"], p["left_mel"], p["right_mel"])))
    return smooth.select("session_id", "frame_idx", "start_sample", (F.col("start_sample") + fft).alias("end_sample"),
                         planes.alias("planes"), F.element_at("_y", -1).alias("activity"))


def pcen_features(mel: DataFrame, gain_db: float = 0.0, block_frames: int = 512) -> DataFrame:
    """[PCEN, level] per frame from the mean channel energy."""
    gain = 10.0 ** (gain_db / 10.0)
    rows = cut_lineage(mel).select("session_id", "frame_idx", F.zip_with("left_mel", "right_mel", lambda a, b: (a + b) * (0.5 * gain)).alias("energy"))
    smooth = exponential_smooth(rows, ["session_id"], "frame_idx", [], block_frames, "energy", params.PCEN_SMOOTHING, "smooth")
    return smooth.select("session_id", "frame_idx", F.zip_with("energy", "smooth", lambda e, m: s.pcen(e, m)).alias("pcen"),
                         F.transform("energy", s.power_db).alias("level_db"))


# --- frames as rows ------------------------------------------------------------------------------------

def frame_signal(samples: DataFrame, fft: int, hop: int, index: str = "idx", value: str = "value",
                 key: str = "session_id") -> DataFrame:
    """(session, frame, offset, value) rows of every whole frame of a dense sample table."""
    length = samples.groupBy(key).agg((F.max(index) + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - fft + 1) / hop)).cast("bigint")
    last = F.floor(F.col(index) / hop).cast("bigint")
    rows = samples.withColumn("frame_idx", F.explode(F.sequence(first, last))).join(length, key)
    return rows.filter(F.col("frame_idx") * hop + fft <= F.col("_n")).select(
        key, "frame_idx", (F.col(index) - F.col("frame_idx") * hop).cast("int").alias("offset"), value)


def context_windows(frames: DataFrame, vector: str, context: int, keys: Sequence[str], pos: str, width: int,
                    pad: Column, out: str = "window") -> DataFrame:
    """The last ``context`` frame vectors up to each row, left-padded with ``pad``."""
    def build(w):
        return {out: F.collect_list(vector).over(w.rowsBetween(-(context - 1), Window.currentRow))}
    rows = edge_window(frames, keys, pos, [], width, context - 1, build)
    return rows.withColumn(out, F.concat(F.array_repeat(pad, F.lit(context) - F.size(out)), F.col(out)))


def window_ends(labels: DataFrame, keys: Sequence[str], pos: str, positive: Column, stride: int, width: int) -> DataFrame:
    """Window ends per key: every ``stride``-th frame from the first, the last one, and all positive ones."""
    numbered = ordinal(labels.withColumn("_positive", positive), keys, pos, [], width, "_i")
    length = numbered.groupBy(*keys).agg((F.max("_i") + 1).alias("_n"))
    rows = numbered.join(length, list(keys))
    wanted = (F.col("_i") % stride == 0) | F.col("_positive") | (F.col("_i") == F.col("_n") - 1)
    return rows.filter(wanted).withColumn("window_end", F.col("_i") + 1).drop("_positive", "_i", "_n")


def onset_frame(onset: Column, hop: int = params.HOP_SIZE, fft: int = params.FFT_SIZE) -> Column:
    """First frame that holds a full hop after the onset."""
    return F.greatest(F.lit(0), F.ceil((onset + hop - fft) / hop)).cast("bigint")


def onset_targets(events: DataFrame, lengths: DataFrame, weights: Sequence[float] = params.ONSET_WEIGHTS,
                  hop: int = params.HOP_SIZE, fft: int = params.FFT_SIZE, order: str = "event_id",
                  keys: Sequence[str] = ("session_id", "class"), classes: Sequence[str] | None = None,
                  sources: Sequence[str] = ("self", "remote", "unknown")) -> DataFrame:
    """Soft labels per frame and class: strongest weight; source of the last event in ``order``.

    ``lengths`` gives ``frame_count`` per session.  Frames without events have no row.  Uncertain events and, if ``classes``
    is given, those of other classes label nothing; a source that is not in ``sources`` counts as unknown.
    """
    if "uncertain" in events.columns:
        events = events.filter(~F.coalesce("uncertain", F.lit(False)))
    if classes is not None:
        events = events.filter(F.col("class").isin(*classes))
    events = events.withColumn("source_hint", F.when(F.col("source_hint").isin(*sources), F.col("source_hint")).otherwise("unknown"))
    steps = F.posexplode(F.array(*[F.lit(float(x)) for x in weights])).alias("_step", "_weight")
    rows = events.select(*keys, "source_hint", F.col(order).alias("_order"),
                         onset_frame(F.col("onset_sample"), hop, fft).alias("_start"), steps)
    rows = rows.withColumn("frame_idx", F.col("_start") + F.col("_step")).join(
        lengths.select("session_id", "frame_count"), "session_id").filter("frame_idx < frame_count")
    return rows.groupBy(*keys, "frame_idx").agg(F.max("_weight").alias("label"),
                                                F.max_by("source_hint", "_order").alias("source_hint"))


# --- windows and clips ---------------------------------------------------------------------------------

def extract_windows(chunks: DataFrame, windows: DataFrame, block: int = 65_536, keep: Sequence[str] = ("window_id",)) -> DataFrame:
    """Samples [start, start + n) per window row, NULL where any part is outside the recording.

    Both sides meet on (session, block of positions); a window touching several blocks asks each of them.
    """
    start, end = F.col("window_start"), F.col("window_start") + F.col("window_frames")
    asks = (windows.select("session_id", *keep, "window_start", "window_frames")
            .withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block)))))
    pieces = blocks_of(chunks, block, 0)
    rows = asks.join(pieces, ["session_id", "block"])
    lo = F.greatest(start, F.col("piece_start"))
    hi = F.least(end, F.col("piece_start") + F.size("left"))
    cut = lambda c: F.slice(c, (lo - F.col("piece_start") + 1).cast("int"), (hi - lo).cast("int"))
    parts = rows.filter(hi > lo).groupBy("session_id", *keep, "window_frames").agg(
        F.array_sort(F.collect_list(F.struct(lo.alias("at"), cut("left").alias("left"), cut("right").alias("right")))).alias("parts"),
        F.sum(hi - lo).alias("got"))
    full = parts.filter("got = window_frames").select("session_id", *keep, *[
        F.flatten(F.col(f"parts.{name}")).alias(name) for name in ("left", "right")])
    return windows.join(full, ["session_id", *keep], "left")


def window_by_time(center: Column, pre: Column, post: Column, rate: int = params.SAMPLE_RATE) -> tuple[Column, Column]:
    """(start, frames) of a window given in seconds, each term rounded to samples; NULL before position 0."""
    at, before, after = (F.round(x * rate).cast("bigint") for x in (center, pre, post))
    return F.when(at >= before, at - before), before + after


def activity_bounds(clips: DataFrame, rate: int = params.SAMPLE_RATE, before: float = 0.02, after: float = 0.20) -> DataFrame:
    """Trim bounds and audible onset of clips held in one row; all-silent clips keep (0, n, 0)."""
    envelope = F.zip_with("left", "right", lambda a, b: F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double"))))
    rows = clips.withColumn("_env", envelope).withColumn("_n", F.size("left"))
    rows = rows.withColumn("_level", F.greatest(F.lit(0.005), F.array_max("_env") * 0.02))
    rows = rows.withColumn("_on", F.expr("filter(sequence(0, _n - 1), i -> _env[i] >= _level)"))
    first, last = F.element_at("_on", 1), F.element_at("_on", -1)
    quiet = F.size("_on") == 0
    return rows.withColumns({
        "trim_start": F.when(quiet, 0).otherwise(F.greatest(F.lit(0), first - round(before * rate))),
        "trim_end": F.when(quiet, F.col("_n")).otherwise(F.least(F.col("_n"), last + round(after * rate) + 1)),
        "audible": F.when(quiet, 0).otherwise(first)}).drop("_env", "_n", "_level", "_on")


def signal_bounds(samples: DataFrame, key: str, index: str, level: str, before: int, after: int) -> DataFrame:
    """The same for long recordings with one row per sample: peak first, then first and last active."""
    peak = samples.groupBy(key).agg(F.max(F.abs(F.col(level))).alias("_peak"), (F.max(index) + 1).alias("_n"))
    on = F.abs(F.col(level)) >= F.greatest(F.lit(0.005), F.col("_peak") * 0.02)
    found = samples.join(peak, key).groupBy(key).agg(
        F.min(F.when(on, F.col(index))).alias("_first"), F.max(F.when(on, F.col(index))).alias("_last"), F.max("_n").alias("_n"))
    quiet = F.col("_first").isNull()
    return found.select(
        key, F.when(quiet, 0).otherwise(F.greatest(F.lit(0), F.col("_first") - before)).alias("trim_start"),
        F.when(quiet, F.col("_n")).otherwise(F.least(F.col("_n"), F.col("_last") + after + 1)).alias("trim_end"),
        F.when(quiet, 0).otherwise(F.col("_first")).alias("audible"))


def trim_silence(clips: DataFrame, rate: int = params.SAMPLE_RATE, before: float = 0.02, after: float = 0.20) -> DataFrame:
    rows = activity_bounds(clips, rate, before, after)
    cut = lambda c: F.slice(c, F.col("trim_start") + 1, F.col("trim_end") - F.col("trim_start"))
    return rows.withColumns({"left": cut("left"), "right": cut("right"),
                             "onset_offset": F.greatest(F.lit(0), F.col("audible") - F.col("trim_start"))})


def local_snr(samples: DataFrame, events: DataFrame, around: int, width: int, index: str = "idx", value: str = "value") -> DataFrame:
    """20 log10 of the event's RMS over the RMS of +-``around`` positions, with floors 1e-9 and 1e-5.

    Both energies are differences of one running sum of squares, so overlapping events cost no extra rows.
    """
    squares = samples.withColumn("_sq", F.col(value) * F.col(value))
    sums = running(squares, ["session_id"], index, [], width, {"_cum": ("sum", "_sq")}).select(
        "session_id", F.col(index).alias("_at"), "_cum")
    length = samples.groupBy("session_id").agg((F.max(index) + 1).alias("_n"))
    rows = events.join(length, "session_id").withColumns({
        "_a": F.greatest(F.lit(0), F.col("onset_sample")), "_b": F.least(F.col("end_sample"), F.col("_n")),
        "_c": F.greatest(F.lit(0), F.col("onset_sample") - around), "_d": F.least(F.col("onset_sample") + around, F.col("_n"))})
    for edge in "abcd":
        at = sums.select("session_id", (F.col("_at") + 1).alias(f"_{edge}"), F.col("_cum").alias(f"_s{edge}"))
        rows = rows.join(at, ["session_id", f"_{edge}"], "left")
    total = lambda hi, lo: F.coalesce(F.col(f"_s{hi}"), F.lit(0.0)) - F.coalesce(F.col(f"_s{lo}"), F.lit(0.0))
    rms = lambda hi, lo: F.when(F.col(f"_{hi}") > F.col(f"_{lo}"), F.sqrt(F.greatest(F.lit(0.0), total(hi, lo)) / (
        F.col(f"_{hi}") - F.col(f"_{lo}")))).otherwise(0.0)
    snr = 20.0 * F.log10(F.greatest(F.lit(1e-9), rms("b", "a")) / F.greatest(F.lit(1e-5), rms("d", "c")))
    return rows.withColumn("snr_db", snr).select(*events.columns, "snr_db")


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2.0)


def deinterleave(values: Column, channel: int) -> Column:
    return F.filter(values, lambda x, i: i % 2 == channel)


def fit_clip(clip: Column, source_onset: Column, scene_onset: Column, length: int) -> Column:
    """Place a clip so that its onset falls on the scene onset; cut or zero-pad to ``length``."""
    shift = (scene_onset - source_onset).cast("int")
    skip, lead = F.greatest(F.lit(0), -shift), F.greatest(F.lit(0), shift)
    body = F.slice(clip, skip + 1, F.greatest(F.lit(0), F.least(F.size(clip) - skip, F.lit(length) - lead)))
    zero = F.lit(0.0)
    placed = F.concat(F.array_repeat(zero, F.least(lead, F.lit(length))), body)
    return F.concat(placed, F.array_repeat(zero, F.lit(length) - F.size(placed)))


def mirror_augment(rows: DataFrame, planes: str, targets: str, coin: Column) -> DataFrame:
    """Swap left and right where ``coin`` is true: negate planes 2 and 4 and the x of every target."""
    flipped = F.transform(planes, lambda p, i: F.when((i == 2) | (i == 4), F.transform(p, lambda x: -x)).otherwise(p))
    mirrored = F.transform(targets, lambda c: F.transform(c, lambda v: F.transform(v, lambda x, i: F.when(i == 0, -x).otherwise(x))))
    return rows.withColumns({planes: F.when(coin, flipped).otherwise(F.col(planes)),
                             targets: F.when(coin, mirrored).otherwise(F.col(targets))})


def resample_linear(samples: DataFrame, from_rate: int, to_rate: int, key: str, index: str, value: str, width: int) -> DataFrame:
    """Linear interpolation of a dense sample table: each input interval makes the outputs inside it."""
    rows = edge_window(samples, [key], index, [], width, 1, lambda w: {"_next": F.lead(value).over(w)})
    # output j lies at input position j * from / to
    first = F.ceil(F.col(index) * to_rate / F.lit(float(from_rate))).cast("bigint")
    last = F.ceil((F.col(index) + 1) * to_rate / F.lit(float(from_rate))).cast("bigint") - 1
    rows = rows.filter(last >= first).withColumn("out_idx", F.explode(F.sequence(first, last)))
    share = F.col("out_idx") * from_rate / F.lit(float(to_rate)) - F.col(index)
    return rows.select(key, "out_idx", (F.col(value) + (F.coalesce("_next", value) - F.col(value)) * share).alias(value))


LOBES = 32  # zero crossings of the interpolation kernel on each side


def interpolate(x: np.ndarray, from_rate: int, to_rate: int, block: int = 1 << 14) -> np.ndarray:
    """One channel at another rate: every output is a sum of nearby inputs under a sinc kernel tapered by a Hann window.

    The kernel's cut-off is the lower of both half rates; outside the clip is silence.  With the rates' ratio in lowest
    terms, outputs fall on few positions between inputs, so one table of weights serves all.
    """
    shared = math.gcd(from_rate, to_rate)
    up, down = to_rate // shared, from_rate // shared
    narrow = min(1.0, to_rate / from_rate)
    reach = math.ceil(LOBES / narrow)
    offset = np.arange(1 - reach, reach + 1)
    away = narrow * (np.arange(up)[:, None] / up - offset)
    weights = narrow * np.sinc(away) * np.where(np.abs(away) < LOBES, np.cos(np.pi * away / (2 * LOBES)) ** 2, 0.0)
    heard = np.pad(x, reach)
    out = np.empty(round(len(x) * to_rate / from_rate))
    for first in range(0, len(out), block):
        at = np.arange(first, min(first + block, len(out))) * down
        out[first:first + block] = np.einsum("ij,ij->i", heard[at[:, None] // up + offset + reach], weights[at % up])
    return out


def resample_clips(clips: DataFrame, to_rate: int = params.SAMPLE_RATE) -> DataFrame:
    """Clips held in one row to ``to_rate``, band-limited; long recordings use ``resample_linear`` on their samples."""
    @F.pandas_udf("array<double>")
    def convert(values: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, float) if r == to_rate or not len(v) else interpolate(np.asarray(v, float), int(r), to_rate)
                          for v, r in zip(values, rates)])
    return clips.withColumns({c: convert(F.col(c), F.col("sample_rate")) for c in ("left", "right")}).withColumn(
        "sample_rate", F.lit(to_rate))
