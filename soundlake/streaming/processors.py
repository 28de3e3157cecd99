"""Stateful operators over micro-batches.  Each keeps a bounded state per stream and gives the same rows as
its batch form on the same input, however the input is cut into batches.

Rows with ``kind = 'end'`` close a stream: what is pending is emitted and the state is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake import params
from soundlake.operators.features import mel_filterbank

STATE = "payload string"


BUCKETS = 256  # groups that the keys of a stream are dealt to; a group's rows of one micro-batch are in memory


def _run(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: str, start: dict, step, buckets: int = BUCKETS) -> DataFrame:
    """``step(state, rows)`` gets the key's rows of one batch in order and returns output tuples.

    A group of the stateful operator costs tables and a state call, whatever its size, so it holds the keys of a bucket, as texts.
    """
    known = T.StructType([stream.schema[k] for k in keys])
    names = [c.split()[0] for c in columns.split(", ")]
    blank = json.dumps(start)

    def process(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        rows["stream_number"], streams = pd.factorize(rows["stream_key"])
        rows = rows.sort_values(["stream_number", *order], kind="stable")
        edges = np.searchsorted(rows["stream_number"].to_numpy(), np.arange(len(streams) + 1))
        records = rows.to_dict("records")
        states = json.loads(state.get[0]) if state.exists else {}
        found = []
        for stream_key, a, b in zip(streams, edges, edges[1:]):
            held = states.pop(stream_key, None) or json.loads(blank)
            some = records[a:b]
            found += [(stream_key, *out) for out in step(held, some)]
            if not any(row.get("kind") == "end" for row in some):
                states[stream_key] = held
        if states:
            state.update((json.dumps(states),))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["stream_key", *names])
    grouped = stream.withColumn("stream_key", F.to_json(F.struct(*keys))).withColumn("stream_bucket", F.pmod(F.xxhash64("stream_key"), F.lit(buckets)).cast("int"))
    out = grouped.drop(*keys).groupBy("stream_bucket").applyInPandasWithState(process, f"stream_key string, {columns}", STATE, "append", "NoTimeout")
    return out.withColumn("stream_key", F.from_json("stream_key", known)).select(*[F.col("stream_key")[k].alias(k) for k in keys], *names)


def stream_generations(blocks: DataFrame, keys: Sequence[str], first: str = "first_sample", frames: str = "frames") -> DataFrame:
    """Generation and position of each block; a block that does not continue the previous one opens a new one."""
    def step(held, rows):
        out = []
        for row in rows:
            if row.get("kind") == "end":
                continue
            fresh = held["next"] != row[first]
            if fresh:
                held["generation"] += 1
                held["start"] = int(row[first])
            held["next"] = int(row[first] + row[frames])
            out.append((int(row[first]), held["generation"], int(row[first]) - held["start"], fresh))
        return out
    return _run(blocks, keys, [first], f"{first} bigint, stream_generation bigint, generation_sample bigint, discontinuity boolean",
                {"next": None, "generation": -1, "start": 0}, step)


def stream_scenes(events: DataFrame, *, join: int, pre_anchor: int, length: int, retention: int | None = None,
                  keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("arrival",)) -> DataFrame:
    """Scenes of a live event stream, in arrival order.

    ``kind``: 'event' (onset_sample, event_id, stream_generation), 'clock' (onset_sample is the newest
    position heard) or 'end'.  An event joins the first pending scene it fits into, even if it comes late;
    a scene is emitted when the clock passes its end; another generation drops what is pending.  State:
    pending scenes only.
    """
    def ready(held, newest, out):
        oldest = newest - retention if retention is not None else 0
        while held["pending"] and held["pending"][0]["end"] <= newest:
            scene = held["pending"].pop(0)
            members = sorted(scene["events"])
            for onset, ident in members:
                out.append((scene["id"], held["generation"], scene["first"], scene["start"], scene["end"],
                            scene["start"] >= oldest, ident, onset, len(members)))

    def place(held, onset, ident):
        for scene in held["pending"]:
            first, last = min(scene["first"], onset), max(scene["last"], onset)
            if last - first <= join:
                scene.update(first=first, last=last, start=max(0, first - pre_anchor))
                scene["end"] = scene["start"] + length
                scene["events"].append([onset, ident])
                break
        else:
            start = max(0, onset - pre_anchor)
            held["pending"].append({"id": held["next"], "first": onset, "last": onset, "start": start, "end": start + length,
                                    "events": [[onset, ident]]})
            held["next"] += 1
        held["pending"].sort(key=lambda s: s["first"])

    def step(held, rows):
        out = []
        for row in rows:
            if row["kind"] == "event":
                generation = int(row["stream_generation"])
                if generation != held["generation"]:
                    held["pending"], held["generation"] = [], generation
                place(held, int(row["onset_sample"]), int(row["event_id"]))
            elif row["kind"] == "clock":
                ready(held, int(row["onset_sample"]), out)
            else:
                ready(held, max((s["end"] for s in held["pending"]), default=0), out)
        return out
    return _run(events, keys, order, "scene_id bigint, stream_generation bigint, anchor_sample bigint, scene_start bigint, scene_end bigint, "
                "audio_available boolean, event_id bigint, onset_sample bigint, event_count bigint",
                {"generation": None, "next": 1, "pending": []}, step)


def stream_features(chunks: DataFrame, *, rate: int = params.SAMPLE_RATE, fft: int = params.FFT_SIZE, hop: int = params.HOP_SIZE,
                    bands: int = params.MEL_BINS, gain_db: float = 0.0, activity_frames: int = params.ACTIVITY_FRAMES,
                    keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Feature frames of a live recording for chunks of any size, in order of ``first_sample``.

    State: fewer than ``fft`` samples, one smoothed energy per band, the activity.  A gap starts over.
    """
    gain, keep = 10.0 ** (gain_db / 10.0), 1.0 - params.PCEN_SMOOTHING
    share = 2.0 / (max(1, activity_frames) + 1.0)
    weights = mel_filterbank(rate, fft, bands).T
    blank = {"next": None, "frame": 0, "tail": [], "smooth": None, "activity": None}

    def step(held, rows):
        out = []
        for row in rows:
            if row.get("kind") == "end":
                continue
            piece = np.stack([row["left"], row["right"]], axis=1).astype(np.float64)
            if held["next"] is not None and held["next"] != row["first_sample"]:
                held.update(json.loads(json.dumps(blank)))
            samples = np.concatenate([np.asarray(held["tail"], dtype=np.float64).reshape(-1, 2), piece])
            held["next"] = int(row["first_sample"]) + len(piece)
            count = max(0, 1 + (len(samples) - fft) // hop) if len(samples) >= fft else 0
            held["tail"] = samples[count * hop:].tolist()
            if not count:
                continue
            index = (np.arange(count) * hop)[:, None] + np.arange(fft)[None, :]
            spectrum = np.fft.rfft(samples[index] * np.hanning(fft)[None, :, None], axis=1)
            left, right = spectrum[..., 0], spectrum[..., 1]
            mel_l, mel_r = (np.abs(x) ** 2 / fft ** 2 @ weights for x in (left, right))
            cross = left * np.conj(right) / fft ** 2 @ weights
            energy = 0.5 * gain * (mel_l + mel_r)
            level = np.clip(10.0 * np.log10(np.maximum(energy, 1e-10)), -100.0, 0.0)
            ild = np.clip(10.0 * np.log10((mel_l + 1e-10) / (mel_r + 1e-10)) / 30.0, -1.0, 1.0)
            coherence = cross / (np.sqrt(mel_l * mel_r) + 1e-10)
            for i in range(count):
                smooth = energy[i] if held["smooth"] is None else keep * np.asarray(held["smooth"]) + params.PCEN_SMOOTHING * energy[i]
                instant = float(np.clip((level[i].mean() + 80.0) / 60.0, 0.0, 1.0))
                held["activity"] = instant if held["activity"] is None else share * instant + (1.0 - share) * held["activity"]
                held["smooth"] = smooth.tolist()
                pcen = (energy[i] / (params.PCEN_EPSILON + smooth) ** params.PCEN_ALPHA + params.PCEN_DELTA) ** params.PCEN_ROOT \
                    - params.PCEN_DELTA ** params.PCEN_ROOT
                planes = np.stack([pcen, level[i], ild[i], np.clip(coherence[i].real, -1, 1), np.clip(coherence[i].imag, -1, 1)])
                out.append((held["frame"], held["frame"] * hop, planes.tolist(), held["activity"]))
                held["frame"] += 1
        return out
    return _run(chunks, keys, ["first_sample"], "frame_idx bigint, start_sample bigint, planes array<array<double>>, activity double", blank, step)


def stream_retention(blocks: DataFrame, capacity: int, keys: Sequence[str] = ("session_id",), first: str = "first_sample",
                     frames: str = "frames") -> DataFrame:
    """Per block: the oldest position still retained after it.  A gap starts a new history."""
    def step(held, rows):
        out = []
        for row in rows:
            if row.get("kind") == "end":
                continue
            if held["next"] != row[first]:
                held["oldest"] = int(row[first])
            held["next"] = int(row[first] + row[frames])
            held["oldest"] = max(held["oldest"], held["next"] - capacity)
            out.append((int(row[first]), held["oldest"], held["next"]))
        return out
    return _run(blocks, keys, [first], f"{first} bigint, oldest_sample bigint, newest_sample bigint", {"next": None, "oldest": 0}, step)
