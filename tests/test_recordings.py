"""Recordings as a data source: many tasks a file, files beyond 2 GB, commits."""

import os
import struct
import wave

import numpy as np
import pytest

from soundlake.sources import recordings, wav


def written(path, values, rate=8000, channels=2):
    with wave.open(path, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(values, "<i2").tobytes())


def test_three_frames_in_three_tasks(spark, folder):
    written(f"{folder}/a.wav", [[1, 2], [3, 4], [5, 6]])
    written(f"{folder}/b.wav", [[7], [8]], channels=1)
    open(f"{folder}/_hidden.wav", "wb").close()
    df = recordings.scan_recordings(spark, folder, chunk=1, split_bytes=4)
    assert df.rdd.getNumPartitions() == 4  # both mono frames fit in one range
    got = {(r.session_id, r.first_sample): (r.left, r.right) for r in df.collect()}
    assert got == {("a", k): ([(2 * k + 1) / 32768], [(2 * k + 2) / 32768]) for k in range(3)} | {("b", k): ([(7 + k) / 32768],) * 2 for k in range(2)}
    packed = recordings.scan_recordings(spark, folder, chunk=2, split_bytes=1 << 20)
    assert packed.rdd.getNumPartitions() == 1 and packed.count() == 3


def test_files_beyond_two_gigabytes(folder):
    """A sparse file of 3 GB and one of 5 GB: planned in ranges, the last ones read alone."""
    for name, frames in (("x", 750_000_000), ("y", 1_250_000_000)):
        head = wav.file_header(frames, 48_000, None, 0)
        with open(f"{folder}/{name}.wav", "wb") as stream:
            stream.write(head)
            stream.truncate(len(head) + 4 * frames)
            stream.seek(len(head) + 4 * (frames - 2))
            stream.write(struct.pack("<4h", 1, -2, 3, -4))
        reader = wav.RecordingReader({"path": f"file://{folder}"})
        parts = [p for p in reader.partitions() if p.ranges[-1][1].endswith(f"{name}.wav")]
        assert len(parts) >= 4 * frames // wav.SPLIT_BYTES and sum(b - a for p in parts for *_, path, _, a, b in p.ranges if path.endswith(f"{name}.wav")) == frames
        *_, last = reader.read(parts[-1])
        rows = last.to_pylist()
        assert rows[-1]["first_sample"] + len(rows[-1]["left"]) == frames
        assert rows[-1]["left"][-2:] == [1 / 32768, 3 / 32768] and rows[-1]["right"][-2:] == [-2 / 32768, -4 / 32768]


def test_odd_files(spark, folder):
    with open(f"{folder}/list.wav", "wb") as s:  # another chunk before the samples, and an odd length cut short
        s.write(struct.pack("<4sI4s", b"RIFF", 100, b"WAVE") + struct.pack("<4sI", b"LIST", 5) + b"abcde\0")
        s.write(struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16) + struct.pack("<4sI", b"data", 1000) + struct.pack("<3h", 1, 2, 3) + b"\1")
    with open(f"{folder}/float.wav", "wb") as s:
        s.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36, b"WAVE", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32, b"data", 0))
    open(f"{folder}/empty.wav", "wb").close()
    got = {r.session_id: r for r in recordings.scan_recordings(spark, folder).collect()}
    assert got["list"].left == [1 / 32768, 2 / 32768, 3 / 32768] and got["list"].error is None
    assert "unsupported" in got["float"].error and "WAVE" in got["empty"].error
    nothing = f"{folder}/nothing"
    os.makedirs(nothing)
    assert recordings.scan_recordings(spark, nothing).collect() == []


def test_commit_publishes_and_abort_leaves_nothing(spark, folder):
    rows = [("a", 0, [.5, .25], [0.0, 0.0]), ("b", 0, [.5], [0.0])]
    chunks = spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")
    recordings.write_recordings(chunks, f"{folder}/w", 8000)
    recordings.write_recordings(chunks.where("session_id = 'a'"), f"{folder}/w", 8000)
    assert sorted(os.listdir(f"{folder}/w")) == ["a.wav", "b.wav"]
    broken = spark.range(1).selectExpr("'c' AS file", "0L AS position", "1L AS frames", "CAST(NULL AS STRING) AS recording", "array(1S) AS left", "array(CAST(raise_error('stop') AS SMALLINT)) AS right")
    with pytest.raises(Exception, match="stop"):
        broken.write.format(wav.FORMAT).option("rate", 8000).mode("append").save(f"file://{folder}/w")
    assert sorted(os.listdir(f"{folder}/w")) == ["a.wav", "b.wav"]


def test_inventory_offsets_at_the_common_rate(spark, folder):
    """Silence, then a tone: 100 positions at half the rate are 200, more than 20 ms count as 20 ms."""
    tone = (8000 * np.sin(np.arange(2400) * .2)).astype(int)
    for name, rate, quiet in (("a", 24_000, 100), ("b", 48_000, 300), ("c", 48_000, 5000)):
        written(f"{folder}/{name}.wav", np.r_[np.zeros(quiet, int), tone], rate, 1)
    written(f"{folder}/silent.wav", np.zeros(50, int), 48_000, 1)
    got = {r.relative_path: r.active_offset_samples for r in recordings.scan_inventory_tree(spark, folder).collect()}
    assert abs(got["a.wav"] - 200) <= 12 and abs(got["b.wav"] - 301) <= 1 and got["c.wav"] == 960 and got["silent.wav"] == 0


def test_clips_are_packed_in_shards(spark, folder):
    """One file per shard, whatever the number of clips; long recordings stay files; chunks and names come back."""
    chunks = spark.createDataFrame([("a", 0, [i / 1000 for i in range(1000)], [0.0] * 1000)], "session_id string, first_sample bigint, left array<double>, right array<double>")
    windows = spark.range(300).selectExpr("'a' AS session_id", "id AS window_id", "id AS window_start", "5L AS window_frames").unionByName(
        spark.range(1).selectExpr("'a' AS session_id", "999L AS window_id", "998L AS window_start", "5L AS window_frames")).repartition(4)
    assert recordings.export_clips(chunks, windows, f"{folder}/c", 8000).count() == 300
    names = os.listdir(f"{folder}/c")
    assert len(names) <= 4 and all(n.endswith(".tar") for n in names)
    got = {}
    for r in recordings.scan_recordings(spark, f"{folder}/c", chunk=2).collect():
        assert r.error is None and r.chunk_idx == r.first_sample // 2 and r.sample_rate == 8000
        got.setdefault(r.session_id, {})[r.first_sample] = r.left
    assert len(got) == 300 and all(sorted(x) == [0, 2, 4] for x in got.values())
    assert np.allclose(sum((got["a_7"][k] for k in (0, 2, 4)), []), [k / 1000 for k in range(7, 12)], atol=1e-4)
    with pytest.raises(FileExistsError):
        recordings.export_clips(chunks, windows, f"{folder}/c", 8000)
    long = chunks.unionByName(spark.range(1).selectExpr("'b' AS session_id", "0L AS first_sample", "array_repeat(0.5D, 300000) AS left", "array_repeat(0.5D, 300000) AS right"))
    made = {r.session_id: r.path for r in recordings.write_recordings(long, f"{folder}/m", 8000, packed=True).collect()}
    assert made == {"a": f"{folder}/m", "b": f"{folder}/m/b.wav"} and sorted(n[-4:] for n in os.listdir(f"{folder}/m")) == [".tar", ".wav"]
    frames = {r.session_id: r.n for r in recordings.scan_recordings(spark, f"{folder}/m").groupBy("session_id").agg({"left": "count"}).withColumnRenamed("count(left)", "n").collect()}
    assert frames == {"a": 1, "b": 5}
