"""Fixed small inputs with known results."""

import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlake.functions import geometry as g
from soundlake.operators import corpus, direction, features, metrics, peaks, sampling, scenes, validation
from soundlake.sources import recordings, tables
from soundlake.streaming import processors, sinks


def trace(spark, values, first=0, step=480, source=(0.1, 0.8, 0.1)):
    rows = [("s", "a", first + i * step, i, float(p), 0.0, list(source)) for i, p in enumerate(values)]
    return spark.createDataFrame(rows, "session_id string, class string, sample bigint, event_id bigint, probability double, activity double, source_probs array<double>")


def test_burst_gives_two_events(spark):
    values = [.1, .4, .9, .7, .65, .7, .8, .7, .95, .6, .2, .1]
    found = peaks.min_spacing(peaks.local_peaks(trace(spark, values), .6, .8, .5, 1, 2000), 1680, 2000)
    assert sorted(r["sample"] for r in found.collect()) == [960, 3840]


def test_event_policy_and_suppression(spark):
    values = [.1, .4, .9, .3] + [.1] * 11
    options = dict(quiet=.5, busy=.5, cutoff=.5, lookahead=2, spacing=1680, onset_offset=500, width=4000)
    event = peaks.peak_events(trace(spark, values, 1024), **options).collect()
    assert [(e["onset_sample"], e["detected_sample"], e["source_hint"], e["scene_mode"]) for e in event] == [(1484, 2944, "remote", "quiet")]
    own = trace(spark, values, 1024, source=(.98, .01, .01))
    assert [e["suppressed"] for e in peaks.peak_events(own, self_threshold=.95, **options).collect()] == [True]
    assert peaks.peak_events(own, self_threshold=.95, include_suppressed=False, **options).count() == 0


def test_plateau_is_one_peak(spark):
    assert peaks.local_peaks(trace(spark, [.7] * 9), .5, .5, .5, 2, 1000).count() == 1


def test_scene_span_is_bounded(spark):
    rows = spark.createDataFrame([("s", o, i) for i, o in enumerate((10000, 15760, 15761))], "session_id string, onset_sample bigint, event_id bigint")
    got = {r["event_id"]: (r["anchor_sample"], r["scene_start"], r["scene_end"]) for r in scenes.assign_scenes(rows).collect()}
    assert got[0] == got[1] == (10000, 8080, 8080 + 12304) and got[2][0] == 15761


def run_scenes(spark, folder, arrivals):
    columns = "session_id string, onset_sample bigint, event_id bigint, stream_generation int, kind string, arrival bigint"
    rows = spark.createDataFrame([("s", o, i, gen, kind, i) for i, (kind, o, gen) in enumerate(arrivals)], columns)
    for i in range(len(arrivals)):
        rows.filter(F.col("arrival") == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = processors.stream_scenes(sinks.replay(spark, f"{folder}/in", rows.schema, 2), join=5760, pre_anchor=1920, length=12304, retention=48000)
    sinks.run_to_table(stream, f"{folder}/out", f"{folder}/ck")
    return sorted((r["anchor_sample"], r["onset_sample"], r["audio_available"]) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect())


def test_late_event_moves_the_anchor(spark, folder):
    assert run_scenes(spark, folder, [("event", 20000, 0), ("event", 16160, 0), ("clock", 16160 - 1920 + 12304, 0)]) == [
        (16160, 16160, True), (16160, 20000, True)]


def test_scene_is_not_widened_and_generation_drops(spark, folder):
    got = run_scenes(spark, folder, [("event", 20000, 0), ("event", 24800, 0), ("event", 15200, 0), ("clock", 25583, 0), ("clock", 25584, 0),
                                     ("event", 500, 1), ("clock", 90000, 1)])
    assert got == [(500, 500, False), (15200, 15200, True)]


def test_uncertainty_and_quadrants(spark):
    table = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(e).alias("p90")) for c, e in ((0.0, 60.0), (0.5, 25.0), (1.0, 8.0))])
    row = spark.range(1).select(*[g.uncertainty_lookup(table, F.lit(c)).alias(n) for n, c in (("a", .75), ("b", -1.0), ("c", 2.0))],
                                g.azimuth_quadrant(F.lit(-10.0)).alias("q"), g.vector_direction(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert (row["a"], row["b"], row["c"], row["q"]) == (16.5, 60.0, 8.0, "front") and row["z"]["confidence"] == 0


def unit(az, el, scale=1.0):
    a, e = math.radians(az), math.radians(el)
    return [scale * math.cos(e) * math.sin(a), scale * math.sin(e), scale * math.cos(e) * math.cos(a)]


def test_decode_merges_close_tracks(spark):
    zero = [0.0] * 3
    rows = [("x", [[zero] * 3, [unit(0, 10, .9), unit(3, 10, .8), unit(15, -5, .85)]])]
    df = spark.createDataFrame(rows, "scene_id string, tracks array<array<array<double>>>")
    sources = direction.decode_tracks(df, "tracks", [.3, .3]).first()["sources"]
    assert [s["cls"] for s in sources] == [1, 1] and [round(s["confidence"], 2) for s in sources] == [.9, .85]
    masked = direction.decode_tracks(df, "tracks", [.3, .3], enabled=F.lit(1)).first()["sources"]
    assert masked == []


def test_perfect_directions_pass(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(60):
        n = i % 4
        az = [(20.0 * k + rng.uniform(0, 300)) % 360 for k in range(1)] if n else []
        angles = [(az[0] + 20.0 * k) % 360 for k in range(n)]
        tensor = [[[0.0] * 3 for _ in range(3)] for _ in range(2)]
        for k, a in enumerate(angles):
            tensor[k % 2][k // 2] = unit(a, 5.0 * k)
        rows.append((f"s{i}", tensor, n, "close-15-30" if n > 1 else "standard"))
    df = spark.createDataFrame(rows, "scene_id string, target array<array<array<double>>>, target_count int, stratum string")
    scored = direction.decode_tracks(df.withColumn("truths", direction.truth_list("target", 2)), "target", [.3, .3])
    row = direction.direction_gates(direction.direction_metrics(scored, 2), "synthetic").first()
    assert row["accepted"] and row["exact_count_accuracy"] == 1.0 and row["p90_error"] < 1e-4
    assert df.select(direction.adpit_loss("target", "target", 2).alias("l")).agg(F.max("l")).first()[0] < 1.0


def test_path_rules(spark):
    paths = {"weapons/negev/negev_clean_01.wav": ("gunshot", "weapon_report", "review"), "weapons/m4a1/m4a1_silencer_on.wav": ("mechanical", "attachment", "accepted"),
             "weapons/elite/elite_sideback.wav": ("mechanical", "weapon_action", "accepted"), "player/footsteps/concrete_01.wav": ("footstep", "step", "accepted")}
    df = spark.createDataFrame([(p,) for p in paths], "p string").withColumn("c", corpus.classify_path(F.col("p")))
    for r in df.collect():
        assert (r["c"]["label"], r["c"]["subtype"], r["c"]["review"]) == paths[r["p"]]


def test_split_is_stable_and_leaks_nothing(spark):
    rows = [(f"{l}{grp}_{i}", f"{l}/{grp}/{i}", l, f"g{grp}", f"{l}{grp}{i}", "", True) for l in ("gunshot", "footstep", "mechanical", "other") for grp in range(12) for i in range(2)]
    df = spark.createDataFrame(rows, "asset_id string, relative_path string, label string, source_group string, sha256 string, duplicate_of string, included boolean")
    one, two = (corpus.grouped_split(df.repartition(n), 42) for n in (1, 7))
    a, b = ({r["asset_id"]: r["split"] for r in x.collect()} for x in (one, two))
    assert a == b and set(a.values()) == {"train", "dev", "test"} and corpus.leakage_check(one).count() == 0
    assert corpus.leakage_check(df.withColumn("split", F.when(F.col("asset_id").endswith("_0"), "train").otherwise("dev"))).count() > 0


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i % 5)) for i in range(200)], "a int, b string")
    prints = [corpus.dataset_fingerprint(x, ["a", "b"]).first()["fingerprint"] for x in (df, df.orderBy(F.desc("a")).repartition(6), df.filter("a < 199"))]
    assert prints[0] == prints[1] != prints[2]


def test_allocation(spark):
    got = sampling.proportional_allocation(spark.createDataFrame([(1, 100), (2, 7)], "g int, n int"), "n", (.10, .15, .35, .40), ["g"]).collect()
    assert [r["allocated"] for r in sorted(got, key=lambda r: (r["g"], r["share_idx"]))] == [10, 15, 35, 40, 1, 1, 2, 3]


def sine_chunks(spark, n, sizes):
    i = np.arange(n)
    left = .35 * np.sin(2 * np.pi * 437 * i / 48000) + .12 * np.cos(2 * np.pi * 2111 * i / 48000)
    right = .27 * np.sin(2 * np.pi * 437 * i / 48000 - .45) + .18 * np.cos(2 * np.pi * 3203 * i / 48000 + .2)
    rows, at = [], 0
    for size in [*sizes, n]:
        stop = min(n, at + size)
        if stop > at:
            rows.append(("s", at, left[at:stop].tolist(), right[at:stop].tolist()))
        at = stop
    return spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")


def test_feature_golden_values(spark):
    """First frame of the two-tone signal at mel bins 0, 7, 19, 31."""
    mel = features.mel_project(sine_chunks(spark, 1024 + 480, [700]))
    rows = features.onset_features(mel).orderBy("frame_idx").collect()
    assert len(rows) == 3
    planes = np.asarray(rows[0]["planes"])[:, [0, 7, 19, 31]]
    assert np.allclose(planes[0], [.000741839, .288344860, .000006318, .047825336], atol=2e-4)
    assert np.allclose(planes[1], [-85.568878, -23.147560, -100, -66.567322], atol=.1)
    assert np.allclose(planes[2], [.134225294, .075126775, .006172016, -1], atol=.01)
    assert np.allclose(planes[3], [.882825077, .900447547, .170635089, -.065334909], atol=.01)
    assert np.allclose(planes[4], [.380237043, .434964597, .085060395, .373530269], atol=.01)


def test_feature_golden_codes(spark):
    i = np.arange(12304)
    left, right = ((37 * i % 101) - 50) / 500.0, ((53 * i + 17) % 127 - 63) / 630.0
    rows = [("s", a, left[a:a + 5000].tolist(), right[a:a + 5000].tolist()) for a in range(0, 12304, 5000)]
    chunks = spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")
    out = {r["frame_idx"]: np.asarray(r["planes"]) for r in features.onset_features(features.mel_project(chunks, block_frames=16), block_frames=16).collect()}
    assert len(out) == 48 and out[0].shape == (5, 64)
    tolerance = np.array([2e-4, .1, .01, .01, .01])
    assert (np.abs(out[7][:, 20] - [.14697850, -58.829727, .55316836, -.31858733, -.02112121]) < tolerance).all()
    assert (np.abs(out[23][:, 5] - [.02839565, -69.228600, -1, .78359079, -.39952028]) < tolerance).all()


def test_streamed_features_equal_batch(spark, folder):
    chunks = sine_chunks(spark, 1024 + 6 * 240, [137, 509, 83, 911])
    want = features.onset_features(features.mel_project(chunks)).orderBy("frame_idx").collect()
    for r in chunks.select("first_sample").orderBy("first_sample").collect():
        chunks.filter(F.col("first_sample") == r[0]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = processors.stream_features(sinks.replay(spark, f"{folder}/in", chunks.schema))
    sinks.run_to_table(stream, f"{folder}/out", f"{folder}/ck")
    got = spark.read.schema(stream.schema).parquet(f"{folder}/out").orderBy("frame_idx").collect()
    assert len(got) == len(want) == 7
    for a, b in zip(got, want):
        assert np.allclose(np.asarray(a["planes"]), np.asarray(b["planes"]), atol=1e-6) and abs(a["activity"] - b["activity"]) < 1e-6


def test_windows_of_a_ramp(spark):
    rows = [("s", a, [float(x) for x in range(a, a + 5)], [float(1000 + x) for x in range(a, a + 5)]) for a in (100, 105)]
    chunks = spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")
    asks = spark.createDataFrame([("s", 1, 103, 4), ("s", 2, 107, 4), ("s", 3, 99, 2)], "session_id string, window_id int, window_start bigint, window_frames bigint")
    got = {r["window_id"]: r["left"] for r in features.extract_windows(chunks, asks, 3).collect()}
    assert got == {1: [103.0, 104.0, 105.0, 106.0], 2: None, 3: None}
    start, frames = spark.range(1).select(*features.window_by_time(F.lit(.010), F.lit(.002), F.lit(.002))).first()
    assert (start, frames) == (384, 192)


def test_activity_and_resampling(spark):
    quiet = [0.0] * 5000
    loud = [.2 if 1500 <= i < 2500 else 0.0 for i in range(5000)]
    clips = spark.createDataFrame([(1, loud, loud), (2, quiet, quiet)], "clip_id int, left array<double>, right array<double>")
    got = {r["clip_id"]: r for r in features.trim_silence(clips).collect()}
    assert got[1]["onset_offset"] == 960 and len(got[2]["left"]) == 5000 and got[2]["onset_offset"] == 0
    tone = [.5 * math.sin(2 * math.pi * 440 * i / 44100) for i in range(4410)]
    clip = spark.createDataFrame([(tone, tone, 44100)], "left array<double>, right array<double>, sample_rate int")
    out = features.resample_clips(clip).first()
    assert len(out["left"]) == 4800 and abs(max(out["left"]) - .5) < .01
    middle = [.5 * math.sin(2 * math.pi * 440 * i / 48000) for i in range(1000, 3800)]
    assert np.abs(np.asarray(out["left"][1000:3800]) - middle).max() < 1e-3


def test_wav_files(spark, folder):
    rows = [("b", 0, [0.0, .5, -1.0, 2.0], [.25, -.25, 0.0, -2.0]), ("b", 4, [.1], [.2]), ("a", 0, [1.0], [-1.0])]
    chunks = spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")
    assert recordings.write_recordings(chunks, f"{folder}/w", 8000).count() == 2
    with open(f"{folder}/w/bad.wav", "wb") as stream:
        stream.write(b"not a recording")
    with wave.open(f"{folder}/w/mono.wav", "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
        w.writeframes(bytes([128, 255, 0]))
    parts = recordings.write_recordings(chunks, f"{folder}/p", 8000, part_frames=3).collect()
    assert sorted((r["session_id"], r["frames"]) for r in parts) == [("a", 1), ("b", 3), ("b_part00001", 2)]
    got = {r["session_id"]: r for r in recordings.scan_recordings(spark, f"{folder}/w").collect()}
    assert got["bad"]["error"] and got["a"]["error"] is None and got["b"]["sample_rate"] == 8000
    assert np.allclose(got["b"]["left"], [0, np.rint(.5 * 32767) / 32768, -1, 32767 / 32768, np.rint(.1 * 32767) / 32768])
    assert got["mono"]["left"] == got["mono"]["right"] == [0.0, 127 / 128, -1.0]
    assets = {r["relative_path"]: r for r in recordings.scan_inventory_tree(spark, f"{folder}/w").collect()}
    assert assets["bad.wav"]["review_status"] == "invalid" and assets["a.wav"]["included"]


def test_long_recordings_come_back_as_one(spark, folder):
    rows = [("x", 3 * k, [(3 * k + i) / 64 for i in range(3)], [0.0] * 3) for k in range(7)] + [("x_part00001", 0, [.5], [.5])]
    chunks = spark.createDataFrame(rows, "session_id string, first_sample bigint, left array<double>, right array<double>")
    for part, chunk in ((8, 4), (4, 100), (5, 3)):
        path = f"{folder}/{part}"
        made = recordings.write_recordings(chunks.where("session_id = 'x'"), path, 8000, part_frames=part).collect()
        assert len(made) == -(-21 // part) and sum(r["frames"] for r in made) == 21
        back = recordings.scan_recordings(spark, path, chunk).orderBy("first_sample").collect()
        assert {r["session_id"] for r in back} == {"x"} and all(r["chunk_idx"] == r["first_sample"] // chunk for r in back)
        at = [r["first_sample"] + i for r in back for i in range(len(r["left"]))]
        assert at == list(range(21)) and np.allclose([v for r in back for v in r["left"]], np.arange(21) / 64, atol=1e-4)
    recordings.write_recordings(chunks.where("session_id <> 'x'"), f"{folder}/own", 8000).count()
    assert [r["session_id"] for r in recordings.scan_recordings(spark, f"{folder}/own").collect()] == ["x_part00001"]


def test_import_rescales_and_refuses(spark, folder):
    chunks = spark.createDataFrame([("x", 0, [0.0] * 9000, [0.0] * 9000)], "session_id string, first_sample bigint, left array<double>, right array<double>")
    schema = "class string, onset_sample bigint, end_sample bigint, source_hint string, reviewed boolean, uncertain boolean, scene_mode string"
    labels = spark.createDataFrame([("gunshot", 1000, 2000, "manual", True, None, None)], schema)
    meta = {"session_id": "r1", "split": "test"}
    base = tables.import_recording(chunks, labels, meta, folder, 44100)
    row = spark.read.json(f"{base}/timeline").first()
    assert (row["onset_sample"], row["source_hint"]) == (1088, "unknown")
    with pytest.raises(Exception):
        tables.import_recording(chunks, labels, meta, folder, 44100)
    bad = spark.createDataFrame([("gunshot", 8999, 99999, "self", True, None, None)], schema)
    with pytest.raises(ValueError):
        tables.import_recording(chunks, bad, {**meta, "session_id": "r2"}, folder, 48000)
    with pytest.raises(ValueError):
        tables.import_recording(chunks, labels.withColumn("reviewed", F.lit(False)), {**meta, "session_id": "r3"}, folder, 48000)


def test_timeline_lines_and_extras(spark, folder):
    with open(f"{folder}/s1.jsonl", "w") as stream:
        stream.write('{"class": "gunshot", "onset_sample": 5, "note": "x"}\n\n{broken\n')
    rows = tables.read_timeline(spark, f"{folder}/s1.jsonl").orderBy("line").collect()
    assert [(r["line"], r["malformed"]) for r in rows] == [(1, False), (3, True)]
    assert rows[0]["extras"] == {"note": "x"} and rows[0]["session_id"] == "s1"


def test_wilson_and_policy(spark):
    low, high = metrics.wilson_interval(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)
    text = '{"a": 0.5, "uncertainty_count": 2, "uncertainty_confidence_0": 0, "uncertainty_confidence_1": 0.5, "uncertainty_p90_degrees_0": 60, "uncertainty_p90_degrees_1": "1e"}'
    p = spark.range(1).select(tables.parse_policy(F.lit(text)).alias("p")).first()["p"]
    assert p["policy"]["a"] == .5 and p["uncertainty"][0]["p90"] == 60 and p["uncertainty"][1]["p90"] is None


def test_report_tables(spark, folder):
    out = tables.write_report({"a": spark.range(2)}, f"{folder}/r.json")
    assert out["a"] == [{"id": 0}, {"id": 1}]
    out = tables.write_report({"a": spark.range(30), "b": spark.range(3)}, f"{folder}/r.json", limit=10)
    assert out["a"] == {"parquet": "r.json.a", "rows": 30} and len(out["b"]) == 3
    assert spark.read.parquet(f"{folder}/r.json.a").count() == 30
    with open(f"{folder}/r.json") as stream:
        assert json.load(stream) == out
