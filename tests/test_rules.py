"""Rules of single operators on tiny inputs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlake.operators import calibration, corpus, direction, features, smoothing, tensors
from soundlake.sources import tables


def test_copies_point_to_the_first_path(spark):
    rows = spark.createDataFrame([("a", "b.wav", "h"), ("a", "a.wav", "h"), ("c", "c.wav", None), ("d", "d.wav", ""), ("e", "e.wav", "")],
                                 "asset_id string, relative_path string, sha256 string")
    got = {r.relative_path: r.duplicate_of for r in corpus.content_duplicates(rows).collect()}
    assert got == {"a.wav": "", "b.wav": "a.wav", "c.wav": "", "d.wav": "", "e.wav": ""}


def test_summary_counts_every_asset(spark):
    rows = spark.createDataFrame([("gunshot", True, "", "accepted"), ("gunshot", True, "a.wav", "accepted")],
                                 "label string, included boolean, duplicate_of string, review_status string")
    assert corpus.manifest_summary(rows, ("gunshot",)).first().count_gunshot == 2


def test_uncertain_and_foreign_events_label_nothing(spark):
    rows = spark.createDataFrame([("s", "a", 1024, "self", True, 1), ("s", "b", 1024, "self", False, 2), ("s", "a", 5000, "elsewhere", False, 3)],
                                 "session_id string, class string, onset_sample long, source_hint string, uncertain boolean, event_id long")
    lengths = spark.createDataFrame([("s", 100)], "session_id string, frame_count long")
    got = features.onset_targets(rows, lengths, classes=("a",)).collect()
    assert len(got) == 3 and {(r["class"], r.source_hint) for r in got} == {("a", "unknown")}


def test_class_without_pairs_gets_the_default_offset(spark):
    pairs = spark.createDataFrame([("a", 110, 100)], "class string, pred_pos long, truth_pos long")
    got = {r["class"]: r.onset_offset for r in calibration.calibrate_onset_offset(pairs, classes=("a", "b")).collect()}
    assert got == {"a": 10, "b": 512}


def test_policy_table_is_read_whole(spark):
    def levels(count, there):
        text = {"uncertainty_count": count} | {f"uncertainty_{k}_{i}": i for i in range(there) for k in ("confidence", "p90_degrees")}
        return spark.range(1).select(tables.parse_policy(F.lit(json.dumps(text))).alias("p")).first().p.uncertainty
    assert [(r.confidence, r.p90) for r in levels(100, 100)] == [(i, i) for i in range(100)]
    short = levels(1_000_000_000, 3)
    assert len(short) < 10 and short[3].confidence is None


def test_many_policies_share_files(spark, folder):
    """Files do not grow with the policies; one of several lines is still one policy."""
    text = F.when(F.col("id") == 7, F.lit('{"cutoff": 0.5,\r\n"policy_id": 7}')).otherwise(F.format_string('{"policy_id": %d, "cutoff": 0.25}', "id"))
    tables.write_policies(spark.range(0, 500, 1, 3).select(text.alias("t")), "t", f"{folder}/p")
    assert len([f for f in os.listdir(f"{folder}/p") if f.startswith("part-")]) == 3
    got = {int(r.policy["policy_id"]): r.policy["cutoff"] for r in tables.read_policy(spark, f"{folder}/p", lines=True).collect()}
    assert got == {i: .5 if i == 7 else .25 for i in range(500)}


def test_many_sessions_share_metadata_files(spark, folder):
    tables.write_session_metadata(spark.range(0, 300, 1, 2).selectExpr("CAST(id AS STRING) AS session_id", "'m' || id AS map"), f"{folder}/m")
    assert len([f for f in os.listdir(f"{folder}/m") if f.startswith("part-")]) == 2
    assert {(r.session_id, r.map) for r in tables.read_session_metadata(spark, f"{folder}/m", lines=True).collect()} == {(str(i), f"m{i}") for i in range(300)}


def test_sessions_share_files(spark, folder):
    rows = spark.range(600).selectExpr("id % 200 AS session_id", "id AS sample")
    for fmt in ("parquet", "json"):
        tables.write_by_session(rows, f"{folder}/{fmt}", fmt)
        assert len([f for f in os.listdir(f"{folder}/{fmt}") if f.startswith("part-")]) <= 4
        back = spark.read.schema("session_id bigint, sample bigint").format(fmt).load(f"{folder}/{fmt}")
        assert sorted((r.session_id, r.sample) for r in back.collect()) == sorted((i % 200, i) for i in range(600))


def test_timelines_share_files(spark, folder):
    """Files grow with the lines, not with the sessions; the line says whose it is."""
    rows = spark.range(0, 400, 1, 4).selectExpr("id DIV 2 AS session_id", "'gunshot' AS class", "id AS onset_sample", "id + 5 AS end_sample", "id AS turn")
    tables.write_timeline(rows, f"{folder}/t", sessions=spark.range(210).select(F.col("id").alias("session_id")))
    assert len([f for f in os.listdir(f"{folder}/t/group=0") if f.startswith("part-")]) <= 8
    back = tables.read_timeline(spark, f"{folder}/t/*/*.json").collect()
    assert {(r.session_id, r.onset_sample, r.extras["turn"]) for r in back} == {(str(i // 2), i, str(i)) for i in range(400)} and len(back) == 400
    assert sorted(int(r.session_id) for r in tables.timeline_sessions(spark, f"{folder}/t").collect()) == list(range(210))
    with open(f"{folder}/own.jsonl", "w") as stream:  # a line of a file by name keeps its keys
        stream.write('{"class": "gunshot", "onset_sample": 5, "session_id": "z"}')
    row = tables.read_timeline(spark, f"{folder}/own.jsonl").first()
    assert row.session_id == "own" and row.extras == {"session_id": "z"}


def test_bulk_import_takes_all_or_none(spark, folder):
    chunks = spark.createDataFrame([(x, 0, [0.0] * 9000, [0.0] * 9000) for x in ("r1", "r2")], "session_id string, first_sample bigint, left array<double>, right array<double>")
    shape = "session_id string, class string, onset_sample bigint, end_sample bigint, source_hint string, reviewed boolean, uncertain boolean, scene_mode string"
    good = [("r1", "gunshot", 1000, 2000, "manual", True, None, None), ("r2", "gunshot", 1000, None, "self", True, None, None)]
    meta = spark.createDataFrame([("r1", "test", 44_100, "m1"), ("r2", "train", 48_000, "m2")], "session_id string, split string, label_rate bigint, map string")

    def bring(labels, about=meta, sound=chunks):
        return tables.import_sessions(sound, spark.createDataFrame(labels, shape), about, folder).collect()
    for labels, about, sound, reason in (
            (good + [("r2", "gunshot", 8999, 99_999, "self", True, None, None)], meta, chunks, "bounds"), (good + [("r3", "gunshot", 1, 2, "self", True, None, None)], meta, chunks, "r3|bounds|session"),
            ([good[0], (*good[1][:5], False, None, None)], meta, chunks, "not reviewed"), (good, meta.unionByName(meta), chunks, "described twice"),
            (good, meta, chunks.where("session_id = 'r1'"), "without audio"), (good, meta.withColumn("split", F.lit("other")), chunks, "split")):
        with pytest.raises(ValueError, match=reason):
            bring(labels, about, sound)
    assert tables.imported_sessions(spark, folder).collect() == []
    made = {r.session_id: r for r in bring(good)}
    assert made["r1"].name == "test_real_r1" and made["r2"].name == "train_real_r2"
    rows = {r.name: r for r in spark.read.json(f"{folder}/batches/{made['r1'].batch}/timeline").collect()}
    assert (rows["test_real_r1"].onset_sample, rows["test_real_r1"].end_sample, rows["test_real_r1"].source_hint) == (1088, 2177, "unknown")
    assert (rows["train_real_r2"].onset_sample, rows["train_real_r2"].end_sample) == (1000, 3400)
    with pytest.raises(ValueError, match="already imported"):
        bring(good)
    assert tables.imported_sessions(spark, folder).count() == 2


def test_window_tensors_equal_slices(spark):
    rng = np.random.default_rng(1)
    lengths = {("a", 0.0): 70, ("a", 6.0): 70, ("b", 0.0): 3}
    data = {key: rng.normal(size=(n, 2, 3)).astype(np.float32) for key, n in lengths.items()}
    frames = spark.createDataFrame([(*key, i, x[i].tolist()) for key, x in data.items() for i in range(len(x)) if (key[1], i) != (6.0, 40)],
                                   "session_id string, gain_db double, frame_idx bigint, planes array<array<double>>").repartition(5)
    ends = spark.createDataFrame([("a", e, float(e)) for e in (1, 5, 16, 17, 41, 45, 70, 71)] + [("b", 3, 1.0)], "session_id string, window_end bigint, label double")
    got = tensors.training_tensors(frames, ends, (0.0, 6.0), shape=(2, 3), context=10, pad=(0.0, -100.0), block=16).collect()
    assert len(got) == 18
    for r in got:
        x = data.get((r.session_id, r.gain_db))
        if x is None or r.window_end > len(x) or (r.gain_db, r.window_end) == (6.0, 41):
            assert r.tensor is None
            continue
        want = np.zeros((10, 2, 3), np.float32)
        want[:, 1] = -100
        take = min(10, r.window_end)
        want[-take:] = x[r.window_end - take:r.window_end]
        if r.gain_db == 6.0 and 41 < r.window_end <= 50:
            want[40 - r.window_end] = [[0] * 3, [-100] * 3]
        assert np.array_equal(np.float32(r.tensor).reshape(2, 10, 3), want.transpose(1, 0, 2))
        assert r.label == (1.0 if r.session_id == "b" else r.window_end)


def test_windows_reduced_in_the_task_equal_their_tensors(spark):
    """Short streams one after the other in one buffer; numbers per window instead of tensors."""
    frames = spark.range(60).selectExpr("id DIV 12 AS session_id", "id % 12 AS frame_idx", "array(array(CAST(id AS DOUBLE), 1D), array(2D, CAST(-id AS DOUBLE))) AS planes").coalesce(1)
    ends = spark.range(65).selectExpr("id DIV 13 AS session_id", "id % 13 + 1 AS window_end")
    how = dict(shape=(2, 2), context=5, pad=(0.0, -100.0), block=8)
    whole = {(r.session_id, r.window_end): r.tensor for r in tensors.window_tensors(frames, ends, "planes", **how).collect()}
    short = tensors.window_tensors(frames, ends, "planes", reduce=lambda x: x.sum(axis=(2, 3), dtype=float), **how).collect()
    assert len(short) == 65
    for r in short:
        tensor = whole[r.session_id, r.window_end]
        assert r.tensor == (None if tensor is None else np.reshape(tensor, (2, 10)).sum(axis=1).tolist())


def test_smoothing_by_blocks_equals_the_recursion():
    rng = np.random.default_rng(2)
    for shape, keep in (((1000,), .97), ((63,), .2), ((130, 3), np.array([.9, .9, .1])), ((1,), .5)):
        x, state, want = rng.normal(size=shape), np.zeros(shape[1:]) + .3, []
        for row in x:
            state = row * (1 - keep) + keep * state
            want.append(state)
        assert np.abs(smoothing._advance(x, np.zeros(shape[1:]) + .3, keep) - np.array(want)).max() < 1e-12


def test_sessions_of_label_files_without_labels(spark, folder):
    labels = spark.createDataFrame([("a", "gunshot", 5, 9)], "session_id string, class string, onset_sample bigint, end_sample bigint")
    tables.write_timeline(labels, f"{folder}/t", sessions=spark.createDataFrame([("a",), ("b",)], "session_id string"))
    assert sorted(r.session_id for r in tables.timeline_sessions(spark, f"{folder}/t").collect()) == ["a", "b"]
    assert [r.onset_sample for r in tables.read_timeline(spark, f"{folder}/t/*/*").collect()] == [5]
    open(f"{folder}/c.jsonl", "w").close()
    assert "c" in {r.session_id for r in tables.timeline_sessions(spark, folder).collect()}


def swept_by_rule(trace, truth, grid, cutoff, look, spacing, tol):
    """Counts per class and entry, each entry by itself and row by row."""
    out = {}
    for name, entry, quiet, busy in grid:
        tp = predicted = alarms = 0
        for session in {r[0] for r in trace}:
            rows = sorted((r[2], r[5], r[3], r[4]) for r in trace if r[:2] == (session, name))
            kept = []
            for i, (at, ident, p, activity) in enumerate(rows):
                around, before = [r[2] for r in rows[max(0, i - look):i + look + 1]], [r[2] for r in rows[max(0, i - look):i]]
                if p < max(around) or before and p <= max(before) or p < (quiet if activity < cutoff else busy):
                    continue
                if kept and at - kept[-1][0] < spacing:
                    if p > kept[-1][2]:
                        kept[-1] = (at, ident, p)
                else:
                    kept.append((at, ident, p))
            labels = [(r[2], r[3]) for r in truth if r[:2] == (session, name)]
            near = sorted((abs(a - b), t, i) for a, t in labels for b, i, _ in kept if abs(a - b) <= tol)
            left, right = set(), set()
            for _, t, i in near:
                if t not in left and i not in right:
                    left.add(t), right.add(i)
            tp, predicted = tp + len(left), predicted + len(kept)
            alarms += len(kept) if all(r[0] != session for r in truth) else 0
        out[name, entry] = (tp, predicted - tp, sum(r[1] == name for r in truth) - tp, alarms)
    return out


@pytest.mark.parametrize("step", [1, 40])
def test_sweep_counts_each_entry_as_if_alone(spark, step):
    draw = np.random.default_rng(step)
    trace, truth = [], []
    for session in ("r1", "r2", "quiet"):
        for name in ("a", "b"):
            for at in np.cumsum(draw.integers(1, 2 * step + 1, 120)).tolist():
                trace.append((session, name, at, round(float(draw.random()), 2), float(draw.random()), len(trace)))
                if session != "quiet" and draw.random() < .2:
                    truth.append((session, name, at + int(draw.integers(-9, 10)), len(truth)))
    grid = calibration.threshold_pairs([.1, .3, .5, .6, .7, .8, .9, .99], ("b",), ("a", "b", "absent"))
    frames = (spark.createDataFrame(trace, "session_id string, class string, sample long, probability double, activity double, event_id long"),
              spark.createDataFrame(truth, "session_id string, class string, onset_sample long, truth_id long"))
    table = spark.createDataFrame(grid, "class string, ord int, quiet double, busy double")
    got = calibration.sweep_counts(*frames, table, cutoff=.5, lookahead=2, spacing=12, tol=8, width=500, minutes_per_unit=1.).collect()
    assert {(r["class"], r.ord): (r.tp, r.fp, r.fn, r.ambient_fp) for r in got} == swept_by_rule(trace, truth, grid, .5, 2, 12, 8)


def test_sweep_copies_a_label_per_candidate_set(spark):
    grid = calibration.threshold_pairs([i / 20 for i in range(1, 19)], ("a",), ("a",))
    levels = calibration.sweep_levels(spark.createDataFrame(grid, "class string, ord int, quiet double, busy double"))
    rows = [("s", "a", 1000, 4, True), ("s", "a", 1005, None, None), ("s", "a", 5000, None, None), ("s", "a", 9000, 3, True), ("s", "a", 9003, 7, False), ("s", "a", 9004, None, None)]
    got = calibration.sweep_variants(spark.createDataFrame(rows, "session_id string, class string, sample long, level int, quiet boolean"), levels, 100, 10_000)
    copies = {r.sample: r["count"] for r in got.filter("level is null").groupBy("sample").count().collect()}
    assert len(grid) == 171 and copies == {1005: 1, 9004: 3}     # one candidate; either, both; none within reach


def test_weighted_scene_loss(spark):
    zero = [[[0.0] * 3] * 3]
    rows = spark.createDataFrame([(zero, zero, 3.0), ([[[1.0, 0.0, 0.0]] * 3], zero, 1.0)], "p array<array<array<double>>>, t array<array<array<double>>>, w double")

    def loss(df, weight=None):
        return direction.mean_adpit_loss(df, "p", "t", 1, weight).first().loss
    assert loss(rows) == pytest.approx(1 / 6) and loss(rows, F.col("w")) == pytest.approx(1 / 12)
    assert loss(rows, F.lit(0)) == 0 and loss(rows.limit(0)) == 0
