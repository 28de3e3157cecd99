"""The ordered kernel against plain sequential code, with slices much smaller than the dense stretches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlake.operators import matching, quantiles, smoothing
from soundlake.operators.ordered import chain, edge_window, nearest_within, ordinal, running, sorted_index


def rows_for(seed, n=400, keys=3, span=2000, hot=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if hot and rng.random() < 0.6 else rng.randrange(keys)
        out.append((key, rng.randrange(span), i, rng.choice([0.1, 0.2, 0.3, 0.5, 0.5, 0.9]) if seed % 2 else rng.random()))
    return out


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def frame(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, sample bigint, event_id bigint, probability double").repartition(5)


@pytest.mark.parametrize("seed,reach,width", [(1, 40, 50), (2, 7, 10), (3, 200, 30), (4, 1, 64), (5, 90, 2000)])
def test_spacing_chain(spark, seed, reach, width):
    rows, want = rows_for(seed), set()
    for group in by_key(rows).values():
        kept = []
        for row in group:
            if kept and row[1] - kept[-1][1] < reach:
                if row[3] > kept[-1][3]:
                    kept[-1] = row
            else:
                kept.append(row)
        want |= {r[2] for r in kept}
    got = chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], width, reach, score="probability", part_rows=width, fan=3)
    ids = [r["event_id"] for r in got.select("event_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_spacing_chain_of_a_regular_signal(spark):
    """Equal scores every 6 positions under spacing 10: parity never settles, so slices must be linked."""
    rows = [(0, 6 * i, i, 0.5) for i in range(500)]
    got = chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], 25, 10, score="probability", part_rows=9, fan=2)
    assert sorted(r["event_id"] for r in got.collect()) == list(range(0, 500, 2))


@pytest.mark.parametrize("seed,reach,width", [(1, 40, 50), (2, 7, 10), (3, 200, 250), (4, 30, 33)])
def test_span_chain(spark, seed, reach, width):
    rows, want = rows_for(seed), {}
    for group in by_key(rows).values():
        anchor = None
        for row in group:
            if anchor is None or row[1] - anchor > reach:
                anchor = row[1]
            want[row[2]] = anchor
    got = chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], width, reach, part_rows=width, fan=3)
    assert {r["event_id"]: r["_anchor"] for r in got.collect()} == want


def spaced(rows, reach):
    kept = []
    for row in rows:
        if kept and row[1] - kept[-1][1] < reach:
            if row[3] > kept[-1][3]:
                kept[-1] = row
        else:
            kept.append(row)
    return {r[2] for r in kept}


@pytest.mark.parametrize("kind", ["rising", "falling", "equal", "random"])
def test_one_dense_key(spark, kind):
    """200,000 rows of one key within one former slice: linear work, tasks of a bounded number of rows."""
    n = 200_000
    rng = np.random.default_rng(1)
    scores = {"rising": np.arange(n) / n, "falling": 1 - np.arange(n) / n, "equal": np.full(n, .5), "random": rng.random(n)}[kind]
    rows = [(0, i // 4, i, float(scores[i])) for i in range(n)]
    got = chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], 10**9, 700, score="probability", part_rows=20_000)
    assert {r["event_id"] for r in got.select("event_id").collect()} == spaced(rows, 700)
    spans = {r["event_id"]: r["_anchor"] for r in chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], 10**9, 700, part_rows=20_000).collect()} if kind == "equal" else {}
    assert all(a == i // 4 // 701 * 701 for i, a in spans.items())


def test_stretches_shorter_than_the_reach(spark):
    """Held rows pass through whole partitions and whole groups of them, and are dropped from far away."""
    rng = random.Random(8)
    rows = [(i % 2, i // 2, i, rng.choice([.1, .2, .3, .9])) for i in range(400)]
    for reach in (60, 500):
        got = chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], 1, reach, score="probability", part_rows=10, fan=2)
        want = set().union(*(spaced(group, reach) for group in by_key(rows).values()))
        assert {r["event_id"] for r in got.collect()} == want
        anchors = {r["event_id"]: r["_anchor"] for r in chain(frame(spark, rows), ["session_id"], "sample", ["event_id"], 1, reach, part_rows=10, fan=2).collect()}
        assert anchors == {i: (i // 2) // (reach + 1) * (reach + 1) for i in range(400)}


def test_empty_and_single(spark):
    empty = frame(spark, [(0, 0, 0, 0.0)]).filter("false")
    assert chain(empty, ["session_id"], "sample", ["event_id"], 10, 5, score="probability").count() == 0
    one = frame(spark, [(1, 5, 9, 0.3)])
    assert [r["event_id"] for r in chain(one, ["session_id"], "sample", ["event_id"], 10, 5, score="probability").collect()] == [9]


def test_ordinal_running_and_edges(spark):
    rows = rows_for(7)
    df = frame(spark, rows)
    numbers = {r["event_id"]: r["i"] for r in ordinal(df, ["session_id"], "sample", ["event_id"], 13, "i").collect()}
    sums = {r["event_id"]: (r["s"], r["m"]) for r in running(df, ["session_id"], "sample", ["event_id"], 13, {
        "s": ("sum", "event_id"), "m": ("max", "probability")}).collect()}
    lags = {r["event_id"]: (r["back"], r["front"]) for r in edge_window(df, ["session_id"], "sample", ["event_id"], 13, 2, lambda w: {
        "back": F.lag("event_id", 2).over(w), "front": F.lead("event_id").over(w)}).collect()}
    for group in by_key(rows).values():
        ids = [r[2] for r in group]
        for i, row in enumerate(group):
            assert numbers[row[2]] == i
            assert sums[row[2]] == (sum(ids[:i + 1]), max(r[3] for r in group[:i + 1]))
            assert lags[row[2]] == (ids[i - 2] if i >= 2 else None, ids[i + 1] if i + 1 < len(ids) else None)


def test_sorted_index(spark):
    rows = rows_for(11)
    got = {r["event_id"]: r["n"] for r in sorted_index(frame(spark, rows), ["sample", "event_id"], "n").collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_nearest_within(spark):
    rows, marks = rows_for(8, 200), rows_for(9, 60)
    got = nearest_within(frame(spark, rows), frame(spark, marks).select("session_id", "sample"), ["session_id"], "sample", 15, 40)
    for r in got.collect():
        below = [m[1] for m in marks if m[0] == r["session_id"] and m[1] <= r["sample"] and r["sample"] - m[1] <= 15]
        above = [m[1] for m in marks if m[0] == r["session_id"] and m[1] >= r["sample"] and m[1] - r["sample"] <= 15]
        assert (r["near_prev"]["pos"] if r["near_prev"] else None) == max(below, default=None)
        assert (r["near_next"]["pos"] if r["near_next"] else None) == min(above, default=None)


@pytest.mark.parametrize("seed,tol,span", [(1, 10, 400), (2, 60, 500), (3, 5, 30), (4, 100, 5000)])
def test_greedy_matching(spark, seed, tol, span):
    """Dense, tied and repeated positions with one hot key, against sorting all pairs."""
    rng = random.Random(seed)
    def side(n):
        return [(0 if rng.random() < 0.5 else rng.randrange(3), rng.randrange(span) if rng.random() < 0.7 else span // 2, i) for i in range(n)]
    truth, pred = side(90), side(80)
    pairs, used_t, used_p = set(), set(), set()
    for _, t, p in sorted((abs(a[1] - b[1]), a[2], b[2]) for a in truth for b in pred if a[0] == b[0] and abs(a[1] - b[1]) <= tol):
        if t not in used_t and p not in used_p:
            used_t.add(t), used_p.add(p), pairs.add((t, p))
    left = spark.createDataFrame(truth, "session_id bigint, onset_sample bigint, truth_id bigint").withColumn("class", F.lit("a"))
    right = spark.createDataFrame(pred, "session_id bigint, onset_sample bigint, pred_id bigint").withColumn("class", F.lit("a"))
    got = matching.match_events(left, right, tol, width=2 * tol)
    assert {(r["truth_id"], r["pred_id"]) for r in got.collect()} == pairs


def test_matching_without_candidates(spark):
    left = spark.createDataFrame([(0, "a", 0, 1)], "session_id bigint, class string, onset_sample bigint, truth_id bigint")
    right = spark.createDataFrame([(0, "a", 11, 1)], "session_id bigint, class string, onset_sample bigint, pred_id bigint")
    assert matching.match_events(left, right, 10).count() == 0
    assert matching.match_events(left, right, 11).count() == 1


def test_smoothing_is_slice_invariant(spark):
    rows = [(k, i, float((i * 37 + k) % 101)) for k in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id bigint, idx bigint, x double")
    vector = df.withColumn("v", F.array("x", F.col("x") * 2))
    for width in (7, 64, 1000):
        got = smoothing.exponential_smooth(df, ["session_id"], "idx", [], width, "x", 0.025, "y").collect()
        vec = {(r["session_id"], r["idx"]): r["y"] for r in smoothing.exponential_smooth(
            vector, ["session_id"], "idx", [], width, "v", 0.025, "y").collect()}
        for key in range(2):
            state = None
            for r in sorted((r for r in got if r["session_id"] == key), key=lambda r: r["idx"]):
                state = r["x"] if state is None else 0.975 * state + 0.025 * r["x"]
                assert abs(r["y"] - state) < 1e-9 and abs(vec[key, r["idx"]][1] - 2 * state) < 1e-9


def test_quantiles_and_top_k(spark):
    rng = np.random.default_rng(3)
    values = [(int(k), float(x)) for k, x in zip(rng.integers(0, 2, 501), rng.normal(size=501))] + [(0, 0.25)] * 300
    df = spark.createDataFrame(values, "g int, x double")
    for r in quantiles.exact_quantile(df, "x", {"a": 0.5, "b": 0.9, "c": 1.0}, 0.1, by=["g"]).collect():
        mine = [x for g, x in values if g == r["g"]]
        assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(mine, [50, 90, 100]))
    assert quantiles.exact_quantile(df.filter("false"), "x", {"a": 0.5}, 0.1).first()["a"] is None
    ranked = quantiles.top_k(df.withColumn("i", F.monotonically_increasing_id()), ["g"], [F.col("x").desc(), F.col("i")], 5, ["i"])
    for g in (0, 1):
        assert sorted(r["x"] for r in ranked.filter(F.col("g") == g).collect()) == sorted(x for k, x in values if k == g)[-5:]


def plain_greedy(truth, pred, tol):
    pairs = sorted((abs(a[1] - b[1]), a[2], b[2]) for a in truth for b in pred if a[0] == b[0] and abs(a[1] - b[1]) <= tol)
    used, taken = (set(), set()), set()
    for _, t, p in pairs:
        if t not in used[0] and p not in used[1]:
            used[0].add(t), used[1].add(p), taken.add((t, p))
    return taken


def matched(spark, truth, pred, tol, **how):
    sides = [spark.createDataFrame(rows, f"session_id bigint, onset_sample bigint, {name} bigint").repartition(4) for rows, name in ((truth, "truth_id"), (pred, "pred_id"))]
    got = matching.match_events(*sides, tol, keys=["session_id"], **how).collect()
    assert all(r["distance"] <= tol for r in got)
    pairs = [(r["truth_id"], r["pred_id"]) for r in got]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_periodic_labels_need_few_rounds(spark, monkeypatch):
    """Each detection is as near to the next label as to its own, so every choice hangs on the one before."""
    rounds = []
    inner = matching._slice_round
    monkeypatch.setattr(matching, "_slice_round", lambda *a: rounds.append(a) or inner(*a))
    monkeypatch.setattr(matching, "_mutual_round", None)
    truth = [(0, 10 * i, i) for i in range(10_000)]
    pred = [(0, 10 * i - 5, i) for i in range(10_000)]
    assert matched(spark, truth, pred, 8) == plain_greedy_sorted(truth, pred)
    assert len(rounds) <= 6


def plain_greedy_sorted(truth, pred):
    """All candidate distances are 5: label by label, the lowest free detection of the two."""
    free, out = {p[1]: p[2] for p in pred}, set()
    for _, at, t in truth:
        options = [x for x in (at - 5, at + 5) if x in free]
        if options:
            out.add((t, free.pop(min(options, key=free.get))))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 3])
@pytest.mark.parametrize("seed,span,tol", [(1, 3000, 12), (2, 900, 40), (3, 200, 7), (4, 60, 25)])
def test_matching_over_slice_edges(spark, seed, span, tol, limit):
    rng = random.Random(seed)
    truth, pred = ([(rng.randrange(2) * rng.randrange(2), rng.randrange(span), i) for i in rng.sample(range(1000), 220)] for _ in range(2))
    assert matched(spark, truth, pred, tol, width=max(1, tol // 2), slice_rows=limit) == plain_greedy(truth, pred, tol)


def test_matching_many_rows_at_one_place(spark):
    truth = [(0, 100, i) for i in range(20_000)]
    pred = [(0, 100 + i % 2, i) for i in range(20_000)]
    got = matched(spark, truth, pred, 4)
    near, far = [p[2] for p in pred if p[1] == 100], [p[2] for p in pred if p[1] == 101]
    assert got == set(zip(range(20_000), near + far))
