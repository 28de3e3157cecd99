"""Live operators with typed state: any cut into micro-batches, policies, generations, idle streams, late events."""

import random

import pytest
from pyspark.sql import functions as F

from soundlake.session import scratch_path
from soundlake.streaming import processors, recogniser, sinks

TRACE = "session_id string, class string, sample bigint, event_id bigint, probability double, activity double, source_probs array<double>, stream_generation bigint"
RULES = dict(quiet=.3, busy=.6, cutoff=.5, spacing=40, lookahead=2, onset_offset=5, pulse=20, self_threshold=.7)


def run(spark, stream):
    recogniser.use_typed_state(spark)
    out = scratch_path(spark, "stream")
    sinks.run_to_table(stream, out, scratch_path(spark, "offsets"))
    return spark.read.schema(stream.schema).parquet(out)


def live(spark, rows, ends, policies=(), files=3, **how):
    rows = spark.createDataFrame(rows, TRACE)
    changes = spark.createDataFrame(list(policies), "session_id string, class string, since bigint, quiet double, busy double, spacing bigint")
    both = recogniser.with_controls(rows, changes)
    if ends:
        last = rows.groupBy("session_id", "class").agg((F.max("sample") + 1).alias("sample")).withColumn("kind", F.lit("end")).withColumn("event_id", F.lit(1 << 60))
        both = both.unionByName(last.select(*[F.col(c.name) if c.name in last.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in both.schema]))
    path = scratch_path(spark, "in")
    sinks.deal_by_time(both, path, "sample", ["session_id", "class"], pieces=files, salts=2)
    return run(spark, recogniser.recognise(sinks.replay(spark, path, both.schema, 2), **RULES, **how))


def plain(rows, policies=(), flush=True):
    """One key, row by row."""
    rules, events = dict(RULES), []
    changes = sorted(policies, key=lambda p: p[2])
    trace, pending, at, generation = [], None, 0, None

    def emit():
        nonlocal pending
        if pending is not None:
            sample, ident, p, detected, hint, scene, suppressed = pending
            events.append((ident, sample, max(0, sample - rules["onset_offset"]), detected, p, hint, scene, suppressed, generation))
        pending = None

    def judge(i, right):
        nonlocal pending
        sample, ident, p, activity, source = trace[i]
        left = max(0, i - 2)
        earlier = [r[2] for r in trace[left:i]]
        if p >= rules["quiet" if activity < .5 else "busy"] and p >= max(r[2] for r in trace[left:right + 1]) and (not earlier or p > max(earlier)):
            suppressed = source[0] >= .7
            new = (sample, ident, p, trace[right][0], "self" if suppressed else ("self", "remote", "unknown")[source.index(max(source))], "quiet" if activity < .5 else "busy", suppressed)
            if pending is not None and sample - pending[0] < rules["spacing"]:
                pending = new if p > pending[2] else pending
            else:
                emit()
                pending = new
        if pending is not None and sample - pending[0] >= rules["spacing"]:
            emit()
    for _, _, sample, ident, p, activity, source, g in rows:
        while changes and changes[0][2] < sample:
            _, _, _, quiet, busy, spacing = changes.pop(0)
            rules.update({k: x for k, x in (("quiet", quiet), ("busy", busy), ("spacing", spacing)) if x is not None})
        if g != generation:
            trace, pending, at, generation = [], None, 0, g
        trace.append((sample, ident, p, activity, source))
        while at + 2 < len(trace):
            judge(at, at + 2)
            at += 1
    if flush:
        while at < len(trace):
            judge(at, min(len(trace) - 1, at + 2))
            at += 1
        emit()
    return sorted(events)


def trace_rows(seed, generations=1):
    rng = random.Random(seed)
    out = []
    for i in range(160):
        a = rng.random()
        out.append(("s", "a", 7 * i, i, rng.random(), rng.random(), [a, (1 - a) * .6, (1 - a) * .4], i * generations // 160))
    return out


def found(df):
    return sorted((r.event_id, r.sample, r.onset_sample, r.detected_sample, r.confidence, r.source_hint, r.scene_mode, r.suppressed, r.stream_generation) for r in df.collect())


@pytest.mark.parametrize("files,generations", [(1, 1), (5, 1), (4, 3)])
def test_events_under_changing_policies(spark, files, generations):
    rows = trace_rows(files, generations)
    policies = [("s", "a", 300, .8, None, 15), ("s", "a", 700, .1, .2, None)]
    assert found(live(spark, rows, True, policies, files)) == plain(rows, policies)


def test_idle_streams_are_delivered_and_forgotten(spark):
    """No end row: a timer flushes the stream, and its state is gone."""
    rows = trace_rows(9)
    recogniser.use_typed_state(spark)
    path = scratch_path(spark, "in")
    both = recogniser.with_controls(spark.createDataFrame(rows, TRACE), spark.createDataFrame([], "session_id string, class string, since bigint"))
    sinks.deal_by_time(both, path, "sample", ["session_id"], pieces=2, salts=1)
    name = "idle_events"
    stream = recogniser.recognise(sinks.replay(spark, path, both.schema, 4), **RULES, idle_ms=1)
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):  # timers make batches of their own, so the query is never out of work
            if query.awaitTermination(1) or spark.table(name).count() == len(plain(rows)):
                break
        assert found(spark.table(name)) == plain(rows)
    finally:
        query.stop()


def test_late_events_and_new_generations_make_scenes(spark, folder):
    """Arrival order: a late event joins its pending scene; another generation drops what is pending."""
    columns = "session_id string, onset_sample bigint, event_id bigint, stream_generation int, kind string, arrival bigint"
    arrivals = [("event", 100, 1, 0), ("event", 900, 2, 0), ("event", 150, 3, 0), ("clock", 700, 0, 0), ("event", 5000, 4, 0), ("event", 40, 5, 1), ("clock", 9000, 0, 1)]
    rows = spark.createDataFrame([("s", onset, ident, g, kind, i) for i, (kind, onset, ident, g) in enumerate(arrivals)], columns)
    sinks.deal_by_time(rows, f"{folder}/in", "arrival", ["session_id"], pieces=4, salts=1)
    out = run(spark, processors.stream_scenes(sinks.replay(spark, f"{folder}/in", rows.schema), join=200, pre_anchor=50, length=400))
    assert sorted((r.stream_generation, r.anchor_sample, r.event_id) for r in out.collect()) == [(0, 100, 1), (0, 100, 3), (1, 40, 5)]


def test_live_state_is_cleared_by_a_new_generation(spark):
    schema = "session_id string, stream_generation bigint, sample bigint, event_id bigint, probability double"
    rows = [("a", 0, 10, 1, .5), ("a", 0, 20, 2, .6), ("b", 0, 15, 3, .7), ("a", 1, 5, 4, None), ("b", 0, 12, 5, .9)]
    path = scratch_path(spark, "in")
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).withColumn("k", F.lit(k)).write.mode("append").parquet(path)
    stream = sinks.replay(spark, path, spark.createDataFrame([], schema).schema, 1)
    got = {r.session_id: (r.stream_generation, r.event_id, r.probability) for r in recogniser.run_live_state(stream, ["session_id"], ["sample", "event_id"], ["probability"]).collect()}
    assert got == {"a": (1, 4, None), "b": (0, 3, .7)}


def test_many_streams_share_a_group(spark):
    """Groups, and so calls of the state store, do not grow with the streams; keys of any type and null come back; a stream that ended is forgotten."""
    recogniser.use_typed_state(spark)
    rows = [row for k in range(30) for row in ((None if k == 0 else f"s{k}", *r[1:2], r[2], 1000 * k + r[3], *r[4:]) for r in trace_rows(k)[:40])]
    stream = live(spark, rows, True, [("s3", "a", 100, .9, .9, None)], files=4, buckets=2)
    got = {}
    for r in stream.collect():
        got.setdefault(r.session_id, []).append((r.event_id, r.sample, r.onset_sample, r.detected_sample, r.confidence, r.source_hint, r.scene_mode, r.suppressed, r.stream_generation))
    for k in range(30):
        name = None if k == 0 else f"s{k}"
        assert sorted(got.get(name, [])) == plain([r for r in rows if r[0] == name], [("s3", "a", 100, .9, .9, None)] if k == 3 else [])


def test_stateful_groups_are_buckets(spark):
    """500 keys meet the processor in at most 256 groups; a key's state goes on over micro-batches."""
    blocks = spark.range(1500).selectExpr("id % 500 AS session_id", "(id DIV 500) * 10 AS first_sample", "10L AS frames", "'x' AS endpoint", "0L AS lost", "0L AS available")
    path = scratch_path(spark, "in")
    most = sinks.deal_by_time(blocks, path, "first_sample", ["session_id"], pieces=3, salts=1)
    stream = recogniser.stream_losses(sinks.replay(spark, path, blocks.schema, most), 5, 1)
    got = run(spark, stream)
    assert got.count() == 1500 and got.filter("reset").count() == 500 and got.filter("stream_generation = 0 AND generation_sample = first_sample").count() == 1500


def test_streams_of_one_bucket_keep_their_own_state(spark, monkeypatch):
    """Scenes of 40 keys, one of them null, in two groups: as of each key alone; ended keys are forgotten, groups do not grow with the keys."""
    monkeypatch.setattr(processors._run, "__defaults__", (2,))
    columns = "session_id string, onset_sample bigint, event_id bigint, stream_generation int, kind string, arrival bigint"
    rows = [(None if k == 0 else f"s{k}", *row, i) for k in range(40) for i, row in enumerate(((100 + k, 1, 0, "event"), (900, 2, 0, "event"), (150 + k, 3, 0, "event"), (2000 + k, 0, 0, "end")))]
    table = spark.createDataFrame(rows, columns)
    path = scratch_path(spark, "in")
    sinks.deal_by_time(table, path, "arrival", ["session_id"], pieces=4, salts=1)
    out = run(spark, processors.stream_scenes(sinks.replay(spark, path, table.schema), join=200, pre_anchor=50, length=400, order=("arrival",))).collect()
    assert len({r.session_id for r in out}) == 40
    assert sorted(((r.session_id or "s0"), r.anchor_sample, r.event_id) for r in out) == sorted((f"s{k}", a, e) for k in range(40) for a, e in ((100 + k, 1), (100 + k, 3), (900, 2)))
