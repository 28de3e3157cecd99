"""Live operators with typed state: score traces to full events under policies that change while they run, generations with
counted losses, and the latest state of every stream.

State is kept as typed rows, one per key, in list states of a RocksDB store; the keys are dealt to a fixed number of buckets, each of
which is one group of the stateful operator.  A stream ends by a row of kind ``end``, or,
where ``idle_ms`` is given, by a timer once nothing has come for that long; either way what is pending is delivered and the
state goes.  Rows of a key may be spread over micro-batches in any cut, but not come before earlier ones of their key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundlake import params
from soundlake.session import scratch_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POLICY = (("quiet", "double"), ("busy", "double"), ("cutoff", "double"), ("spacing", "bigint"), ("onset_offset", "bigint"), ("self_threshold", "double"))
BUCKETS = 256  # groups that the keys of a stream are dealt to; a group's rows of one micro-batch are in memory
# at one position scores come first, then a policy, which so holds from the next row on
KINDS = {"row": 0, "policy": 1, "end": 2}
EVENTS = ("event_id bigint, sample bigint, onset_sample bigint, end_sample bigint, detected_sample bigint, delivered_sample bigint, confidence double, "
          "source_hint string, source_confidence double, scene_mode string, suppressed boolean, stream_generation bigint")


def use_typed_state(spark: SparkSession) -> None:
    """Streams of this session keep state in the store these operators need."""
    spark.conf.set(STORE, ROCKSDB)


def _typed(stream: DataFrame, keys: Sequence[str], columns: str, processor: StatefulProcessor, idle_ms: int | None, buckets: int) -> DataFrame:
    """Keys ride as one text and meet in ``buckets`` groups, as a group costs several calls and tables and a key a few list items."""
    known = T.StructType([stream.schema[k] for k in keys])
    grouped = stream.withColumn("stream_key", F.to_json(F.struct(*keys))).withColumn("stream_bucket", F.pmod(F.xxhash64("stream_key"), F.lit(buckets)).cast("int"))
    found = grouped.drop(*keys).groupBy("stream_bucket").transformWithStateInPandas(processor, f"stream_key string, {columns}", "Append", "None" if idle_ms is None else "ProcessingTime")
    names = [c.split()[0] for c in columns.split(", ")]
    return found.withColumn("stream_key", F.from_json("stream_key", known)).select(*[F.col("stream_key")[k].alias(k) for k in keys], *names)


class _Live(StatefulProcessor):
    """Streams of one bucket, each with a state of its own: the fields of ``STATE``, kept as a list row that also has its key and when
    its last row came.  A stream is forgotten after ``idle_ms`` without rows."""

    STATE, ORDER, READ = "", (), ()

    def __init__(self, columns: str, idle_ms: int | None):
        self.names, self.idle_ms = [c.split()[0] for c in columns.split(", ")], idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.states = handle, handle.getListState("streams", f"stream_key string, touched bigint, {self.STATE}")

    def close(self) -> None:
        pass

    def known(self) -> dict:
        """Key to (touched, state)."""
        return {row[0]: (row[1], row[2:]) for row in self.states.get()} if self.states.exists() else {}

    def keep(self, held: dict) -> None:
        self.states.put([(key, touched, *state) for key, (touched, state) in held.items()]) if held else self.states.clear()
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if held:
                self.handle.registerTimer(min(touched for touched, _ in held.values()) + self.idle_ms)

    def frame(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame(found, columns=["stream_key", *self.names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        if "kind" in self.ORDER:
            table["kind"] = table["kind"].map(KINDS)
        table["_n"], streams = pd.factorize(table["stream_key"])
        table = table.sort_values(["_n", *self.ORDER], kind="stable")
        edges = np.searchsorted(table["_n"].to_numpy(), np.arange(len(streams) + 1))
        columns = [table[c].tolist() for c in self.READ]
        now = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held, found = self.known(), []
        for stream, a, b in zip(streams, edges, edges[1:]):
            _, state = held.pop(stream, (0, None))
            state, out = self.take(state, [c[a:b] for c in columns])
            found += [(stream, *row) for row in out]
            if state is not None:
                held[stream] = (now, state)
        self.keep(held)
        yield from self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, found, now = self.known(), [], timerValues.getCurrentProcessingTimeInMs()
        for stream in [s for s, (touched, _) in held.items() if touched + self.idle_ms <= now]:
            found += [(stream, *row) for row in self.end(held.pop(stream)[1])]
        self.keep(held)
        yield from self.frame(found)

    def take(self, state: tuple | None, columns: list[list]) -> tuple[tuple | None, list[tuple]]:
        """State after a stream's rows, given as lists of the columns ``READ`` in ``ORDER``, and the output rows; no state if the stream ended."""
        raise NotImplementedError

    def end(self, state: tuple) -> list[tuple]:
        return []


class _Recogniser(_Live):
    # the rows of the window are parallel lists, their sources one after the other; what is pending, if anything, is a struct of its own
    STATE = ("generation bigint, latest bigint, at int, " + ", ".join(f"{n} {t}" for n, t in POLICY) + ", samples array<bigint>, events array<bigint>, "
             "probabilities array<double>, activities array<double>, sources array<double>, pending boolean, p_sample bigint, p_event bigint, p_probability double, "
             "p_detected bigint, p_hint string, p_sure double, p_scene string, p_suppressed boolean")
    ORDER = ("sample", "kind", "event_id")
    READ = ("kind", "sample", "event_id", "probability", "activity", "source_probs", "stream_generation", *(n for n, _ in POLICY))
    NOTHING = (None,) * 8

    def __init__(self, policy: dict, lookahead: int, pulse: int, sources: Sequence[str], idle_ms: int | None):
        super().__init__(EVENTS, idle_ms)
        self.policy, self.lookahead, self.pulse, self.sources = policy, lookahead, pulse, list(sources)

    def read(self, state: tuple | None) -> None:
        self.out, n, wide = [], 3 + len(POLICY), len(self.sources)
        if state is None:
            self.generation, self.latest, self.at, self.rules, self.window, self.held = None, 0, 0, dict(self.policy), [], None
            return
        self.generation, self.latest, self.at = state[:3]
        self.rules = dict(zip((name for name, _ in POLICY), state[3:n]))
        *rows, sources, pending = state[n:n + 6]
        self.window = [(*row, list(sources[i * wide:(i + 1) * wide])) for i, row in enumerate(zip(*rows))]
        self.held = tuple(state[n + 6:]) if pending else None

    def state(self) -> tuple:
        parts = [list(x) for x in zip(*self.window)] or [[], [], [], [], []]
        return (self.generation, self.latest, self.at, *(self.rules[n] for n, _ in POLICY), *parts[:4], [x for row in parts[4] for x in row],
                self.held is not None, *(self.held or self.NOTHING))

    def emit(self, delivered: int) -> None:
        if self.held is None:
            return
        sample, ident, p, detected, hint, sure, scene, suppressed = self.held
        onset = max(0, sample - self.rules["onset_offset"])
        self.out.append((ident, sample, onset, onset + self.pulse, detected, delivered, p, hint, sure, scene, suppressed, self.generation))
        self.held = None

    def judge(self, right: int) -> None:
        window, at, rules = self.window, self.at, self.rules
        sample, ident, p, activity, source = window[at]
        before = [r[2] for r in window[max(0, at - self.lookahead):at]]
        after = [r[2] for r in window[at + 1:right + 1]]
        quiet = activity < rules["cutoff"]
        if p >= rules["quiet" if quiet else "busy"] and p >= max([p, *after]) and (not before or p > max(before)):
            seen = window[right][0]
            best = int(np.argmax(source))
            mine = float(source[self.sources.index("self")])
            suppressed = mine >= rules["self_threshold"]
            found = (sample, ident, p, seen, "self" if suppressed else self.sources[best], mine if suppressed else float(source[best]), "quiet" if quiet else "busy", suppressed)
            if self.held is None or sample - self.held[0] >= rules["spacing"]:
                self.emit(seen)
                self.held = found
            elif p > self.held[2]:
                self.held = found
        if self.held is not None and sample - self.held[0] >= rules["spacing"]:
            self.emit(self.latest)
        self.at += 1
        drop = max(0, self.at - self.lookahead)
        self.window, self.at = window[drop:], self.at - drop

    def flush(self) -> None:
        while self.at < len(self.window):
            self.judge(min(len(self.window) - 1, self.at + self.lookahead))
        self.emit(self.latest)

    def take(self, state, columns):
        self.read(state)
        ended, policy, end = False, KINDS["policy"], KINDS["end"]
        for kind, sample, ident, p, activity, source, generation, *rules in zip(*columns):
            if kind == policy:
                self.rules.update({n: int(v) if t == "bigint" else float(v) for (n, t), v in zip(POLICY, rules) if v is not None and not pd.isna(v)})
                continue
            if kind == end:
                self.flush()
                ended = True
                continue
            ended = False
            if generation != self.generation:  # what an older generation has pending is lost with it
                self.generation, self.latest, self.at, self.window, self.held = int(generation), 0, 0, [], None
            self.latest = int(sample)
            self.window.append((int(sample), int(ident), float(p), float(activity), [float(x) for x in source]))
            while self.at + self.lookahead < len(self.window):
                self.judge(self.at + self.lookahead)
        return None if ended else self.state(), self.out

    def end(self, state):
        self.read(state)
        self.flush()
        return self.out


def recognise(trace: DataFrame, *, quiet: float = 0.5, busy: float = 0.5, cutoff: float = 0.5, spacing: int = 1680, lookahead: int = 2, onset_offset: int = 512,
              pulse: int = 2400, self_threshold: float = 0.95, sources: Sequence[str] = params.SOURCE_NAMES, keys: Sequence[str] = ("session_id", "class"),
              idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Full events of a live score trace, each once no later row can replace it.

    ``trace``: ``keys``, kind ('row', 'policy' or 'end'), sample, event_id, probability, activity, source_probs, stream_generation, and the
    columns of ``POLICY``: a row of kind 'policy' changes those that are not null from the next row of its key on.  A peak is
    judged by the policy in force when its look-ahead is complete; a new generation drops what is pending.
    """
    # nulls would make doubles of whole numbers on the way
    trace = trace.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("event_id", "stream_generation")})
    policy = {"quiet": quiet, "busy": busy, "cutoff": cutoff, "spacing": spacing, "onset_offset": onset_offset, "self_threshold": self_threshold}
    return _typed(trace, keys, EVENTS, _Recogniser(policy, lookahead, pulse, sources, idle_ms), idle_ms, buckets)


def with_controls(rows: DataFrame, policies: DataFrame, at: str = "since") -> DataFrame:
    """Score rows (keys, sample, event_id, probability, activity, source_probs, stream_generation) and policy rows (keys, ``at``, any policy columns) as one trace."""
    names = [n for n, _ in POLICY]
    left = rows.select(*rows.columns, F.lit("row").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in POLICY])
    filled = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c not in policies.columns}
    right = policies.withColumns({**filled, "sample": F.col(at).cast("bigint"), "kind": F.lit("policy"),
                                  **{n: (F.col(n).cast(t) if n in policies.columns else F.lit(None).cast(t)) for n, t in POLICY}})
    return left.unionByName(right.select(*rows.columns, "kind", *names))


# --- generations ----------------------------------------------------------------------------------------------------------------

GENERATIONS = ("{first} bigint, stream_generation bigint, generation_sample bigint, reset boolean, overflow boolean, shed boolean, "
               "lost_total bigint, discarded_total bigint")


class _Generations(_Live):
    STATE = "next bigint, endpoint string, generation bigint, start bigint, lost bigint, discarded bigint"

    def __init__(self, first, limit, keep, idle_ms):
        super().__init__(GENERATIONS.format(first=first), idle_ms)
        self.limit, self.kept, self.ORDER, self.READ = limit, keep, (first,), (first, "frames", "endpoint", "lost", "available")

    def take(self, state, columns):
        upto, endpoint, generation, start, lost, discarded = state or (None, None, -1, 0, 0, 0)
        out = []
        for at, frames, now, gone, backlog in zip(*columns):
            reset, overflow, shed = upto is None or at != upto or now != endpoint, gone > 0, backlog > self.limit
            generation += int(reset) + int(overflow) + int(shed)
            if reset or overflow or shed:
                start = at
            lost += gone
            discarded += backlog - self.kept if shed else 0
            upto, endpoint = at + frames, now
            out.append((int(at), int(generation), int(at - start), bool(reset), bool(overflow), bool(shed), int(lost), int(discarded)))
        return (int(upto), endpoint, int(generation), int(start), int(lost), int(discarded)), out


def stream_losses(blocks: DataFrame, limit: int, keep: int, keys: Sequence[str] = ("session_id",), first: str = "first_sample", idle_ms: int | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Generations of a live block stream: a gap or another endpoint, frames lost to an overflow, and a backlog over ``limit``
    (cut to ``keep``) each open one; losses are counted on.  The batch form is ``operators.streams.generation_losses``."""
    return _typed(blocks, keys, GENERATIONS.format(first=first), _Generations(first, limit, keep, idle_ms), idle_ms, buckets)


# --- live state -----------------------------------------------------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(at) if system.exists(at) else []
    done = [f.getPath() for f in found if f.isDirectory() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def read_live_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``live_state_sink`` keeps, as of its last finished batch."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def live_state_sink(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]):
    """Keep the latest row of every key in a table, one row per key; returns the started query.

    ``stream`` has ``keys``, stream_generation, ``order`` and ``columns``; a newer generation replaces an older one, and a row whose
    ``columns`` are all null only clears.  Each micro-batch is reduced to a row per key, joined with the version before it and
    written as the version of its number, so a repeated batch gives the same table.
    """
    rank = F.struct("stream_generation", *order)
    names = [*keys, "stream_generation", *order, *[c for c in columns if c not in order]]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(*names).schema
        known = [n for n in _versions(spark, path) if n < number]
        before = spark.read.schema(schema).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)
        latest = batch.select(*names).unionByName(before).groupBy(*keys).agg(F.max_by(F.struct(*[n for n in names if n not in keys]), rank).alias("_s"))
        latest.select(*keys, "_s.*").write.mode("overwrite").parquet(f"{path}/version={number}")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_live_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Run the sink over everything available and read the table."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "live")
    live_state_sink(stream, path, scratch_path(spark, "offsets"), keys, order, columns).awaitTermination()
    names = [*keys, "stream_generation", *order, *[c for c in columns if c not in order]]
    return read_live_state(spark, path, stream.select(*names).schema)
