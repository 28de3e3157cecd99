"""Ordered operations per key that stay parallel when one key holds a large share of the rows.

A key's rows are cut into position slices (``floor(position / width)``).  Sorting, windows and folds
run per (key, slice); what crosses a slice edge travels as a summary of the slice or as a copy of the
few rows near the edge.  No step gathers a whole key: the only per-key windows run over one summary
row (or a constant number of edge rows) per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake.session import cut_lineage

SLICE = "_slice"


def add_slice(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(pos) / F.lit(width)).cast("bigint"))


def edge_window(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], width: int, reach: int,
                build: Callable[[object], dict[str, Column]]) -> DataFrame:
    """Row-frame window columns whose frames reach at most ``reach`` rows to either side.

    Rows farther than ``reach`` from a slice edge are finished inside the slice.  The others are
    recomputed on strips of ``2 * reach`` rows from both ends of every slice, ordered per key.
    """
    sliced = add_slice(df, pos, width)
    order = [F.col(pos), *[F.col(t) for t in ties]]
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    ranked = (sliced.withColumn("_rn", F.row_number().over(local))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, SLICE))))
    edge = (F.col("_rn") <= reach) | (F.col("_rn") > F.col("_n") - reach)
    strip = (F.col("_rn") <= 2 * reach) | (F.col("_rn") > F.col("_n") - 2 * reach)
    inner = ranked.withColumns(build(local)).filter(~edge)
    across = Window.partitionBy(*keys).orderBy(*order)
    outer = ranked.filter(strip).withColumns(build(across)).filter(edge)
    return inner.unionByName(outer).drop("_rn", "_n", SLICE)


def running(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], width: int,
            columns: dict[str, tuple[str, str]], include_current: bool = True) -> DataFrame:
    """Running sum / max / min / last-non-null per key from its first row.

    ``columns`` maps output name to (kind, input column).  Slice totals are scanned per key and the
    total of the earlier slices is joined back to every row of the slice.
    """
    sliced = add_slice(df, pos, width)
    order = [F.col(pos), *[F.col(t) for t in ties]]
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)

    def combine(kind: str, column: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min,
                "last": lambda c: F.last(c, ignorenulls=True)}[kind](column)

    totals, carried, within = [], [], {}
    for name, (kind, source) in columns.items():
        value = F.col(source)
        if kind == "last":
            total = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
        else:
            total = combine(kind, value)
        totals.append(total.alias(f"_t_{name}"))
        carried.append(combine(kind, F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}"))
        within[f"_l_{name}"] = combine(kind, value).over(local)
    carry = sliced.groupBy(*keys, SLICE).agg(*totals).select(*keys, SLICE, *carried)
    joined = sliced.withColumns(within).join(carry, [*keys, SLICE], "left")
    out = {}
    for name, (kind, _) in columns.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            both = F.coalesce(here, before - before) + F.coalesce(before, here - here)
            out[name] = F.coalesce(both, here, before)
        elif kind == "last":
            out[name] = F.coalesce(here, before)
        else:
            out[name] = (F.greatest if kind == "max" else F.least)(here, before)
    drop = [f"{p}{n}" for n in columns for p in ("_l_", "_c_")]
    return joined.withColumns(out).drop(*drop, SLICE)


def ordinal(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], width: int, out: str) -> DataFrame:
    """Dense 0-based row number per key, without one sort task per key."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (running(one, keys, pos, ties, width, {out: ("sum", "_one")})
            .withColumn(out, F.col(out) - 1).drop("_one"))


def sorted_index(df: DataFrame, order: Sequence[str], out: str, size: str | None = None) -> DataFrame:
    """0-based place of every row in the total order, or the total ``size`` of the rows before it.

    Rows are range-partitioned and sorted once and written as a table, which fixes the partitions; the place
    is the row's number in its partition plus the sizes of the earlier ones (one row per partition).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_m", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size) if size else F.count(F.lit(1))
    sizes = fixed.groupBy("_part").agg(total.alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = F.col("_m") - F.shiftleft(F.col("_part"), 33)
    if size:
        inside = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(size).over(inside), F.lit(0))
    return fixed.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + local).drop("_m", "_part", "_before")


def with_halo(df: DataFrame, pos: str, width: int, back: int, ahead: int) -> DataFrame:
    """Copy each row into every slice that needs it: its own and those starting within ``ahead`` after
    it or ending within ``back`` before it.  ``_own`` marks the original."""
    own = F.floor(F.col(pos) / width).cast("bigint")
    first = F.floor((F.col(pos) - F.lit(back)) / width).cast("bigint")
    last = F.floor((F.col(pos) + F.lit(ahead)) / width).cast("bigint")
    return (df.withColumn("_home", own).withColumn(SLICE, F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col(SLICE) == F.col("_home")).drop("_home"))


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, tol: int, width: int,
                   payload: Sequence[str] = (), prefix: str = "near") -> DataFrame:
    """For each left row the closest right row at or before it and the closest at or after it.

    Adds ``{prefix}_prev`` and ``{prefix}_next`` structs (position plus ``payload``) or NULL beyond
    ``tol`` (inclusive).  Right rows are copied to the slices within ``tol``; left rows are never
    multiplied, and no list of candidate pairs is formed.
    """
    names = [c for c in left.columns if c not in keys]
    value = F.struct(F.col(pos).alias("pos"), *[F.col(c) for c in payload])
    probes = add_slice(left, pos, width).select(
        *keys, SLICE, F.col(pos).alias("_p"), F.lit(1).alias("_side"),
        F.struct(*names).alias("_row"), F.lit(None).alias("_hit"))
    hits = with_halo(right.select(*keys, pos, *payload), pos, width, tol, tol).select(
        *keys, SLICE, F.col(pos).alias("_p"), F.lit(0).alias("_side"),
        F.lit(None).alias("_row"), value.alias("_hit"))
    both = probes.unionByName(hits)
    # Right rows sort first among equals for the backward look; for the forward look they sort last.
    back = Window.partitionBy(*keys, SLICE).orderBy(F.col("_p"), F.col("_side"))
    ahead = Window.partitionBy(*keys, SLICE).orderBy(F.col("_p").desc(), F.col("_side"))
    looked = (both.withColumn("_prev", F.last("_hit", ignorenulls=True).over(
                  back.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_next", F.last("_hit", ignorenulls=True).over(
                  ahead.rowsBetween(Window.unboundedPreceding, 0)))
              .filter(F.col("_side") == 1))
    fits = lambda c: F.when(F.abs(F.col(f"{c}.pos") - F.col("_p")) <= tol, F.col(c))
    return looked.select(*keys, *[F.col(f"_row.{n}").alias(n) for n in names],
                         fits("_prev").alias(f"{prefix}_prev"), fits("_next").alias(f"{prefix}_next"))


def is_near(prefix: str = "near") -> Column:
    return F.col(f"{prefix}_prev").isNotNull() | F.col(f"{prefix}_next").isNotNull()


# --- sequential chains ------------------------------------------------------------------------------
#
# Both chains walk a key in order holding one row ("the held row"):
#   spacing: a later row takes over when it is >= reach away (the held row is then final) or when it is
#            closer but scores strictly higher (the held row is dropped);
#   span:    a later row takes over when it is > reach away; rows in between belong to the held row.
# Who takes over from a row depends on that row alone, so rows form a forest and the chain is a path in it.
# Rows are sorted by range into partitions of a bounded number of rows, whatever the keys and however dense.
# A key inside one partition is finished there.  For the others, each partition's part of the key is a map
# from the row held on entry to the row held at the end; maps are composed FAN at a time, level by level, the
# entries come back down the same way, and the parts are finished knowing theirs.

FAN = 64
PART_ROWS = 500_000


def _takers(pos: np.ndarray, score: np.ndarray | None, reach: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row that takes over, by distance and altogether; the end of its segment (``fresh`` begins one) if none does."""
    n = len(pos)
    begin = np.flatnonzero(fresh)
    end = np.repeat(np.r_[begin[1:], n], np.diff(np.r_[begin, n]))
    # segments end to end on one axis, each more than its reach from the next
    last = np.r_[begin[1:], n] - 1
    room = pos[last] - pos[begin] + reach[begin] + 1
    axis = pos + np.repeat(np.cumsum(room) - room - pos[begin], np.diff(np.r_[begin, n]))
    far = np.minimum(np.searchsorted(axis, axis + reach), end)
    if score is None:
        return far, far
    higher, waiting, values = [n] * n, [], score.tolist()
    for i, value in enumerate(values):  # a stack of rows that nothing higher has followed yet
        while waiting and values[waiting[-1]] < value:
            higher[waiting.pop()] = i
        waiting.append(i)
    return far, np.minimum(far, np.array(higher, dtype=np.int64))


def _ends(taker: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The last row of the path from each row that lies before ``stop``."""
    rows = np.arange(len(taker))
    jump = np.where(taker < stop, taker, rows)
    while not np.array_equal(jump, further := jump[jump]):
        jump = further
    return jump


class _Map:
    """What a stretch of a key does to the held row: its rows that can be first to take over, and what is held at the end then.

    ``open``: all its rows are within reach of the first, so a row may be held all through.
    """

    def __init__(self, reach, open_, pos, score, end_pos, end_score, end_part):
        self.reach, self.open, self.pos, self.score = int(reach), bool(open_), pos, score
        self.end_pos, self.end_score, self.end_part = end_pos, end_score, end_part
        self.highest = np.maximum.accumulate(score)

    def packed(self) -> bytes:
        return np.concatenate([np.array([self.reach, self.open], np.int64), self.pos, self.score.view(np.int64), self.end_pos,
                               self.end_score.view(np.int64), self.end_part]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> _Map:
        x = np.frombuffer(data, np.int64)
        pos, score, end_pos, end_score, end_part = x[2:].reshape(5, -1)
        return cls(x[0], x[1], pos, score.view(float), end_pos, end_score.view(float), end_part)

    def first(self, pos, score):
        """Index of the row that takes over from held rows, the number of rows if none does."""
        return np.minimum(np.searchsorted(self.pos, pos + self.reach), np.searchsorted(self.highest, score, side="right"))

    def then(self, later: _Map) -> _Map:
        at = later.first(self.end_pos, self.end_score)
        taken, at = at < len(later.pos), np.minimum(at, len(later.pos) - 1)
        ends = [np.where(taken, getattr(later, c)[at], getattr(self, c)) for c in ("end_pos", "end_score", "end_part")]
        if not self.open:
            return _Map(self.reach, False, self.pos, self.score, *ends)
        # rows of the later stretch up to the first one out of reach can take over as well
        more = slice(0, int(np.searchsorted(later.pos, self.pos[0] + self.reach)) + 1)
        both = [np.concatenate([a, getattr(later, c)[more]]) for a, c in zip((self.pos, self.score, *ends), ("pos", "score", "end_pos", "end_score", "end_part"))]
        return _Map(self.reach, later.open and later.pos[-1] < self.pos[0] + self.reach, *both)


def _path(steps: list[int], entry: int, end: int) -> np.ndarray:
    path = []
    while entry < end:
        path.append(entry)
        entry = steps[entry]
    return np.array(path, dtype=np.int64)


def _kept(path: np.ndarray, far: np.ndarray, taker: np.ndarray, dropped: bool = False) -> np.ndarray:
    """Rows of a path that nothing higher and closer has replaced; ``dropped``: its last row is replaced further on."""
    if dropped:
        path = path[:-1]
    return path[taker[path] == far[path]]


def _anchors(path: np.ndarray, pos: np.ndarray, begin: int, end: int, held: int) -> np.ndarray:
    """For each row of a segment the position of the path's latest row, ``held`` before the first."""
    latest = np.zeros(end - begin, dtype=np.int64)
    latest[path - begin] = path + 1
    latest = np.maximum.accumulate(latest)
    return np.where(latest > 0, pos[latest - 1], held)


def segment_starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Which rows of a sorted table begin a new combination of the named columns."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for name in names:
        code = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= code[1:] != code[:-1]
    return fresh


def _chain_explore(keys: list[str], names: list[str], spacing: bool):
    """Finish whole keys; of a partition's first and last key give the rows and the map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        fresh = segment_starts(table, keys)
        pos, reach = table["_p"].to_numpy(), table["_r"].to_numpy()
        score = table["_s"].to_numpy() if spacing else None
        far, taker = _takers(pos, score, reach, fresh)
        begin = np.flatnonzero(fresh)
        end = np.r_[begin[1:], n]
        edge = {0: 0, len(begin) - 1: min(1, len(begin) - 1)}
        payload, steps, done = table.select(names), taker.tolist(), []
        for k in range(1, len(begin) - 1):
            a, b = int(begin[k]), int(end[k])
            path = _path(steps, a, b)
            done.append(_kept(path, far, taker) if spacing else _anchors(path, pos, a, b, 0))

        def out(rows, seg, i, anchor, data):
            m = rows.num_rows
            columns = [*rows.columns, pa.array(np.full(m, part)), pa.array(np.full(m, seg, np.int32)), i, anchor, data]
            return pa.table(columns, names=[*names, "_part", "_seg", "_i", "_anchor", "_map"]).combine_chunks().to_batches()
        if done:
            rows = np.concatenate(done) if spacing else np.arange(begin[1], begin[-1])
            anchor = pa.nulls(len(rows), pa.int64()) if spacing else pa.array(np.concatenate(done))
            yield from out(payload.take(pa.array(rows)), -1, pa.array(rows), anchor, pa.nulls(len(rows), pa.binary()))
        for k, seg in edge.items():
            a, b = int(begin[k]), int(end[k])
            m = b - a
            yield from out(payload.slice(a, m), seg, pa.array(np.arange(m)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()))
            ends = _ends(taker[a:b] - a, np.full(m, m))
            most = min(m, int(np.searchsorted(pos[a:b], pos[a] + reach[a])) + 1)
            value = score[a:b] if spacing else np.zeros(m)
            stretch = _Map(reach[a], pos[b - 1] < pos[a] + reach[a], pos[a:a + most], value[:most], pos[a:b][ends[:most]], value[ends[:most]], np.full(most, part, np.int64))
            yield from out(payload.slice(a, 1), seg, pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([stretch.packed()], pa.binary()))
    return run


def _compose(names: list[str]):
    """One map of up to FAN consecutive ones."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_part")
        found = _Map.unpacked(rows["_map"].iloc[0])
        for data in rows["_map"].iloc[1:]:
            found = found.then(_Map.unpacked(data))
        return rows.iloc[:1].assign(_map=found.packed())[names]
    return run


def _descend(names: list[str]):
    """What is held on entry to each of up to FAN stretches, from what is held on entry to the first; rows with ``_drop`` name a
    partition whose last held row an other one dropped."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_part")
        first = rows.iloc[0]
        held = None if pd.isna(first["_in_pos"]) else (int(first["_in_pos"]), float(first["_in_score"]), int(first["_in_part"]))
        entries, drops = [], []
        for data, part in zip(rows["_map"], rows["_part"]):
            stretch = _Map.unpacked(data)
            entries.append(held or (None, None, None))
            at = int(stretch.first(held[0], held[1])) if held else 0
            if at < len(stretch.pos):
                if held and stretch.pos[at] < held[0] + stretch.reach:
                    drops.append(held[2])
                held = int(stretch.end_pos[at]), float(stretch.end_score[at]), int(stretch.end_part[at])
        rows = rows.assign(**{c: pd.array([e[i] for e in entries], dtype=t) for i, (c, t) in enumerate(
            (("_in_pos", "Int64"), ("_in_score", "Float64"), ("_in_part", "Int64")))}, _drop=pd.array([None] * len(rows), dtype="Int64"))
        if drops:
            rows = pd.concat([rows, pd.concat([rows.iloc[:1]] * len(drops)).assign(_drop=pd.array(drops, dtype="Int64"))])
        return rows[names]
    return run


def _chain_finish(names: list[str], spacing: bool):
    """A partition's part of a key whose entry is known."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        n = table.num_rows
        pos, reach = table["_p"].to_numpy(), table["_r"].to_numpy()
        fresh = np.zeros(n, bool)
        fresh[0] = True
        far, taker = _takers(pos, table["_s"].to_numpy() if spacing else None, reach, fresh)
        held = table["_in_pos"][0].as_py()
        entry = 0
        if held is not None:
            entry = int(np.searchsorted(pos, held + reach[0]))
            if spacing:
                over = np.flatnonzero(table["_s"].to_numpy() > table["_in_score"][0].as_py())
                entry = min(entry, int(over[0]) if len(over) else n)
        path, payload = _path(taker.tolist(), entry, n), table.select(names)
        if spacing:
            return payload.take(pa.array(_kept(path, far, taker, bool(table["_dropped"][0].as_py()))))
        return payload.append_column("_anchor", pa.array(_anchors(path, pos, 0, n, held or 0)))
    return run


def chain(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str], width: int, reach: Column | int,
          score: str | None = None, part_rows: int = PART_ROWS, fan: int = FAN) -> DataFrame:
    """Sequential selection per key (see above); ``reach`` is one number per key, positions are not null.

    With ``score``: the rows that remain under a minimum spacing of ``reach``.  Without: all rows plus
    ``_anchor``, the position of the first row of the span-bounded cluster they belong to.  ``width`` is not needed
    any more: partitions hold at most about ``part_rows`` rows.
    """
    spark, keys, spacing, own = df.sparkSession, list(keys), score is not None, df.columns
    distance = (reach if isinstance(reach, Column) else F.lit(reach)).cast("bigint")
    prepared = cut_lineage(df.withColumns({
        "_p": F.col(pos).cast("bigint"), "_s": F.col(score).cast("double") if spacing else F.lit(0.0),
        "_r": distance if spacing else distance + 1}))
    names = prepared.columns
    rows = prepared.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(wanted, rows), -(-rows // part_rows))
    order = [*keys, "_p", *[t for t in ties if t not in keys]]
    ranged = prepared.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = [T.StructField(f.name, f.dataType) for f in prepared.schema]
    extra = [T.StructField(n, t) for n, t in (("_part", T.LongType()), ("_seg", T.IntegerType()), ("_i", T.LongType()), ("_anchor", T.LongType()), ("_map", T.BinaryType()))]
    explored = cut_lineage(ranged.mapInArrow(_chain_explore(keys, names, spacing), T.StructType(fields + extra)))
    done = explored.filter("_seg < 0")
    finished = done.select(*own) if spacing else done.select(*own, "_anchor")

    # maps of the parts of keys, then of FAN consecutive partitions at a time
    key_fields = [prepared.schema[k] for k in keys]
    levels = [explored.filter("_map is not null").select(*keys, "_part", "_seg", "_map")]
    scale = fan
    while scale < parts:
        shape = T.StructType([*key_fields, T.StructField("_part", T.LongType()), T.StructField("_seg", T.IntegerType()), T.StructField("_map", T.BinaryType())])
        grouped = levels[-1].withColumn("_group", F.floor(F.col("_part") / scale)).groupBy(*keys, "_group")
        levels.append(cut_lineage(grouped.applyInPandas(_compose([*keys, "_part", "_seg", "_map"]), shape)))
        scale *= fan
    held = [T.StructField("_in_pos", T.LongType()), T.StructField("_in_score", T.DoubleType()), T.StructField("_in_part", T.LongType()), T.StructField("_drop", T.LongType())]
    names_out = [*keys, "_part", "_seg", "_in_pos", "_in_score", "_in_part", "_drop"]
    shape = T.StructType([*key_fields, T.StructField("_part", T.LongType()), T.StructField("_seg", T.IntegerType()), *held])
    none = {"_in_pos": F.lit(None).cast("bigint"), "_in_score": F.lit(None).cast("double"), "_in_part": F.lit(None).cast("bigint")}
    entries = None
    for maps in reversed(levels):
        if entries is None:
            rows_ = maps.withColumns(none)
        else:  # a group begins where its own first map does
            known = entries.filter("_drop is null").select(F.col("_part").alias("_at"), F.col("_seg").alias("_at_seg"), "_in_pos", "_in_score", "_in_part")
            rows_ = maps.join(known, (maps["_part"] == known["_at"]) & (maps["_seg"] == known["_at_seg"]), "left").drop("_at", "_at_seg")
        grouped = rows_.withColumn("_group", F.floor(F.col("_part") / scale)).groupBy(*keys, "_group")
        entries = cut_lineage(grouped.applyInPandas(_descend(names_out), shape))
        scale //= fan
    # a partition's last key is the only one whose last held row can be dropped from outside
    drops = entries.filter("_drop is not null").select(*keys, F.col("_drop").alias("_part")).distinct()
    last = explored.filter("_map is not null").groupBy("_part").agg(F.max("_seg").alias("_seg"))
    drops = drops.select("_part").join(last, "_part").withColumn("_dropped", F.lit(True))
    known = entries.filter("_drop is null").select("_part", "_seg", "_in_pos", "_in_score")
    edges = explored.filter("_seg >= 0 and _map is null").select(*names, "_part", "_seg", "_i").join(known, ["_part", "_seg"]).join(drops, ["_part", "_seg"], "left")
    out_fields = [T.StructField(n, df.schema[n].dataType) for n in own] + ([] if spacing else [T.StructField("_anchor", T.LongType())])
    closed = edges.groupBy("_part", "_seg").applyInArrow(_chain_finish(own, spacing), T.StructType(out_fields))
    return finished.unionByName(closed)
