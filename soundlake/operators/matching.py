"""Joining labels and detections by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundlake import params
from soundlake.operators.ordered import SLICE, edge_window, is_near, nearest_within, running, segment_starts, with_halo
from soundlake.session import cut_lineage

KEYS = ("session_id", "class")


def usable_truth(truth: DataFrame, classes: Sequence[str]) -> DataFrame:
    return truth.filter(F.col("class").isin(list(classes))
                        & ~F.coalesce(F.col("uncertain"), F.lit(False))
                        & F.coalesce(F.col("reviewed"), F.lit(True)))


def _look(value: str, names: Sequence[str], backward: bool) -> Column:
    call = "lag" if backward else "lead"
    return F.expr(f"{call}({value}) IGNORE NULLS OVER (PARTITION BY {', '.join(names)}, {SLICE} "
                  f"ORDER BY m_pos, m_side, m_ord)")


def _mutual_round(rest: DataFrame, keys: Sequence[str], tol: int, width: int) -> DataFrame:
    """One round: every row looks at the nearest free row of the other side; agreeing rows pair up.

    Only the lowest-ordered row of a (side, position) group can be part of the best pair, so only it is
    visible.  A row's decision depends on rows within 2 * tol, which the halo brings in; each copy is
    decided in its own slice, and no join is needed.  ``clear`` marks a pair without an equally near
    alternative on either side, ``rank`` the place inside the group.
    """
    copies = with_halo(rest, "m_pos", width, 2 * tol, 2 * tol)
    order = Window.partitionBy(*keys, SLICE).orderBy("m_pos", "m_side", "m_ord")
    previous = F.lag(F.struct("m_pos", "m_side")).over(order)
    place = F.row_number().over(order)
    seen = copies.withColumns({
        "lead_row": previous.isNull() | (previous != F.struct("m_pos", "m_side")), "place": place})
    seen = seen.withColumn("rank", 1 + F.col("place") - F.max(F.when(F.col("lead_row"), F.col("place"))).over(order))
    shown = F.when(F.col("lead_row"), F.struct(
        F.col("m_pos").alias("pos"), F.col("m_ord").alias("ord"), F.col("m_id").alias("id")))
    seen = seen.withColumns({"left_of": F.when(F.col("m_side") == 0, shown),
                             "right_of": F.when(F.col("m_side") == 1, shown)})

    def other(backward: bool) -> Column:
        return F.when(F.col("m_side") == 0, _look("right_of", keys, backward)).otherwise(
            _look("left_of", keys, backward))

    near = seen.withColumns({"before": other(True), "after": other(False)})

    def scored(side: str) -> Column:
        gap = F.abs(F.col(f"{side}.pos") - F.col("m_pos"))
        return F.when(gap <= tol, F.struct(gap.alias("gap"), F.col(f"{side}.ord").alias("ord"),
                                           F.col(f"{side}.id").alias("id")))

    tied = F.coalesce(F.abs(F.col("before.pos") - F.col("m_pos")) == F.abs(F.col("after.pos") - F.col("m_pos")), F.lit(False))
    chosen = near.withColumns({"best": F.least(scored("before"), scored("after")), "tied": tied})
    choice = F.when(F.col("lead_row"), F.struct(F.col("m_id").alias("id"), F.col("best.id").alias("pick"), F.col("tied").alias("tied")))
    chosen = chosen.withColumns({"left_pick": F.when(F.col("m_side") == 0, choice),
                                 "right_pick": F.when(F.col("m_side") == 1, choice)})

    def pick(backward: bool) -> Column:
        return F.when(F.col("m_side") == 0, _look("right_pick", keys, backward)).otherwise(
            _look("left_pick", keys, backward))

    agreed = chosen.withColumns({"pick_before": pick(True), "pick_after": pick(False)})
    partner = F.when(F.col("pick_before.id") == F.col("best.id"), F.col("pick_before")).when(
        F.col("pick_after.id") == F.col("best.id"), F.col("pick_after"))
    agreed = agreed.withColumn("partner", partner).filter("_own and best is not null")
    paired = F.coalesce(F.col("lead_row") & (F.col("partner.pick") == F.col("m_id")), F.lit(False))
    return agreed.withColumns({"paired": paired, "clear": ~F.col("tied") & ~F.col("partner.tied"),
                               "partner_pos": F.when(F.col("best.id") == F.col("before.id"), F.col("before.pos")).otherwise(
                                   F.col("after.pos"))}).select(
        *keys, "m_pos", "m_side", "m_ord", "m_id", "best", "paired", "clear", "rank", "partner_pos")


def _group_pairs(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where two groups of equal positions chose each other without a tie, their rows pair up in order."""
    links = decided.filter("paired and clear and m_side = 0").select(
        *keys, "m_pos", "partner_pos", F.col("best.gap").alias("distance"))
    waiting = decided.filter("rank > 1").select(*keys, "m_pos", "m_side", "m_id", "rank")
    left = waiting.filter("m_side = 0").drop("m_side").join(links, [*keys, "m_pos"])
    right = waiting.filter("m_side = 1").select(*keys, F.col("m_pos").alias("partner_pos"), "rank", F.col("m_id").alias("other"))
    return left.join(right, [*keys, "partner_pos", "rank"]).select(*keys, "m_id", "other", "m_pos", "distance")


# --- greedy pairs by slices ------------------------------------------------------------------------------
#
# The greedy rule takes pairs by rising distance, so a row's fate up to a distance depends on rows no farther than
# that.  A task sees a slice and a halo; what lies beyond can touch a row from its distance to the halo's end on.  Pairs are
# taken in order, and in the same order doubt spreads inwards: a row is in doubt from its distance to the nearest row in doubt
# on.  What is taken or left over before that is final; rows in doubt meet again in slices eight times as wide.

GROWTH = 8
SLICE_ROWS = 1_000_000      # beyond it, rounds of mutual choices take over


def greedy_pairs(pos: list[int], side: list[int], order: list[int], tol: int, left: int | None = None, right: int | None = None) -> tuple[list[int], list[bool]]:
    """Partner (or -1) and doubt of rows sorted by (position, side, order); unknown rows may lie at or beyond ``left`` and ``right``.

    The nearest free pair always stands side by side among free rows, rows of one side and place being one entry that gives its
    lowest first; so a heap of neighbours is enough, however many rows are in reach of each other.
    """
    n = len(pos)
    begin = [i for i in range(n) if not i or pos[i] != pos[i - 1] or side[i] != side[i - 1]]
    count = len(begin)
    head, stop = list(begin), begin[1:] + [n]
    before, after = list(range(-1, count - 1)), list(range(1, count + 1))
    unsure, partner, heap = [False] * count, [-1] * n, []
    edges, fronts = [left, right], [0, count - 1]

    def meet(a, b):
        if a >= 0 and b < count and side[begin[a]] != side[begin[b]] and not unsure[a] and not unsure[b]:
            gap = pos[begin[b]] - pos[begin[a]]
            if gap <= tol:
                x, y = order[head[a]], order[head[b]]
                heappush(heap, (gap, 1, *((x, y) if side[begin[a]] == 0 else (y, x)), a, b))

    def doubt(which, now):
        g = fronts[which]
        if edges[which] is not None and 0 <= g < count and not unsure[g]:
            gap = max(now, abs(pos[begin[g]] - edges[which]))
            if gap <= tol:
                heappush(heap, (gap, 0, which, g, 0, 0))

    def leave(g, now):
        a, b = before[g], after[g]
        if a >= 0:
            after[a] = b
        if b < count:
            before[b] = a
        for which, to in ((0, b), (1, a)):
            if fronts[which] == g:
                fronts[which] = to
                doubt(which, now)
        return a, b

    for g in range(1, count):
        meet(g - 1, g)
    doubt(0, 0)
    doubt(1, 0)
    while heap:
        gap, kind, x, y, a, b = heappop(heap)
        if not kind:
            if fronts[x] == y and not unsure[y]:
                unsure[y], edges[x] = True, pos[begin[y]]
                fronts[x] = before[y] if x else after[y]
                doubt(x, gap)
            continue
        if unsure[a] or unsure[b] or after[a] != b or head[a] == stop[a] or head[b] == stop[b]:
            continue
        i, j = head[a], head[b]
        if (order[i], order[j]) != ((x, y) if side[i] == 0 else (y, x)):
            continue
        partner[i], partner[j] = j, i
        head[a], head[b] = i + 1, j + 1
        outer, further = (a, b)
        if head[a] == stop[a]:
            outer, _ = leave(a, gap)
        if head[b] == stop[b]:
            _, further = leave(b, gap)
        meet(outer, further)
        if outer == a:
            meet(before[a], a)
        if further == b:
            meet(b, after[b])
    rows = [False] * n
    for g in range(count):
        if unsure[g]:
            for i in range(head[g], stop[g]):
                rows[i] = True
    return partner, rows


def _match_slices(keys: Sequence[str], tol: int, width: int, halo: int):
    """Sorted slices with halo to their own rows, each with its partner's id and place, or in doubt."""
    by = [*keys, SLICE]
    keep = [*keys, "m_pos", "m_side", "m_ord", "m_id"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        pos, side, order, ident = (table[c].to_numpy() for c in ("m_pos", "m_side", "m_ord", "m_id"))
        slices = table[SLICE].to_numpy()
        fresh = segment_starts(table, by)
        fresh[1:] |= pos[1:] - pos[:-1] > tol      # nothing reaches over such a gap
        begin = np.flatnonzero(fresh)
        end = np.r_[begin[1:], n]
        left, right = slices[begin] * width - halo, (slices[begin] + 1) * width + halo
        near_left, near_right = pos[begin] - left <= tol, right - pos[end - 1] <= tol
        seconds = np.add.reduceat(side, begin)
        both = (seconds > 0) & (seconds < end - begin)
        simple = both & (end - begin == 2) & ~near_left & ~near_right
        partner, unsure = np.full(n, -1), np.zeros(n, bool)
        partner[begin[simple]], partner[begin[simple] + 1] = begin[simple] + 1, begin[simple]
        for a, b, l, r, nl, nr in zip(*(x[(both & ~simple) | near_left | near_right].tolist() for x in (begin, end, left, right, near_left, near_right))):
            found, rows = greedy_pairs(pos[a:b].tolist(), side[a:b].tolist(), order[a:b].tolist(), tol, l if nl else None, r if nr else None)
            found = np.array(found)
            partner[a:b], unsure[a:b] = np.where(found >= 0, found + a, -1), rows
        own = np.flatnonzero(table["_own"].to_numpy(zero_copy_only=False))
        other = partner[own]
        none = other < 0
        columns = [*[table[c].combine_chunks().take(pa.array(own)) for c in keep], pa.array(ident[other], mask=none), pa.array(pos[other], mask=none), pa.array(unsure[own])]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "other", "other_pos", "unsure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= 100_000:
                last = int(np.flatnonzero(segment_starts(held, by))[-1])
                if last:
                    yield solve(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield solve(held)
    return run


def _slice_round(rest: DataFrame, keys: Sequence[str], tol: int, width: int, halo: int) -> DataFrame:
    copies = with_halo(rest, "m_pos", width, halo, halo)
    ordered = copies.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, "m_pos", "m_side", "m_ord", "m_id")
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in rest.schema], T.StructField("other", T.LongType()), T.StructField("other_pos", T.LongType()),
                          T.StructField("unsure", T.BooleanType())])
    return ordered.mapInArrow(_match_slices(keys, tol, width, halo), shape)


def match_events(truth: DataFrame, pred: DataFrame, tol: int = params.MATCH_TOLERANCE, *,
                 keys: Sequence[str] = KEYS, truth_id: str = "truth_id", pred_id: str = "pred_id",
                 pos: str = "onset_sample", width: int | None = None,
                 truth_order: str | None = None, pred_order: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Greedy one-to-one pairs by (distance, truth order, prediction order), distance <= tol.

    Nearly all rows are final after one pass over slices; each further pass, over the rows still in doubt alone, has slices
    eight times as wide, and its number grows with the logarithm of the longest dependency.  Should such a slice hold more
    than ``slice_rows`` rows in doubt, rounds of mutual choices finish them.  Each pass is written to
    the shared checkpoint folder.  Ids must be BIGINT and unique per side; they also order ties by default.
    """
    width = width or max(64 * tol, 1)

    def side(df, code, ident, order):
        return df.select(*keys, F.col(pos).cast("bigint").alias("m_pos"), F.lit(code).alias("m_side"),
                         F.col(order or ident).cast("bigint").alias("m_ord"), F.col(ident).cast("bigint").alias("m_id"))

    rest = side(truth, 0, truth_id, truth_order).unionByName(side(pred, 1, pred_id, pred_order))
    columns = [*keys, "m_pos", "m_side", "m_ord", "m_id"]
    names = [*keys, truth_id, pred_id, "truth_pos", "distance"]
    found = []
    while True:
        decided = cut_lineage(_slice_round(rest, keys, tol, width, max(4 * tol, width // GROWTH)))
        taken = decided.filter("other is not null")
        sure = taken.filter("m_side = 0").select(*keys, "m_id", "other", "m_pos", F.abs(F.col("other_pos") - F.col("m_pos"))).toDF(*names)
        found.append(sure)
        rest = decided.filter("unsure").select(*columns)
        if rest.isEmpty():
            break
        # of a pair over a slice's edge one row may know and the other not
        late = rest.filter("m_side = 0").select("m_id").join(
            taken.filter("m_side = 1").select(*keys, F.col("other").alias("m_id"), F.col("m_id").alias("pred"), "other_pos", F.abs(F.col("other_pos") - F.col("m_pos")).alias("gap")), "m_id")
        late = cut_lineage(late.select(*keys, "m_id", "pred", "other_pos", "gap").toDF(*names))
        found.append(late)
        gone = late.select(F.lit(0).alias("m_side"), F.col(truth_id).alias("m_id")).unionByName(sure.select(F.lit(1).alias("m_side"), F.col(pred_id).alias("m_id")))
        rest = cut_lineage(rest.join(gone, ["m_side", "m_id"], "left_anti").select(*columns))
        width *= GROWTH
        if rest.groupBy(*keys, F.floor(F.col("m_pos") / width)).count().filter(F.col("count") > slice_rows).isEmpty():
            continue
        found += [x.toDF(*names) for x in _mutual_pairs(rest, keys, tol, max(64 * tol, 1))]
        break
    return reduce(DataFrame.unionByName, found)


def _mutual_pairs(rest: DataFrame, keys: Sequence[str], tol: int, width: int) -> list[DataFrame]:
    """Rounds of mutual choices until none is left.

    The best remaining pair of all is always a mutual choice, and a mutual choice is always taken by the
    greedy rule, so this gives the greedy result exactly.  Rows without a free partner in reach leave for good.
    """
    found = []
    while True:
        decided = cut_lineage(_mutual_round(rest, keys, tol, width))
        state = decided.agg(F.count_if("paired").alias("paired"), F.count_if(F.col("rank") > 1).alias("grouped"),
                            F.count_if(~F.col("paired")).alias("rest")).first()
        if state["paired"] == 0:
            return found
        found.append(decided.filter("paired and m_side = 0").select(*keys, "m_id", "best.id", "m_pos", "best.gap"))
        rest = decided.filter("not paired")
        if state["grouped"]:
            grouped = cut_lineage(_group_pairs(decided, keys))
            found.append(grouped)
            gone = grouped.select(F.lit(0).alias("m_side"), "m_id").unionByName(
                grouped.select(F.lit(1).alias("m_side"), F.col("other").alias("m_id")))
            rest = rest.join(gone, ["m_side", "m_id"], "left_anti")
        rest = rest.select(*keys, "m_pos", "m_side", "m_ord", "m_id")
        if state["rest"] == 0:
            return found


def scene_mode_asof(truth: DataFrame, trace: DataFrame, cutoff: float, lead_in: int, width: int,
                    keys: Sequence[str] = ("session_id",), ties: Sequence[str] = ()) -> DataFrame:
    """Fill a missing scene mode from the activity row at or before ``onset - lead_in`` (else the first row)."""
    known = F.col("scene_mode").isin("quiet", "busy")
    names = [c for c in truth.columns if c not in keys]
    tie_fields = [F.col(t).cast("bigint").alias(t) for t in ties]
    probes = truth.select(*keys, F.greatest(F.lit(0), F.col("onset_sample") - lead_in).cast("bigint").alias("_p"),
                          F.lit(1).alias("_side"), *[F.lit(None).cast("bigint").alias(t) for t in ties],
                          F.lit(None).cast("double").alias("_a"), F.struct(*names).alias("_row"))
    rows = trace.select(*keys, F.col("sample").alias("_p"), F.lit(0).alias("_side"), *tie_fields,
                        F.col("activity").alias("_a"), F.lit(None).alias("_row"))
    # ``probe`` rows sort after every trace row at the same position.
    both = rows.unionByName(probes)
    filled = running(both, keys, "_p", ["_side", *ties], width, {"_seen": ("last", "_a")})
    first = trace.groupBy(*keys).agg(F.min_by("activity", F.struct("sample", *ties)).alias("_first"))
    out = filled.filter("_side = 1").join(first, list(keys), "left")
    activity = F.coalesce(F.col("_seen"), F.col("_first"))
    restored = out.select(*keys, *[F.col(f"_row.{n}").alias(n) for n in names], activity.alias("_activity"))
    mode = F.when(known | F.col("_activity").isNull(), F.col("scene_mode")).when(
        F.col("_activity") < cutoff, "quiet").otherwise("busy")
    return restored.withColumn("scene_mode", mode).drop("_activity")


def background_activity(trace: DataFrame, truth: DataFrame, guard: int, width: int,
                        keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Trace rows farther than ``guard`` (strictly) from every labelled onset."""
    marks = truth.select(*keys, F.col("onset_sample").alias("sample"))
    checked = nearest_within(trace, marks, keys, "sample", guard, width)
    return checked.filter(~is_near()).drop("near_prev", "near_next")


def unmatched(rows: DataFrame, pairs: DataFrame, ident: str) -> DataFrame:
    return rows.join(pairs.select(ident), ident, "left_anti")


def duplicate_predictions(truth: DataFrame, pred: DataFrame, pairs: DataFrame, tol: int, width: int,
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """Unmatched detections within ``tol`` of a label that already has its detection."""
    taken = pairs.select(*keys, F.col("truth_pos").alias("onset_sample"))
    checked = nearest_within(unmatched(pred, pairs, "pred_id"), taken, keys, "onset_sample", tol, width)
    return checked.filter(is_near()).drop("near_prev", "near_next")


def error_events(truth: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Misses and false alarms, tagged."""
    columns = ["session_id", "class", "onset_sample"]
    missed = unmatched(truth, pairs, "truth_id").select(*columns, F.col("truth_id").alias("event_id"),
                                                        F.lit("miss").alias("kind"))
    false = unmatched(pred, pairs, "pred_id").select(*columns, F.col("pred_id").alias("event_id"),
                                                     F.lit("false_positive").alias("kind"))
    return missed.unionByName(false)


def overlap_flags(events: DataFrame, width: int, keys: Sequence[str] = ("session_id",),
                  start: str = "onset_sample", end: str = "end_sample", ident: str = "event_id") -> DataFrame:
    """Flag events whose half-open interval meets another one of the same key."""
    latest = running(events, keys, start, [ident], width, {"_reach": ("max", end)}, include_current=False)
    both = edge_window(latest, keys, start, [ident], width, 1,
                       lambda w: {"_next": F.lead(start).over(w)})
    hit = (F.col("_reach") > F.col(start)) | (F.col("_next") < F.col(end))
    return both.withColumn("overlapping", F.coalesce(hit, F.lit(False))).drop("_reach", "_next")
