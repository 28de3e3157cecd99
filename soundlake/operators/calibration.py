"""Choosing thresholds, offsets and cutoffs from labelled traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators import matching, peaks
from soundlake.operators.metrics import ratio
from soundlake.operators.ordered import running
from soundlake.operators.quantiles import exact_quantile
from soundlake.session import cut_lineage


def scene_cutoff(trace: DataFrame, truth: DataFrame, guard: int, width: int, quantile: float = 0.6,
                 low: float = 0.05, high: float = 0.95, default: float = 0.35) -> DataFrame:
    """Quiet/busy boundary: clipped quantile of the activity away from all labels."""
    background = matching.background_activity(trace, truth, guard, width)
    found = exact_quantile(background, "activity", {"cutoff": quantile}, 1e-3)
    held = F.greatest(F.lit(low), F.least(F.lit(high), F.col("cutoff")))
    return found.select(F.coalesce(held, F.lit(default)).alias("cutoff"))


def threshold_pairs(values: Sequence[float], split_classes: Sequence[str], classes: Sequence[str]) -> list[tuple]:
    """(class, ord, quiet, busy): equal thresholds, or busy >= quiet for the classes in ``split_classes``."""
    rows = []
    for name in classes:
        pairs = ([(q, b) for q in values for b in values if b >= q] if name in split_classes
                 else [(q, q) for q in values])
        rows += [(name, i, float(q), float(b)) for i, (q, b) in enumerate(pairs)]
    return rows


def threshold_grid(maxima: DataFrame, grid: DataFrame, cutoff: float) -> DataFrame:
    """Every local maximum with each grid entry it passes.  The grid is a fixed small table; the maxima do
    not depend on it and were found once."""
    passed = peaks.over_threshold(cutoff, F.col("quiet"), F.col("busy"))
    named = F.broadcast(grid.withColumnRenamed("class", "_class"))
    return maxima.join(named, (F.col("class") == F.col("_class")) & passed).drop("_class")


def sweep_levels(grid: DataFrame) -> DataFrame:
    """One row per class: its rising distinct quiet and busy thresholds and its entries as pairs of places in them."""
    sides = {side: F.sort_array(F.collect_set(side)) for side in ("quiet", "busy")}
    values = grid.groupBy("class").agg(*[v.alias(f"{side}_values") for side, v in sides.items()])
    places = [(F.array_position(f"{side}_values", F.col(side)) - 1).cast("int").alias(side) for side in sides]
    return grid.join(values, "class").groupBy("class", "quiet_values", "busy_values").agg(
        F.collect_set(F.struct(*places)).alias("entries"))


def sweep_variants(rows: DataFrame, levels: DataFrame, apart: int, width: int) -> DataFrame:
    """Candidates and labels, once for each distinct candidate set that the grid makes of their stretch.

    ``rows`` has session_id, class, ``sample``, ``level`` (the highest place in its state's thresholds a candidate passes; null
    for labels) and ``quiet``.  A stretch ends where the next row is more than ``apart`` away, so nothing in it can meet rows
    outside.  In it all thresholds between two levels that occur select the same candidates: ``q_high`` and ``b_high`` name
    the lowest level that still passes, ``q_low`` and ``b_low`` the lowest threshold that stands for it.  Sets without candidates are left
    out.  A row is copied as often as its stretch has distinct sets, at most once per grid entry.
    """
    keys = ["session_id", "class"]
    known = running(rows, keys, "sample", [], width, {"_before": ("max", "sample")}, include_current=False)
    fresh = F.col("_before").isNull() | (F.col("sample") - F.col("_before") > apart)
    marked = running(known.withColumn("_fresh", F.when(fresh, F.col("sample"))), keys, "sample", [], width,
                     {"_stretch": ("max", "_fresh")}).drop("_before", "_fresh")

    def occurring(quiet):
        return F.sort_array(F.collect_set(F.when(F.col("level").isNotNull() & (F.col("quiet") == quiet), F.col("level"))))
    found = marked.groupBy(*keys, "_stretch").agg(occurring(True).alias("q"), occurring(False).alias("b")).filter("size(q) + size(b) > 0")

    def bounds(side, place, count):
        high = F.coalesce(F.array_min(F.filter(side, lambda x: x >= place)), count)
        low = F.coalesce(F.array_max(F.filter(side, lambda x: x < place)) + 1, F.lit(0))
        return low, high

    def variant(entry):
        q_low, q_high = bounds("q", entry["quiet"], F.size("quiet_values"))
        b_low, b_high = bounds("b", entry["busy"], F.size("busy_values"))
        return F.struct(q_low.alias("q_low"), q_high.alias("q_high"), b_low.alias("b_low"), b_high.alias("b_high"))
    sets = found.join(F.broadcast(levels), "class").select(
        *keys, "_stretch", F.array_distinct(F.transform("entries", variant)).alias("sets"),
        F.size("quiet_values").alias("_nq"), F.size("busy_values").alias("_nb"))
    copies = marked.join(sets, [*keys, "_stretch"]).withColumn("_set", F.explode("sets")).select(
        *[c for c in marked.columns if c != "_stretch"], "_set.*", "_nq", "_nb")
    chosen = (F.col("q_high") < F.col("_nq")) | (F.col("b_high") < F.col("_nb"))
    passed = F.col("level") >= F.when(F.col("quiet"), F.col("q_high")).otherwise(F.col("b_high"))
    return copies.filter(chosen & (F.col("level").isNull() | passed)).drop("_nq", "_nb")


def sweep_counts(trace: DataFrame, truth: DataFrame, grid: DataFrame, *, cutoff: float, lookahead: int, spacing: int,
                 tol: int, width: int, ties: Sequence[str] = ("event_id",), minutes_per_unit: float) -> DataFrame:
    """Per class and grid entry: hits, false alarms, misses, and false alarms in sessions without targets.

    ``truth`` has ``truth_id`` and ``onset_sample``; trace rows carry a unique BIGINT ``event_id``.  Spacing and matching
    run once per distinct candidate set of a stretch (``sweep_variants``), not once per grid entry: labels far from any
    candidate are not copied at all, and a stretch with one candidate is matched once.  Counts go to the
    entries by ranges of thresholds, summed before they meet the grid.  Ids times the number of entries must fit a BIGINT.
    """
    ranges = ("q_low", "q_high", "b_low", "b_high")
    keys = ("session_id", "class", *ranges)
    levels = cut_lineage(sweep_levels(grid))
    quiet = F.coalesce(F.col("activity") < cutoff, F.lit(False))
    below = F.size(F.filter(F.when(quiet, F.col("quiet_values")).otherwise(F.col("busy_values")), lambda x: x <= F.col("probability")))
    maxima = (peaks.local_maxima(trace, lookahead, width, ties=ties).join(F.broadcast(levels), "class")
              .withColumns({"quiet": quiet, "level": below - 1}).filter("level >= 0"))
    carried = list(dict.fromkeys(["probability", "event_id", *ties]))
    candidates = maxima.select("session_id", "class", F.col("sample").cast("bigint").alias("sample"), "quiet", "level", *carried)
    wanted = truth.select("session_id", "class", F.col("onset_sample").cast("bigint").alias("sample"), "truth_id")
    rows = sweep_variants(candidates.unionByName(wanted, allowMissingColumns=True), levels, max(spacing, tol), width)
    rows = cut_lineage(rows)
    passed = rows.filter("level is not null").select(*keys, "sample", *carried)
    kept = cut_lineage(peaks.min_spacing(passed, spacing, width, keys, ties))
    step = levels.agg(F.max((F.size("quiet_values") + 1) * (F.size("busy_values") + 1))).first()[0] or 1
    wide = levels.agg(F.max(F.size("busy_values") + 1)).first()[0] or 1
    # ids repeat per candidate set, so they are made unique for matching; the original ids order ties
    unique = lambda name: F.col(name) * step + F.col("q_high") * wide + F.col("b_high")
    preds = kept.select(*keys, F.col("sample").alias("onset_sample"), F.col("event_id").alias("pred_id"))
    labels = rows.filter("level is null").select(*keys, F.col("sample").alias("onset_sample"), "truth_id")
    pairs = matching.match_events(
        labels.withColumn("uid", unique("truth_id")), preds.withColumn("pid", unique("pred_id")),
        tol, keys=keys, truth_id="uid", pred_id="pid", truth_order="truth_id", pred_order="pred_id", width=width)
    with_targets = truth.select("session_id").distinct().withColumn("_has", F.lit(True))
    lengths = (trace.groupBy("session_id").agg(F.max("sample").alias("last")).join(with_targets, "session_id", "left")
               .agg(F.sum(F.col("last") * minutes_per_unit).alias("total_minutes"),
                    F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("last") * minutes_per_unit)), F.lit(0.0))
                    .alias("ambient_minutes")))
    given = preds.groupBy("session_id", "class", *ranges).agg(F.count(F.lit(1)).alias("n")).join(with_targets, "session_id", "left")
    none = F.lit(0).cast("bigint")
    summed = (pairs.groupBy("class", *ranges).agg(F.count(F.lit(1)).alias("tp"), F.first(none).alias("predicted"), F.first(none).alias("ambient_fp"))
              .unionByName(given.groupBy("class", *ranges).agg(
                  F.first(none).alias("tp"), F.sum("n").alias("predicted"),
                  F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("n"))), none).alias("ambient_fp"))))
    placed = grid.join(F.broadcast(levels), "class").select(
        "class", "ord", *[(F.array_position(f"{side}_values", F.col(side)) - 1).alias(f"_{side}") for side in ("quiet", "busy")])
    hits = placed.join(summed, "class").filter("_quiet between q_low and q_high and _busy between b_low and b_high").groupBy("class", "ord").agg(
        *[F.sum(c).alias(c) for c in ("tp", "predicted", "ambient_fp")])
    totals = truth.groupBy("class").agg(F.count(F.lit(1)).alias("labels"))
    counted = (grid.join(hits, ["class", "ord"], "left").join(totals, "class", "left")
               .fillna(0, ["tp", "predicted", "ambient_fp", "labels"]).crossJoin(F.broadcast(lengths)))
    return counted.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("labels") - F.col("tp")})


def calibrate_thresholds(counts: DataFrame, ambient_limit: float = 0.1, overall_limit: float = 2.0) -> DataFrame:
    """Best pair per class: feasible first, then least violation, recall, precision, fewest alarms; the
    first grid entry among equals."""
    c = F.col
    floor = F.lit(1e-12)
    rated = counts.withColumns({
        "recall": ratio(c("tp"), c("tp") + c("fn")), "precision": ratio(c("tp"), c("tp") + c("fp")),
        "ambient_rate": c("ambient_fp") / F.greatest(c("ambient_minutes"), floor),
        "overall_rate": c("fp") / F.greatest(c("total_minutes"), floor)})
    zero = F.lit(0.0)
    violation = (F.greatest(zero, c("ambient_rate") - ambient_limit)
                 + F.greatest(zero, c("overall_rate") - overall_limit))
    feasible = (c("ambient_rate") <= ambient_limit) & (c("overall_rate") <= overall_limit)
    score = F.struct(feasible.alias("feasible"), (-violation).alias("v"), c("recall").alias("r"),
                     c("precision").alias("p"), (-(c("ambient_rate") + c("overall_rate"))).alias("a"), (-c("ord")).alias("o"))
    best = rated.groupBy("class").agg(F.max_by(F.struct("quiet", "busy", "recall", "precision"), score).alias("b"))
    return best.select("class", "b.*")


def calibrate_onset_offset(pairs: DataFrame, maximum: int = params.MATCH_TOLERANCE,
                           default: int = params.FFT_SIZE // 2, classes: Sequence[str] | None = None) -> DataFrame:
    """Median lead of detections over labels per class, truncated and held in [0, maximum].  Differences
    are whole and bounded by the tolerance, so the distinct values stay few.  With ``classes``, each of them has a row:
    one without pairs gets the default."""
    median = F.percentile(F.col("pred_pos") - F.col("truth_pos"), 0.5)
    held = F.greatest(F.lit(0), F.least(F.lit(maximum), median.cast("int")))
    found = pairs.groupBy("class").agg(held.cast("bigint").alias("onset_offset"))
    if classes is not None:
        wanted = pairs.sparkSession.createDataFrame([(c,) for c in classes], "class string")
        found = wanted.join(found, "class", "left")
    return found.withColumn("onset_offset", F.coalesce("onset_offset", F.lit(default).cast("bigint")))


def calibrate_suppression(matched: DataFrame, grid: Sequence[float], loss_limit: float = 0.03,
                          default: float = 0.99) -> DataFrame:
    """Self-suppression threshold: most own events removed while losing at most ``loss_limit`` of remote
    ones.  ``matched`` has ``source_hint`` and ``p_self``; scores are counted per value before the sweep."""
    values = matched.filter(F.col("source_hint").isin("self", "remote")).groupBy("source_hint", "p_self").agg(
        F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.struct(F.lit(float(t)).alias("threshold")) for t in grid])
    swept = values.withColumn("g", F.explode(steps)).select("source_hint", "p_self", "n", "g.threshold")

    def rate(source):
        mine = F.col("source_hint") == source
        over = F.sum(F.when(mine & (F.col("p_self") >= F.col("threshold")), F.col("n")).otherwise(0))
        return F.coalesce(over / F.nullif(F.sum(F.when(mine, F.col("n")).otherwise(0)), F.lit(0)), F.lit(0.0))
    rates = swept.groupBy("threshold").agg(rate("self").alias("self_rate"), rate("remote").alias("remote_loss"))
    allowed = F.col("remote_loss") <= loss_limit
    best = rates.agg(F.max(F.when(allowed, F.struct(
        F.col("self_rate").alias("s"), (-F.col("remote_loss")).alias("l"), F.col("threshold").alias("threshold")))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(default)).alias("threshold"),
                       F.coalesce("b.s", F.lit(0.0)).alias("self_rate"), F.coalesce(-F.col("b.l"), F.lit(0.0)).alias("remote_loss"))
