"""Direction estimates: decoding track vectors, assigning them to truth, and scoring them.

Sizes inside a scene are fixed (few classes, three tracks), so all of it is arithmetic on the row; only
the report aggregates shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlake import params
from soundlake.functions import geometry as g
from soundlake.operators.metrics import f1, ratio
from soundlake.operators.quantiles import exact_quantile
from soundlake.session import cut_lineage

ANGLE_SLICE = 0.05     # degrees per sorted slice when taking exact quantiles of errors


SOURCE_TYPE = ("array<struct<cls:int,track:int,azimuth:double,elevation:double,confidence:double,"
               "x:double,y:double,z:double>>")


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    cosine = (a * b).sum(axis=-1) / np.where(lengths > 0, lengths, 1.0)
    return np.where(lengths > 1e-18, np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0))), 180.0)


def _merge_close(vectors: np.ndarray, strength: np.ndarray, on: np.ndarray, merge_degrees: float):
    """Fold the tracks of all rows and classes at once; returns slot vectors, confidences and tracks
    (-1 where a slot is free), each over [row, class, slot]."""
    slot_v, slot_c = np.zeros_like(vectors), np.zeros_like(strength)
    slot_t = np.full(strength.shape, -1)
    for track in range(vectors.shape[2]):
        v, c = vectors[:, :, track], strength[:, :, track]
        open_row = on[:, :, track].copy()
        for slot in range(track):
            held = slot_v[:, :, slot]
            hit = open_row & (slot_t[:, :, slot] >= 0) & (_angles(v, held) < merge_degrees)
            joined = held * slot_c[:, :, slot, None] + v * c[..., None]
            slot_v[:, :, slot] = np.where(hit[..., None], joined, held)
            slot_c[:, :, slot] = np.where(hit, np.maximum(slot_c[:, :, slot], c), slot_c[:, :, slot])
            open_row &= ~hit
        rows, classes = np.nonzero(open_row)
        free = (slot_t[rows, classes] >= 0).sum(axis=1)
        slot_v[rows, classes, free], slot_c[rows, classes, free] = v[rows, classes], c[rows, classes]
        slot_t[rows, classes, free] = track
    return slot_v, slot_c, slot_t


def decode_tracks(scenes: DataFrame, tracks: str, thresholds: Sequence[Column | float], enabled: Column | None = None,
                  out: str = "sources", merge_degrees: float = params.DUPLICATE_MERGE_DEGREES,
                  maximum: int = params.MAX_SOURCES,
                  bounds: tuple[float, float] = params.ELEVATION_BOUNDS) -> DataFrame:
    """[class][track][xyz] to at most ``maximum`` sources per row, strongest first.

    A vector closer than ``merge_degrees`` to an earlier one of its class is merged into it: the
    confidence-weighted sum of both (not renormalised, so weights compound) with the larger confidence.
    ``enabled`` is a bit mask of classes.  One vectorised pass per Arrow batch: the optimizer would repeat
    a chain of column expressions of this depth many times over.
    """
    count = len(thresholds)

    @F.arrow_udf(SOURCE_TYPE)
    def decode(flat: pa.Array, limits: pa.Array, mask: pa.Array) -> pa.Array:
        rows = len(flat)
        vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, count, -1, 3).astype(np.float64)
        levels = limits.flatten().to_numpy(zero_copy_only=False).reshape(rows, count, 1)
        bits = mask.to_numpy(zero_copy_only=False).astype(np.int64)[:, None, None] >> np.arange(count)[None, :, None]
        size = np.linalg.norm(vectors, axis=-1)
        usable = np.isfinite(size) & (size > 1e-9)
        strength = np.where(usable, np.minimum(size, 1.0), 0.0)
        on = (strength >= levels) & (bits & 1 == 1) & usable
        v, c, t = _merge_close(vectors, strength, on, merge_degrees)
        width = count * v.shape[2]
        v, c, t = v.reshape(rows, width, 3), c.reshape(rows, width), t.reshape(rows, width)
        best = np.argsort(np.where(t >= 0, -c, np.inf), axis=1, kind="stable")[:, :maximum]
        v = np.take_along_axis(v, best[..., None], axis=1)
        c, t = np.take_along_axis(c, best, axis=1), np.take_along_axis(t, best, axis=1)
        used = t >= 0
        azimuth = np.degrees(np.arctan2(v[..., 0], v[..., 2])) % 360.0
        azimuth = np.where(azimuth >= 360.0, 0.0, azimuth)
        elevation = np.clip(np.degrees(np.arctan2(v[..., 1], np.hypot(v[..., 0], v[..., 2]))), *bounds)
        az, el = np.radians(azimuth), np.radians(elevation)
        columns = {"cls": (best // 3).astype(np.int32), "track": t.astype(np.int32), "azimuth": azimuth,
                   "elevation": elevation, "confidence": c, "x": np.cos(el) * np.sin(az), "y": np.sin(el),
                   "z": np.cos(el) * np.cos(az)}
        values = pa.StructArray.from_arrays([pa.array(x[used]) for x in columns.values()], list(columns))
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values)

    limits = F.array(*[(t if isinstance(t, Column) else F.lit(float(t))).cast("double") for t in thresholds])
    mask = F.lit((1 << count) - 1) if enabled is None else enabled
    flat = F.transform(F.flatten(F.flatten(tracks)), lambda x: x.cast("double"))
    # Not deterministic in name only: it keeps a filter on the result from running the decoder twice.
    return scenes.withColumn(out, decode.asNondeterministic()(flat, limits, mask.cast("int")))


def truth_list(truth: str, classes: int, minimum: float = 0.5) -> Column:
    """[class][track][xyz] targets as a list of (cls, x, y, z, n), present where the norm exceeds ``minimum``."""
    listed = []
    for c, t in itertools.product(range(classes), range(params.TRACKS)):
        at = [f"cast({truth}[{c}][{t}][{i}] as double)" for i in range(3)]
        listed.append(f"named_struct('cls', {c}, 'x', {at[0]}, 'y', {at[1]}, 'z', {at[2]}, "
                      f"'n', sqrt({' + '.join(f'{x} * {x}' for x in at)}))")
    return F.expr(f"filter(array({', '.join(listed)}), t -> t.n > {minimum})")


def truth_tensor(targets: Column, classes: Sequence[str]) -> Column:
    """Targets (class, azimuth, elevation) to [class][track][xyz] in order of appearance; NULL when a
    class has more targets than tracks or a target has an unknown class."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def one(name: str) -> Column:
        mine = F.transform(F.filter(targets, lambda t: t["sound_class"] == F.lit(name)), lambda t: g.direction_vector(
            t["rendered_direction"]["azimuth_degrees"], t["rendered_direction"]["elevation_degrees"]))
        return F.slice(F.concat(mine, F.array_repeat(zero, params.TRACKS)), 1, params.TRACKS)

    def count(name: str) -> Column:
        return F.size(F.filter(targets, lambda t: t["sound_class"] == F.lit(name)))
    known = F.forall(targets, lambda t: t["sound_class"].isin(*classes))
    fits = F.greatest(*[count(n) for n in classes], F.lit(0)) <= params.TRACKS
    return F.when(known & fits, F.array(*[one(n) for n in classes]))


def _assignments() -> str:
    """SQL MAP(10 * predictions + truths -> all injective pairings of the smaller side), for sizes up to 3."""
    entries = []
    for p, t in itertools.product(range(1, params.TRACKS + 1), repeat=2):
        pairings = []
        for chosen in itertools.permutations(range(max(p, t)), min(p, t)):
            pairs = [(i, j) if p <= t else (j, i) for i, j in enumerate(chosen)]
            pairings.append("array(%s)" % ", ".join(f"named_struct('p', {a}, 't', {b})" for a, b in pairs))
        entries.append(f"{10 * p + t}, array({', '.join(pairings)})")
    return f"map({', '.join(entries)})"


ANGLE = ("if(t.n <= 1e-9, 180D, degrees(acos(greatest(-1D, least(1D, "
         "(s.x * t.x + s.y * t.y + s.z * t.z) / t.n)))))")


def class_pairs(scenes: DataFrame, classes: int) -> DataFrame:
    """One row per scene and class with both sides (``p``, ``t``), their error matrix
    ``err[prediction][truth]`` and all pairings of the smaller side."""
    rows = scenes.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    rows = rows.withColumns({"p": F.expr("filter(sources, s -> s.cls = cls)"),
                             "t": F.expr("filter(truths, t -> t.cls = cls)")})
    return rows.withColumns({
        "err": F.expr(f"transform(p, s -> transform(t, t -> {ANGLE}))"),
        "options": F.expr(f"{_assignments()}[10 * size(p) + size(t)]")})


BEST_ASSIGNMENT = """array_min(transform(options, (pairing, i) -> named_struct(
  'total', aggregate(pairing, 0D, (total, m) -> total + err[m.p][m.t]), 'ord', i, 'pairing', pairing))).pairing"""


MATCH = """named_struct('error', err[m.p][m.t],
  'elevation_error', abs(p[m.p].elevation - degrees(atan2(t[m.t].y, hypot(t[m.t].x, t[m.t].z)))),
  'confidence', p[m.p].confidence)"""


def assign_directions(scenes: DataFrame, classes: int, keep: Sequence[str] = ("scene_id",)) -> DataFrame:
    """The injective assignment of least total error per class (the first one among equals):
    error, elevation error and confidence of each matched pair."""
    best = class_pairs(scenes, classes).withColumn("best", F.expr(BEST_ASSIGNMENT))
    rows = best.select(*keep, "cls", "p", "t", "err", F.explode("best").alias("m"))
    return rows.select(*keep, "cls", F.col("m.p").alias("prediction"), F.col("m.t").alias("truth"),
                       F.expr(MATCH).alias("x")).select(*keep, "cls", "prediction", "truth", "x.*")


def count_within(cutoff: float) -> Column:
    """Largest number of disjoint pairs with an error up to ``cutoff``, over ``class_pairs`` rows."""
    return F.expr("coalesce(array_max(transform(options, pairing -> size(filter(pairing, "
                  f"m -> err[m.p][m.t] <= {float(cutoff)}D)))), 0)")


def greedy_matches(sources: str = "sources", truths: str = "truths") -> Column:
    """Strongest prediction first, each takes the nearest remaining truth of its class."""
    nearest = f"""array_min(transform(filter(transform({truths}, (t, i) -> named_struct('t', t, 'i', i)),
        c -> c.t.cls = s.cls and not exists(acc, a -> a.i = c.i)),
      c -> named_struct('error', {ANGLE.replace('t.', 'c.t.')}, 'i', c.i)))"""
    empty = "cast(array() as array<struct<confidence:double,error:double,i:int>>)"
    return F.expr(f"""aggregate({sources}, {empty}, (acc, s) -> concat(acc, transform(
      filter(array({nearest}), best -> best is not null),
      best -> named_struct('confidence', s.confidence, 'error', best.error, 'i', best.i))))""")


def scene_outcomes(scenes: DataFrame, classes: int, keep: Sequence[str]) -> DataFrame:
    """Per scene and class: how many estimates lie within 20 and 30 degrees of a truth."""
    return class_pairs(scenes, classes).select(*keep, "cls", count_within(20.0).alias("w20"),
                                               count_within(30.0).alias("w30"))


def direction_metrics(scenes: DataFrame, classes: int, *, id_col: str = "scene_id",
                      close: str = "close-15-30") -> DataFrame:
    """One report row over decoded scenes (``sources``, ``truths``, ``target_count``, ``stratum`` and,
    where present, ``room``, ``capture_session``, ``profile``)."""
    c = F.col
    is_close = c("stratum") == close
    # One pass decodes and assigns; the report reads the written outcomes.
    outcomes = cut_lineage(class_pairs(scenes, classes).withColumn("best", F.expr(BEST_ASSIGNMENT)).select(
        id_col, "stratum", count_within(20.0).alias("w20"), count_within(30.0).alias("w30"),
        F.expr(f"transform(best, m -> {MATCH})").alias("matches")))
    within = outcomes.agg(
        F.coalesce(F.sum("w20"), F.lit(0)).alias("w20"), F.coalesce(F.sum("w30"), F.lit(0)).alias("w30"))
    exact = F.size("sources") == F.size("truths")

    def optional(name: str) -> Column:
        return c(name) if name in scenes.columns else F.lit(None).cast("string")
    bands = F.transform("truths", lambda t: g.elevation_band(F.degrees(F.atan2(t["y"], F.hypot(t["x"], t["z"])))))

    def mean_if(cond, value):
        return F.coalesce(F.avg(F.when(cond, value.cast("double"))), F.lit(0.0))
    base = scenes.agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.count_if(c("target_count") == 2).alias("two_source_support"),
        F.count_if(c("target_count") == 3).alias("three_source_support"),
        F.count_distinct(F.nullif(optional("room"), F.lit(""))).alias("room_count"),
        F.count_distinct(F.nullif(optional("capture_session"), F.lit(""))).alias("capture_session_count"),
        F.count_distinct(optional("profile")).alias("profile_count"),
        *[F.max(F.array_contains(bands, b).cast("int")).alias(f"_{b}") for b in ("down", "level", "up")],
        mean_if(F.lit(True), exact).alias("exact_count_accuracy"),
        mean_if(c("target_count") == 2, exact).alias("exact_two"),
        mean_if(c("target_count") == 3, exact).alias("exact_three"),
        mean_if(is_close, exact).alias("close_exact"),
        F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("_pred"),
        F.coalesce(F.sum(F.size("truths")), F.lit(0)).alias("_truth"))
    matches = outcomes.select(id_col, "stratum", F.explode("matches").alias("m")).select(id_col, "stratum", "m.*")
    strong = c("confidence") >= 0.8
    counts = matches.agg(F.count_if(strong).alias("_strong"), F.count_if(strong & (c("error") > 45.0)).alias("_bad"))
    error = exact_quantile(matches, "error", {"median_error": 0.5, "p90_error": 0.9}, ANGLE_SLICE)
    elevation = exact_quantile(matches, "elevation_error", {"p90_elevation_error": 0.9}, ANGLE_SLICE)
    near = exact_quantile(matches.filter(is_close), "error", {"close_p90_error": 0.9}, ANGLE_SLICE)
    row = base
    for part in (within, counts, error, elevation, near):
        row = row.crossJoin(F.broadcast(part))
    p20, r20 = ratio(c("w20"), c("_pred")), ratio(c("w20"), c("_truth"))
    p30, r30 = ratio(c("w30"), c("_pred")), ratio(c("w30"), c("_truth"))
    worst = lambda n: F.coalesce(c(n), F.lit(180.0)).alias(n)
    return row.select(
        "scene_count", "two_source_support", "three_source_support", "room_count", "capture_session_count",
        (F.coalesce(c("_down"), F.lit(0)) + F.coalesce(c("_level"), F.lit(0)) + F.coalesce(c("_up"), F.lit(0)))
        .alias("elevation_band_count"), "profile_count",
        "exact_count_accuracy", "exact_two", "exact_three", "close_exact",
        p20.alias("precision_20"), r20.alias("recall_20"), f1(p20, r20).alias("f1_20"),
        p30.alias("precision_30"), r30.alias("recall_30"), f1(p30, r30).alias("f1_30"),
        worst("median_error"), worst("p90_error"), worst("p90_elevation_error"), worst("close_p90_error"),
        ratio(c("_bad"), c("_strong")).alias("catastrophic_rate"))


def latency_p95(scenes: DataFrame, column: str) -> DataFrame:
    return exact_quantile(scenes, column, {column: 0.95}, 0.05)


def direction_gates(metrics: DataFrame, kind: str, p95_inference_ms: Column | float = 0.0,
                    p95_processing_ms: Column | float | None = None,
                    disabled_rate: Column | float = 0.0) -> DataFrame:
    """Acceptance of a metrics row: ``synthetic`` or ``real``."""
    c = F.col
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    inference, disabled = as_col(p95_inference_ms), as_col(disabled_rate)
    processing = inference if p95_processing_ms is None else as_col(p95_processing_ms)
    window_ms = (params.SCENE_SAMPLES - params.SCENE_PRE_ANCHOR) * 1000.0 / params.SAMPLE_RATE
    delivery = window_ms + processing
    if kind == "synthetic":
        terms = [c("exact_count_accuracy") >= 0.90, c("exact_two") >= 0.85, c("exact_three") >= 0.85,
                 c("precision_20") >= 0.90, c("recall_20") >= 0.90, c("f1_20") >= 0.90, c("median_error") <= 10.0,
                 c("p90_error") <= 20.0, c("close_exact") >= 0.75, c("close_p90_error") <= 15.0,
                 c("catastrophic_rate") < 0.01, disabled < 0.02]
    elif kind == "real":
        terms = [c("scene_count") >= 1200, c("two_source_support") >= 200, c("three_source_support") >= 200,
                 c("room_count") >= 3, c("capture_session_count") >= 3, c("elevation_band_count") >= 3,
                 c("profile_count") == 1, c("exact_count_accuracy") >= 0.80, c("exact_two") >= 0.75,
                 c("exact_three") >= 0.75, c("f1_30") >= 0.80, c("median_error") <= 15.0, c("p90_error") <= 30.0,
                 c("p90_elevation_error") <= 25.0, disabled < 0.05, inference <= 15.0, delivery <= 300.0]
    else:
        raise ValueError("kind must be synthetic or real")
    accepted = terms[0]
    for term in terms[1:]:
        accepted = accepted & term
    return metrics.withColumn("terms_passed", sum((F.when(t, 1).otherwise(0) for t in terms), F.lit(0))) \
        .withColumn("accepted", accepted).withColumn("delivery_ms", delivery)


def pairwise_separation(scenes: DataFrame, truths: str = "truths", keep: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Angle of every i < j pair of a scene's targets."""
    dot = "(s.x * t.x + s.y * t.y + s.z * t.z) / (s.n * t.n)"
    pairs = F.expr(f"""flatten(transform({truths}, (s, i) -> transform(slice({truths}, i + 2, size({truths})),
      (t, j) -> named_struct('i', i, 'j', i + 1 + j, 'separation',
        degrees(acos(greatest(-1D, least(1D, {dot}))))))))""")
    return scenes.select(*keep, F.explode(pairs).alias("pair")).select(*keep, "pair.*")


def close_pair_check(scenes: DataFrame, truths: str = "truths", keep: Sequence[str] = ("scene_id",),
                     minimum: float = params.MIN_SEPARATION_DEGREES, maximum: float = params.CLOSE_MAX_DEGREES
                     ) -> DataFrame:
    """Per scene with two or more targets: closest pair, separated at all, and close enough to be ``close``."""
    closest = pairwise_separation(scenes, truths, keep).groupBy(*keep).agg(F.min("separation").alias("closest"))
    return closest.withColumns({"separated": F.col("closest") >= minimum - 1e-6,
                                "is_close": (F.col("closest") >= minimum - 1e-6)
                                & (F.col("closest") <= maximum + 1e-6)})


def activity_counts(scenes: DataFrame, tracks: str, truths: str, classes: int, grid: Sequence[float]) -> DataFrame:
    """Per class and threshold: true/false positives and misses of source *counts*."""
    steps = ", ".join(f"named_struct('ord', {i}, 'threshold', {float(x)!r}D)" for i, x in enumerate(grid))
    rows = scenes.select(F.explode(F.expr(
        f"transform(sequence(0, {classes - 1}), k -> named_struct('cls', k, 'tracks', array({tracks}[k]), "
        f"'present', size(filter({truths}, t -> t.cls = k))))")).alias("r")).select("r.*")
    rows = rows.select("cls", "tracks", "present", F.explode(F.expr(f"array({steps})")).alias("g")).select(
        "cls", "tracks", "present", "g.*")
    counted = decode_tracks(rows, "tracks", [F.col("threshold")]).withColumn("predicted", F.size("sources"))
    hit = F.least("present", "predicted")
    return counted.groupBy("cls", "ord", "threshold").agg(
        F.sum(hit).alias("tp"), F.sum(F.col("predicted") - hit).alias("fp"), F.sum(F.col("present") - hit).alias("fn"))


def calibrate_activity(counts: DataFrame) -> DataFrame:
    """Threshold per class with the best count F1, slightly preferring the middle; first among equals."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    score = f1(ratio(tp, tp + fp), ratio(tp, tp + fn)) - 0.02 * F.abs(F.col("threshold") - 0.5)
    return (counts.withColumn("score", score).groupBy("cls")
            .agg(F.max_by("threshold", F.struct("score", -F.col("ord"))).alias("threshold"),
                 F.max("score").alias("score")))


def uncertainty_table(matches: DataFrame, edges: Sequence[float]) -> DataFrame:
    """p90 error of the matches at least as confident as each edge, never widening with confidence."""
    spark = matches.sparkSession
    steps = spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "ord int, edge double")
    per_edge = matches.select("error", F.explode(F.filter(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(float(e)).alias("edge")) for i, e in enumerate(edges)]),
        lambda s: F.col("confidence") >= s["edge"])).alias("s")).select("error", "s.ord")
    p90 = exact_quantile(per_edge, "error", {"p90": 0.9}, ANGLE_SLICE, by=["ord"])
    filled = steps.join(p90, "ord", "left").withColumn("p90", F.coalesce("p90", F.lit(180.0)))
    narrowing = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("ord", F.col("edge").alias("confidence"), F.min("p90").over(narrowing).alias("p90"))


def _active_options(tracks: int = params.TRACKS) -> list[list[tuple[int, ...]]]:
    """Ways to spread 0..3 active targets over the tracks so that each is used at least once."""
    return [[()], *[[m for m in itertools.product(range(n), repeat=tracks) if len(set(m)) == n]
                    for n in range(1, tracks + 1)]]


def adpit_loss(pred: str, truth: str, classes: int) -> Column:
    """Mean over classes of the least mean-square distance to any assignment of the active targets.

    Squared distances of every (track, target) are formed once; each assignment is a sum of three.
    """
    losses = []
    for k in range(classes):
        cost = f"transform({pred}[{k}], p -> transform(goals, g -> {' + '.join(f'(p[{i}] - g[{i}]) * (p[{i}] - g[{i}])' for i in range(3))}))"
        cases = []
        for count, options in enumerate(_active_options()):
            sums = [" + ".join(f"d[{t}][{option[t] if option else 0}]" for t in range(params.TRACKS)) for option in options]
            least = f"least({', '.join(sums)})" if len(sums) > 1 else sums[0]
            cases.append(f"when {count} then {least}")
        active = f"filter({truth}[{k}], v -> sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) > 1e-6)"
        # ``transform(array(x), name -> ...)[0]`` names an intermediate value inside one expression.
        losses.append(f"""transform(array({active}), active -> transform(array(if(size(active) = 0, array(array(0D, 0D, 0D)), active)),
          goals -> transform(array({cost}), d -> case size(active) {' '.join(cases)} end / {3.0 * params.TRACKS})[0])[0])[0]""")
    return F.expr(f"({' + '.join(losses)}) / {float(classes)}")


def mean_adpit_loss(scenes: DataFrame, pred: str, truth: str, classes: int, weight: Column | None = None) -> DataFrame:
    """Loss over all scenes, one row: the mean, or with ``weight`` the weighted mean (weights that sum to nothing give 0)."""
    rows = scenes.select(adpit_loss(pred, truth, classes).alias("_loss"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))
    total = F.coalesce(F.sum("_w"), F.lit(0.0))
    loss = F.coalesce(F.sum(F.col("_loss") * F.col("_w")), F.lit(0.0)) / F.greatest(total, F.lit(1e-12))
    return rows.agg(F.count(F.lit(1)).alias("scene_count"), total.alias("total_weight"), loss.alias("loss"))
