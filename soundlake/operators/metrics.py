"""Detection quality: counts, rates, intervals and acceptance gates over matched pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators import matching
from soundlake.operators.ordered import edge_window, sorted_index


def wilson_interval(hits: Column, total: Column, z: float = params.WILSON_Z) -> tuple[Column, Column]:
    """95 % score interval; (0, 1) without observations."""
    n = F.when(total > 0, total.cast("double"))
    share, shrink = hits / n, 1.0 + z * z / n
    middle = (share + z * z / (2.0 * n)) / shrink
    margin = z * F.sqrt(share * (1.0 - share) / n + z * z / (4.0 * n * n)) / shrink
    low = F.coalesce(F.greatest(F.lit(0.0), middle - margin), F.lit(0.0))
    high = F.coalesce(F.least(F.lit(1.0), middle + margin), F.lit(1.0))
    return low, high


def ratio(top: Column, bottom: Column) -> Column:
    return top / F.greatest(F.lit(1), bottom)


def f1(precision: Column, recall: Column) -> Column:
    return 2.0 * precision * recall / F.greatest(F.lit(1e-12), precision + recall)


def class_domain(spark, classes: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in classes], "class string")


def joined_outcomes(truth: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per label and per unmatched detection: hit, miss or false alarm, with both positions."""
    outcome = (truth.select("session_id", "class", "truth_id", F.col("onset_sample").alias("t_pos"))
               .join(pairs.select("truth_id", "pred_id"), "truth_id", "left"))
    detections = pred.select("pred_id", F.col("session_id").alias("p_session"), F.col("class").alias("p_class"),
                             F.col("onset_sample").alias("p_pos"), F.col("detected_sample").alias("p_detected"))
    full = outcome.join(detections, "pred_id", "full")
    return full.select(
        F.coalesce("session_id", "p_session").alias("session_id"), F.coalesce("class", "p_class").alias("class"),
        "truth_id", "pred_id", "t_pos", "p_pos", "p_detected")


def detection_metrics(truth: DataFrame, pred: DataFrame, pairs: DataFrame, duration_seconds: Column | float,
                      classes: Sequence[str], rate: int = params.SAMPLE_RATE, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, false alarms per minute and position/latency quantiles per class.

    ``by`` adds leading group columns (for example the session).
    """
    rows = joined_outcomes(truth, pred, pairs)
    is_truth, has_pred = F.col("truth_id").isNotNull(), F.col("pred_id").isNotNull()
    hit = is_truth & has_pred
    error = F.when(hit, F.abs(F.col("p_pos") - F.col("t_pos")) * 1000.0 / rate)
    late = F.when(hit, (F.col("p_detected") - F.col("t_pos")) * 1000.0 / rate)
    halves = F.array(F.lit(0.5), F.lit(0.95))
    sums = rows.groupBy(*by, "class").agg(
        F.count_if(hit).alias("true_positives"), F.count_if(has_pred & ~is_truth).alias("false_positives"),
        F.count_if(is_truth & ~has_pred).alias("false_negatives"),
        F.percentile(error, halves).alias("_e"), F.percentile(late, halves).alias("_d"))
    domain = class_domain(rows.sparkSession, classes)
    if by:
        domain = rows.select(*by).distinct().crossJoin(F.broadcast(domain))
    filled = domain.join(sums, [*by, "class"], "left").fillna(
        0, ["true_positives", "false_positives", "false_negatives"])
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    duration = duration_seconds if isinstance(duration_seconds, Column) else F.lit(float(duration_seconds))
    out = filled.withColumns({"support": tp + fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    low, high = wilson_interval(tp, F.col("support"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *by, "class", "true_positives", "false_positives", "false_negatives", "precision", "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
        (fp * 60.0 / F.greatest(duration, F.lit(1e-12))).alias("false_alerts_per_minute"),
        zero(F.col("_e")[0]).alias("median_absolute_onset_error_ms"),
        zero(F.col("_e")[1]).alias("p95_absolute_onset_error_ms"),
        zero(F.col("_d")[0]).alias("median_delivery_latency_ms"),
        zero(F.col("_d")[1]).alias("p95_delivery_latency_ms"),
        "support", low.alias("recall_ci95_low"), high.alias("recall_ci95_high"),
        (F.col("support") >= 300).alias("conclusive"))


def with_hit(truth: DataFrame, pairs: DataFrame, name: str = "hit") -> DataFrame:
    found = pairs.select("truth_id", F.lit(True).alias(name))
    return truth.join(found, "truth_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def recall_subset(hits: DataFrame, subsets: dict[str, Column], classes: Sequence[str]) -> DataFrame:
    """Recall with interval per class for any number of label predicates, in one pass.

    ``hits`` is the label table after ``with_hit``: matching uses all labels, the predicate comes after.
    """
    aggs = []
    for name, cond in subsets.items():
        cond = F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(cond & F.col("hit")).alias(f"{name}_m"), F.count_if(cond).alias(f"{name}_s")]
    sums = hits.groupBy("class").agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("subset"), F.coalesce(F.col(f"{n}_m"), F.lit(0)).alias("matched"),
                 F.coalesce(F.col(f"{n}_s"), F.lit(0)).alias("support")) for n in subsets]))
    rows = (class_domain(hits.sparkSession, classes).join(sums, "class", "left")
            .select("class", stacked.alias("r")).select("class", "r.*"))
    low, high = wilson_interval(F.col("matched"), F.col("support"))
    return rows.select("class", "subset", "matched", "support",
                       ratio(F.col("matched"), F.col("support")).alias("recall"), low.alias("recall_ci95_low"),
                       high.alias("recall_ci95_high"), (F.col("support") >= 300).alias("conclusive"))


def standard_subsets() -> dict[str, Column]:
    remote = F.col("source_hint") == "remote"
    stratum = F.col("stratum")
    quiet = (F.col("scene_mode") == "quiet") | (stratum == "simple")
    busy = (F.col("scene_mode") == "busy") | (stratum == "complex")
    return {"quiet_remote": remote & quiet, "busy_remote": remote & busy, "remote": remote}


def rapid_pairs(hits: DataFrame, minimum: int, maximum: int, width: int,
                keys: Sequence[str] = ("session_id", "class"), ties: Sequence[str] = ("truth_id",)) -> DataFrame:
    """Share of consecutive labels between ``minimum`` and ``maximum`` apart of which both were found."""
    ahead = edge_window(hits, keys, "onset_sample", ties, width, 1, lambda w: {
        "_next": F.lead("onset_sample").over(w), "_next_hit": F.lead("hit").over(w)})
    gap = F.col("_next") - F.col("onset_sample")
    rapid = F.coalesce((gap >= minimum) & (gap <= maximum), F.lit(False))
    sums = ahead.groupBy("class").agg(F.count_if(rapid & F.col("hit") & F.col("_next_hit")).alias("passed"),
                                      F.count_if(rapid).alias("support"))
    return sums.withColumn("rate", ratio(F.col("passed"), F.col("support")))


def source_metrics(truth: DataFrame, raw_pairs: DataFrame, emitted_pairs: DataFrame) -> DataFrame:
    """Recall of own and remote events before and after suppression."""
    rows = with_hit(with_hit(truth, raw_pairs, "raw"), emitted_pairs, "emitted")

    def count(source, column=None):
        cond = F.col("source_hint") == source
        return F.count_if(cond if column is None else cond & F.col(column))
    sums = rows.agg(count("self").alias("self_support"), count("self", "raw").alias("rs"),
                    count("self", "emitted").alias("es"), count("remote").alias("remote_support"),
                    count("remote", "raw").alias("rr"), count("remote", "emitted").alias("er"))
    c = F.col
    return sums.select(
        "self_support", ratio(c("rs"), c("self_support")).alias("raw_self_recall"),
        ratio(c("rs") - c("es"), c("rs")).alias("self_suppression_rate"), "remote_support",
        ratio(c("rr"), c("remote_support")).alias("raw_remote_recall"),
        ratio(c("er"), c("remote_support")).alias("emitted_remote_recall"),
        ratio(c("rr") - c("er"), c("remote_support")).alias("remote_recall_loss"))


def session_flags(sessions: DataFrame, timeline: DataFrame, targets: DataFrame) -> DataFrame:
    """Per session: free of usable targets?  complex (named so, or any busy label)?"""
    busy = timeline.groupBy("session_id").agg(F.bool_or(F.coalesce(F.col("scene_mode") == "busy", F.lit(False)))
                                              .alias("_busy"))
    has = targets.select("session_id").distinct().withColumn("_has", F.lit(True))
    named = F.col("name").contains("_complex_") if "name" in sessions.columns else F.lit(False)
    return (sessions.join(busy, "session_id", "left").join(has, "session_id", "left")
            .withColumns({"target_free": F.col("_has").isNull(),
                          "is_complex": named | F.coalesce(F.col("_busy"), F.lit(False))}).drop("_busy", "_has"))


def ambient_rates(flags: DataFrame, emitted: DataFrame, pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Detections per minute without targets, and unmatched detections per minute in complex sessions."""
    totals = flags.agg(
        F.coalesce(F.sum(F.when(F.col("target_free"), F.col("duration_seconds"))), F.lit(0.0)).alias("free_seconds"),
        F.coalesce(F.sum(F.when(F.col("is_complex"), F.col("duration_seconds"))), F.lit(0.0)).alias("complex_seconds"))
    matched = pairs.select("pred_id", F.lit(True).alias("m"))
    per_session = (emitted.join(matched, "pred_id", "left")
                   .groupBy("session_id", "class").agg(F.count(F.lit(1)).alias("n"),
                                                       F.count_if(F.col("m").isNull()).alias("u")))
    counts = (per_session.join(flags.select("session_id", "target_free", "is_complex"), "session_id")
              .groupBy("class").agg(F.sum(F.when(F.col("target_free"), F.col("n"))).alias("free"),
                                    F.sum(F.when(F.col("is_complex"), F.col("u"))).alias("cplx")))
    rows = (class_domain(flags.sparkSession, classes).join(counts, "class", "left").fillna(0, ["free", "cplx"])
            .crossJoin(F.broadcast(totals)))
    return rows.select(
        "class", "free_seconds", "complex_seconds",
        (F.col("free") * 60.0 / F.greatest(F.col("free_seconds"), F.lit(1e-12))).alias("ambient_per_minute"),
        (F.col("cplx") * 60.0 / F.greatest(F.col("complex_seconds"), F.lit(1e-12))).alias("complex_per_minute"))


def duplicate_rate(duplicates: DataFrame, pairs: DataFrame) -> DataFrame:
    n = duplicates.agg(F.count(F.lit(1)).alias("duplicates"))
    m = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    return n.crossJoin(m).withColumn("duplicate_rate", ratio(F.col("duplicates"), F.col("pairs")))


def recognition_gates(overall: DataFrame, subsets: DataFrame, support: DataFrame, rapid: DataFrame,
                      duplicates: DataFrame, ambient: DataFrame, source: DataFrame, first_class: str,
                      second_class: str, rapid_class: str) -> DataFrame:
    """The thirteen acceptance tests and their conjunction, one row.

    Every input is a report table of at most a few rows per class.
    """
    c, count_if, every = F.col, F.count_if, F.bool_and

    def picked(name, cls, minimum, label):
        sel = (c("subset") == name) & (c("class") == cls)
        return (F.coalesce(F.max(F.when(sel, (c("support") >= minimum) & (c("recall") >= 0.95))), F.lit(False))
                .alias(label))
    parts = [
        support.agg(every(c("remote") >= 300).alias("locked_remote_support"),
                    every(c("self") >= 200).alias("locked_self_support")),
        subsets.agg(picked("quiet_remote", second_class, 100, "quiet_remote_recall"),
                    picked("remote", first_class, 1, "remote_recall"),
                    picked("busy_remote", first_class, 100, "busy_remote_recall")),
        rapid.filter(c("class") == rapid_class).agg(
            F.coalesce(every((c("support") >= 100) & (c("rate") >= 0.95)), F.lit(False)).alias("rapid_pairs")),
        duplicates.agg(every(c("duplicate_rate") < 0.01).alias("duplicates")),
        ambient.agg(every((c("free_seconds") >= 3600.0) & (c("ambient_per_minute") <= 0.1))
                    .alias("ambient_false_alerts"),
                    (F.sum("complex_per_minute") <= 2.0).alias("complex_false_alerts")),
        overall.agg(every((c("support") > 0) & (c("p95_absolute_onset_error_ms") <= 30.0)).alias("onset_accuracy"),
                    every((c("support") > 0) & (c("median_delivery_latency_ms") <= 50.0)
                          & (c("p95_delivery_latency_ms") <= 100.0)).alias("delivery_latency")),
        source.agg(every(c("self_suppression_rate") >= 0.98).alias("self_suppression"),
                   every(c("remote_recall_loss") <= 0.03).alias("remote_suppression_loss")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)
    names = row.columns
    accepted = F.lit(True)
    for name in names:
        accepted = accepted & c(name)
    return row.withColumn("accepted", accepted)


def class_support(truth: DataFrame, classes: Sequence[str]) -> DataFrame:
    sums = truth.groupBy("class").agg(F.count_if(F.col("source_hint") == "remote").alias("remote"),
                                      F.count_if(F.col("source_hint") == "self").alias("self"))
    return class_domain(truth.sparkSession, classes).join(sums, "class", "left").fillna(0, ["remote", "self"])


def session_offsets(sessions: DataFrame, length: str = "length", name: str = "session_id") -> DataFrame:
    """Total length of the sessions before each one in name order."""
    return sorted_index(sessions, [name], "offset", size=length)


def shift_positions(rows: DataFrame, offsets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positions on the concatenated timeline of all sessions."""
    joined = rows.join(offsets.select("session_id", "offset"), "session_id")
    return joined.withColumns({c: F.col(c) + F.col("offset") for c in columns}).drop("offset")


def evaluate(truth: DataFrame, raw: DataFrame, sessions: DataFrame, *, classes: Sequence[str],
             tol: int = params.MATCH_TOLERANCE, rate: int = params.SAMPLE_RATE, isolate_sessions: bool = True,
             rapid_class: str | None = None, rapid_range: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """All report tables of one evaluation run; pairs are matched once and shared.

    ``isolate_sessions=False`` matches on the concatenated timeline, where a pair may cross the edge
    between two sessions; positions then carry the session offsets.
    """
    timeline, sessions_in = truth, sessions
    keys = matching.KEYS
    if not isolate_sessions:
        offsets = session_offsets(sessions)
        truth = shift_positions(truth, offsets, ["onset_sample", "end_sample"])
        raw = shift_positions(raw, offsets, ["onset_sample", "end_sample", "detected_sample"])
        keys = ("class",)
    targets = matching.usable_truth(truth, classes)
    emitted = raw.filter(~F.col("suppressed"))
    raw_pairs = matching.match_events(targets, raw, tol, keys=keys)
    pairs = matching.match_events(targets, emitted, tol, keys=keys)
    if "session_id" not in pairs.columns:
        pairs = pairs.join(targets.select("truth_id", "session_id"), "truth_id")
    hits = with_hit(targets, pairs)
    width = 64 * tol
    low, high = rapid_range or (rate * params.RAPID_MIN_MS // 1000, rate * params.RAPID_MAX_MS // 1000)
    total = sessions_in.agg(F.sum("duration_seconds").alias("total_seconds"))
    duplicates = matching.duplicate_predictions(targets, emitted, pairs, tol, width, keys)
    flags = session_flags(sessions_in, timeline, matching.usable_truth(timeline, classes))
    overall = (detection_metrics(targets, emitted, pairs, F.lit(1.0), classes, rate)
               .crossJoin(F.broadcast(total))
               .withColumn("false_alerts_per_minute",
                           F.col("false_positives") * 60.0 / F.greatest(F.col("total_seconds"), F.lit(1e-12))))
    minutes = sessions_in.select("session_id", F.greatest(F.col("duration_seconds"), F.lit(1e-12)).alias("_seconds"))
    per_session = (detection_metrics(targets, emitted, pairs, F.lit(1.0), classes, rate, by=("session_id",))
                   .join(minutes, "session_id")
                   .withColumn("false_alerts_per_minute", F.col("false_positives") * 60.0 / F.col("_seconds")).drop("_seconds"))
    report = {
        "overall": overall.drop("total_seconds"),
        "per_session": per_session,
        "subsets": recall_subset(hits, standard_subsets(), classes),
        "rapid": rapid_pairs(hits, low, high, width, keys),
        "duplicates": duplicate_rate(duplicates, pairs),
        "source": source_metrics(targets, raw_pairs, pairs),
        "ambient": ambient_rates(flags, emitted, pairs, classes),
        "support": class_support(targets, classes),
        "pairs": pairs, "errors": matching.error_events(targets, emitted, pairs),
    }
    report["gates"] = recognition_gates(
        report["overall"], report["subsets"], report["support"], report["rapid"], report["duplicates"],
        report["ambient"], report["source"], classes[0], classes[1], rapid_class or classes[0])
    return report
