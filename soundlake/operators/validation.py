"""Rule tables: each rule is a named condition; rows report the names of the rules they break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake import params
from soundlake.functions.geometry import direction_vector


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of rules whose condition is false or unknown."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def violations(df: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.explode(broken_rules(rules)).alias("rule"))


def raise_on_violation(found: DataFrame) -> None:
    """Fail at the edge of the API with a few examples."""
    examples = found.take(5)
    if examples:
        raise ValueError(f"validation failed: {[tuple(r) for r in examples]}")


def normalize_timeline(events: DataFrame, length: str, classes: Sequence[str] = params.CLASS_NAMES,
                       sources: Sequence[str] = params.SOURCE_NAMES, pulse: int = params.SAMPLE_RATE // 20) -> DataFrame:
    """Defaults and domains of a raw timeline; ``violations`` lists what is wrong with a row."""
    raw = F.coalesce(F.col("source_hint"), F.col("source") if "source" in events.columns else F.lit(None), F.lit("unknown"))
    rows = events.withColumns({
        "onset_sample": F.coalesce("onset_sample", F.lit(-1)).cast("bigint"),
        "source_hint": F.when(raw.isin("manual", "model"), "unknown").otherwise(raw),
        "reviewed": F.coalesce("reviewed", F.lit(True)), "uncertain": F.coalesce("uncertain", F.lit(False)),
        "scene_mode": F.coalesce("scene_mode", F.lit("unknown"))})
    rows = rows.withColumn("end_sample", F.coalesce("end_sample", F.col("onset_sample") + pulse).cast("bigint"))
    onset, end, n = F.col("onset_sample"), F.col("end_sample"), F.col(length)
    return rows.withColumn("violations", broken_rules({
        "class": F.col("class").isin(*classes, "negative"),
        "bounds": (onset >= 0) & (onset < n) & (onset < end) & (end <= n),
        "source_hint": F.col("source_hint").isin(*sources)}))


def validate_scenes(scenes: DataFrame, schema: str, renderer: str, *, real_schema: str | None = None,
                    classes: Sequence[str] = params.CLASS_NAMES, rate: int = params.SAMPLE_RATE,
                    samples: int = params.SCENE_SAMPLES, frames: int = params.SCENE_FRAMES,
                    close: str = "close-15-30") -> DataFrame:
    """Violations of the scene manifest rules.  Uniqueness is an aggregate over ids and paths joined back,
    not a window over equal values."""
    c, targets = F.col, F.col("targets")
    synthetic = c("schema_version") == schema

    def counted(name):
        repeated = scenes.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
            name, F.lit(True).alias(f"_twice_{name}"))
        return repeated
    rows = scenes.join(counted("scene_id"), "scene_id", "left").join(counted("relative_path"), "relative_path", "left")
    direction = lambda t: t["rendered_direction"]
    vectors = F.transform(targets, lambda t: direction_vector(
        direction(t)["azimuth_degrees"], direction(t)["elevation_degrees"]))
    rows = rows.withColumn("_v", vectors)
    rows = rows.withColumn("_closest", F.expr("""array_min(flatten(transform(_v, (a, i) -> transform(
        slice(_v, i + 2, size(_v)), b -> degrees(acos(greatest(-1D, least(1D,
          a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))))))))"""))
    size = F.size("targets")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    inside = lambda t: (finite(direction(t)["azimuth_degrees"]) & (direction(t)["azimuth_degrees"] >= 0.0)
                        & (direction(t)["azimuth_degrees"] < 360.0) & finite(direction(t)["elevation_degrees"])
                        & F.abs(direction(t)["elevation_degrees"]).between(0.0, 60.0))
    rules = {
        "schema": synthetic | (c("schema_version") == real_schema if real_schema else F.lit(False)),
        "renderer": ~synthetic | (c("renderer_version") == renderer),
        "contract": (c("sample_rate") == rate) & (c("sample_count") == samples) & (c("feature_frames") == frames),
        "scene_id_empty": c("scene_id") != "",
        "scene_id_unique": c("_twice_scene_id").isNull(),
        "path_empty": c("relative_path") != "",
        "path_unique": c("_twice_relative_path").isNull(),
        "path_relative": ~c("relative_path").startswith("/") & ~F.array_contains(F.split("relative_path", "/"), ".."),
        "digest": c("wav_sha256").rlike("^[0-9a-f]{64}$"),
        "split": c("split").isin("train", "dev", "test"),
        "targets": targets.isNotNull() & (c("target_count") == size) & size.between(0, params.MAX_SOURCES),
        "target_class": F.forall(targets, lambda t: t["sound_class"].isin(*classes)),
        "direction": F.forall(targets, inside),
        "stratum": ~synthetic | c("stratum").isin("standard", close),
        "separation": ~synthetic | c("_closest").isNull() | (c("_closest") >= params.MIN_SEPARATION_DEGREES - 1e-6),
        "close_pair": ~synthetic | (c("stratum") != close) | F.coalesce(
            c("_closest") <= params.CLOSE_MAX_DEGREES + 1e-6, F.lit(False)),
    }
    return violations(rows, rules, ["scene_id"])


def policy_rules(classes: Sequence[str] = params.CLASS_NAMES) -> dict[str, Column]:
    """Ranges of a recognition policy given as ``MAP<STRING, DOUBLE>`` in column ``policy``."""
    p = lambda k: F.col("policy")[k]
    rules = {"scene_activity_cutoff": (p("scene_activity_cutoff") > 0) & (p("scene_activity_cutoff") < 1),
             "self_suppression_threshold": (p("self_suppression_threshold") > 0) & (p("self_suppression_threshold") <= 1),
             "peak_lookahead_frames": p("peak_lookahead_frames") >= 0, "pulse_ms": p("pulse_ms") > 0,
             "inference_stride_frames": p("inference_stride_frames") > 0}
    for name in classes:
        for kind in ("quiet", "busy"):
            key = f"threshold_{kind}_{name}"
            rules[key] = (p(key) > 0) & (p(key) <= 1)
        rules[f"minimum_spacing_ms_{name}"] = p(f"minimum_spacing_ms_{name}") > 0
        rules[f"onset_offset_samples_{name}"] = p(f"onset_offset_samples_{name}") >= 0
    return rules


def direction_policy_rules(classes: Sequence[str] = params.CLASS_NAMES) -> dict[str, Column]:
    """Ranges of a direction policy: thresholds, merge angle and the ``uncertainty`` table
    (``ARRAY<STRUCT<confidence, p90>>``), which must rise in confidence and not widen."""
    p, u = (lambda k: F.col("policy")[k]), F.col("uncertainty")
    steps = F.sequence(F.lit(0), F.size(u) - 2)
    rules = {f"threshold_{n}": (p(f"threshold_{n}") > 0) & (p(f"threshold_{n}") <= 1) for n in classes}
    rules |= {
        "duplicate_merge_degrees": (p("duplicate_merge_degrees") > 0) & (p("duplicate_merge_degrees") < 15),
        "uncertainty_count": F.size(u).between(2, 16),
        "uncertainty_range": F.forall(u, lambda x: x["confidence"].between(0, 1) & x["p90"].between(0, 180)),
        "confidence_rises": (F.size(u) < 2) | F.forall(steps, lambda i: u[i + 1]["confidence"] > u[i]["confidence"]),
        "error_narrows": (F.size(u) < 2) | F.forall(steps, lambda i: u[i + 1]["p90"] <= u[i]["p90"] + 1e-6),
    }
    return rules


def model_file_rules(digest: str = "model_digest") -> dict[str, Column]:
    name = F.col("model_file")
    return {"model_file": (name != "") & ~name.contains("/") & ~name.contains("\\"),
            "model_sha256": F.col("model_sha256") == F.col(digest)}


def contract_violations(meta: DataFrame, expected: dict[str, str], column: str = "meta",
                        keep: Sequence[str] = ()) -> DataFrame:
    """Keys of a ``MAP<STRING, STRING>`` that are missing or differ from the expected constants."""
    want = F.create_map(*[F.lit(x) for pair in sorted(expected.items()) for x in pair])
    wrong = F.filter(F.map_keys(want), lambda k: ~F.coalesce(F.col(column)[k] == want[k], F.lit(False)))
    return meta.select(*keep, F.explode(wrong).alias("rule"))


def clamp_policy(policy: DataFrame, limits: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Non-finite values take the default, then values are held inside (low, high) per column."""
    def held(name, low, high, default):
        v = F.col(name).cast("double")
        good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.when(good, v).otherwise(F.lit(float(default)))))
    return policy.withColumns({n: held(n, *spec) for n, spec in limits.items()})


# Fixed values: (low, high, default) of the run-time tuning.
TUNING_LIMITS = {"threshold": (0.01, 1.0, 0.95), "minimum_spacing_ms": (1, 5000, 1), "onset_offset_samples": (0, 24000, 0),
                 "scene_activity_cutoff": (0.01, 0.99, 0.5), "self_suppression_threshold": (0.01, 1.0, 0.95),
                 "pulse_ms": (1, 1000, 1)}


def finite_check(values: Column, size: int) -> Column:
    return F.coalesce((F.size(values) == size) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))), F.lit(False))
