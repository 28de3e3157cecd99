"""Threshold sweeps and calibrated policies over the event trace."""

from pyspark.sql import functions as F

from soundlake.operators import calibration, matching, peaks
from soundlake.plans import views as v
from soundlake.plans.q_events import CUTOFF, LOOK, TIES
from soundlake.plans.q_matching import GUARD, greedy_sql, load, matched, rounded
from soundlake.plans.registry import query

VALUES = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55]
PAIRS = calibration.threshold_pairs(VALUES, ("view",), v.TARGETS)
GRID_ROWS = ", ".join(f"('{c}', {o}, CAST({q} AS DOUBLE), CAST({b} AS DOUBLE))" for c, o, q, b in PAIRS)
v.CTE["grid_peaks"] = f"""grid(class, ord, quiet, busy) AS (VALUES {GRID_ROWS}),
marked AS (SELECT *, max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND {LOOK} FOLLOWING) AS around,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING) AS before
  FROM trace WINDOW w AS (PARTITION BY session_id, class ORDER BY sample, event_id)),
passed AS (SELECT m.*, ord FROM marked m JOIN grid g ON g.class = m.class AND m.probability >= CASE WHEN m.activity < {CUTOFF} THEN quiet ELSE busy END
  WHERE probability >= around AND (before IS NULL OR probability > before))"""


def grid(spark):
    return spark.createDataFrame(PAIRS, "class string, ord int, quiet double, busy double")


@query("threshold_grid", v.sql("SELECT class, ord, count(*) AS candidates, sum(event_id)::BIGINT AS id_sum FROM passed GROUP BY ALL", "ev", "trace", "grid_peaks"))
def threshold_grid(spark, sf_dir):
    maxima = peaks.local_maxima(v.trace(spark, sf_dir), LOOK, v.WIDTH, ties=TIES)
    return calibration.threshold_grid(maxima, grid(spark), CUTOFF).groupBy("class", "ord").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("event_id").alias("id_sum"))


@query("scene_cutoff", v.sql("""SELECT round(coalesce(greatest(0.05, least(0.95, quantile_cont(activity, 0.6))), 0.35), 6) AS cutoff FROM background""",
                             "ev", "trace", "labelled", "truth", "targets", "background"))
def scene_cutoff(spark, sf_dir):
    return rounded(calibration.scene_cutoff(v.trace(spark, sf_dir), load(spark, sf_dir)[2], GUARD, v.WIDTH))


BETTER = f"n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp"
v.CTE["sweep"] = f"""gr AS (SELECT session_id, class, ord, sample, probability, event_id, row_number() OVER (PARTITION BY session_id, class, ord ORDER BY sample, event_id) AS rn FROM passed),
gw AS (SELECT session_id, class, ord, rn, sample AS kept, probability AS kp, event_id AS kid, CAST(NULL AS BIGINT) AS final FROM gr WHERE rn = 1
  UNION ALL SELECT n.session_id, n.class, n.ord, n.rn, CASE WHEN {BETTER} THEN n.sample ELSE w.kept END, CASE WHEN {BETTER} THEN n.probability ELSE w.kp END,
    CASE WHEN {BETTER} THEN n.event_id ELSE w.kid END, CASE WHEN n.sample - w.kept >= {v.SPACING} THEN w.kid END
  FROM gw w JOIN gr n ON n.session_id = w.session_id AND n.class = w.class AND n.ord = w.ord AND n.rn = w.rn + 1),
gkeep AS (SELECT session_id, class, ord, final AS event_id FROM gw WHERE final IS NOT NULL
  UNION ALL SELECT session_id, class, ord, arg_max(kid, rn) FROM gw GROUP BY ALL),
gpred AS (SELECT k.session_id, k.class, k.ord, k.event_id, r.sample AS onset_sample, r.sample AS detected_sample FROM gkeep k JOIN gr r
  ON r.session_id = k.session_id AND r.class = k.class AND r.ord = k.ord AND r.event_id = k.event_id),
gtruth AS (SELECT t.session_id, t.class, g.ord, t.event_id, t.onset_sample FROM targets t JOIN grid g USING (class)),
{greedy_sql('gtruth', 'gpred', 'gpairs', 'session_id, class, ord')},
spans AS (SELECT session_id, max(sample) AS last, session_id IN (SELECT session_id FROM targets) AS has FROM trace GROUP BY session_id),
counts AS (SELECT g.class, g.ord, g.quiet, g.busy, coalesce(h.tp, 0) AS tp, coalesce(p.n, 0) - coalesce(h.tp, 0) AS fp, coalesce(l.n, 0) - coalesce(h.tp, 0) AS fn,
    coalesce(p.ambient, 0) AS ambient_fp, (SELECT sum(last) FROM spans) / CAST(60 AS DOUBLE) AS total_minutes,
    coalesce((SELECT sum(last) FROM spans WHERE NOT has), 0) / CAST(60 AS DOUBLE) AS ambient_minutes FROM grid g
  LEFT JOIN (SELECT class, ord, count(*) AS tp FROM gpairs GROUP BY ALL) h USING (class, ord)
  LEFT JOIN (SELECT class, ord, count(*) AS n, count(*) FILTER (WHERE NOT has) AS ambient FROM gpred JOIN spans USING (session_id) GROUP BY ALL) p USING (class, ord)
  LEFT JOIN (SELECT class, count(*) AS n FROM targets GROUP BY class) l USING (class))"""
SWEEP = ("ev", "trace", "labelled", "truth", "targets", "grid_peaks", "sweep")


def counts(spark, sf_dir):
    return calibration.sweep_counts(v.trace(spark, sf_dir), load(spark, sf_dir)[2], grid(spark), cutoff=CUTOFF, lookahead=LOOK,
                                    spacing=v.SPACING, tol=v.TOL, width=v.WIDTH, minutes_per_unit=1 / 60)


@query("calibration_sweep", v.sql("SELECT class, ord, tp, fp, fn, ambient_fp FROM counts", *SWEEP))
def calibration_sweep(spark, sf_dir):
    return counts(spark, sf_dir).select("class", "ord", "tp", "fp", "fn", "ambient_fp")


@query("calibrate_thresholds", v.sql("""SELECT class, arg_max(quiet, s) AS quiet, arg_max(busy, s) AS busy, round(arg_max(recall, s), 6) AS recall,
  round(arg_max("precision", s), 6) AS "precision" FROM (SELECT *, (ambient_rate <= 0.1 AND overall_rate <= 2.0,
    -(greatest(0.0, ambient_rate - 0.1) + greatest(0.0, overall_rate - 2.0)), recall, "precision", -(ambient_rate + overall_rate), -ord) AS s FROM (
    SELECT *, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS recall, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS "precision",
      ambient_fp / greatest(ambient_minutes, 1e-12) AS ambient_rate, fp / greatest(total_minutes, 1e-12) AS overall_rate FROM counts)) GROUP BY class""", *SWEEP))
def calibrate_thresholds(spark, sf_dir):
    return rounded(calibration.calibrate_thresholds(counts(spark, sf_dir)))


PAIRED = ("ev", "trace", "labelled", "truth", "pred", "targets", "emitted", "pairs")


@query("calibrate_onset_offset", v.sql("""SELECT class, greatest(0, least(480, CAST(trunc(quantile_cont(CAST(p_pos - t_pos AS DOUBLE), 0.5)) AS BIGINT))) AS onset_offset
  FROM pairs GROUP BY class UNION ALL SELECT 'absent', 512""", *PAIRED))
def calibrate_onset_offset(spark, sf_dir):
    *_, emitted, pairs = matched(spark, sf_dir)
    at = emitted.select("pred_id", F.col("onset_sample").alias("pred_pos"))
    return calibration.calibrate_onset_offset(pairs.join(at, "pred_id"), maximum=480, classes=(*v.TARGETS, "absent"))


SUPPRESS_GRID = [round(0.50 + 0.01 * i, 2) for i in range(50)]
S_ROWS = ", ".join(f"(CAST({t} AS DOUBLE))" for t in SUPPRESS_GRID)


@query("calibrate_suppression", v.sql(f"""SELECT b.threshold, round(b.s, 6) AS self_rate, round(-b.l, 6) AS remote_loss FROM (
  SELECT max(struct_pack(s := s, l := -l, threshold := threshold)) AS b FROM (
    SELECT threshold, coalesce(avg(CAST(p_self >= threshold AS INTEGER)) FILTER (WHERE source_hint = 'self'), 0.0) AS s,
      coalesce(avg(CAST(p_self >= threshold AS INTEGER)) FILTER (WHERE source_hint = 'remote'), 0.0) AS l
    FROM (SELECT t.source_hint, 1 - t.k / CAST(100 AS DOUBLE) AS p_self FROM pairs JOIN targets t ON t.event_id = pairs.tid), (VALUES {S_ROWS}) g(threshold)
    GROUP BY threshold) WHERE l <= 0.7)""", *PAIRED))
def calibrate_suppression(spark, sf_dir):
    _, _, targets, _, pairs = matched(spark, sf_dir)
    rows = pairs.join(targets.select("truth_id", "source_hint", (1 - F.col("k") / 100.0).alias("p_self")), "truth_id")
    return rounded(calibration.calibrate_suppression(rows, SUPPRESS_GRID, loss_limit=0.7))
