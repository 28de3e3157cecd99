"""Score trace to events."""

from pyspark.sql import functions as F

from soundlake.operators import peaks
from soundlake.plans import views as v
from soundlake.plans.registry import query

QUIET, BUSY, CUTOFF, LOOK = 0.05, 0.15, 0.5, 1
TIES = ("event_id",)

v.CTE["peaks"] = f"""marked AS (SELECT *,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND {LOOK} FOLLOWING) AS around,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING) AS before,
  last_value(sample) OVER (w ROWS BETWEEN CURRENT ROW AND {LOOK} FOLLOWING) AS detected
  FROM trace WINDOW w AS (PARTITION BY session_id, class ORDER BY sample, event_id)),
peaks AS (SELECT * FROM marked WHERE probability >= CASE WHEN activity < {CUTOFF} THEN {QUIET} ELSE {BUSY} END
  AND probability >= around AND (before IS NULL OR probability > before))"""
v.CTE["spaced"] = f"""ranked_peaks AS (SELECT *, row_number() OVER (PARTITION BY session_id, class
  ORDER BY sample, event_id) AS rn FROM peaks),
walk AS (
  SELECT session_id, class, rn, sample AS kept, probability AS kp, event_id AS kid, CAST(NULL AS BIGINT) AS final
  FROM ranked_peaks WHERE rn = 1
  UNION ALL
  SELECT n.session_id, n.class, n.rn,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.sample ELSE w.kept END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.probability ELSE w.kp END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.event_id ELSE w.kid END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} THEN w.kid END
  FROM walk w JOIN ranked_peaks n ON n.session_id = w.session_id AND n.class = w.class AND n.rn = w.rn + 1),
spaced AS (SELECT * FROM ranked_peaks WHERE event_id IN (
  SELECT final FROM walk WHERE final IS NOT NULL
  UNION ALL
  SELECT arg_max(kid, rn) FROM walk GROUP BY session_id, class))"""


def events(spark, sf_dir, **overrides):
    options = dict(quiet=QUIET, busy=BUSY, cutoff=CUTOFF, spacing=v.SPACING, lookahead=LOOK, onset_offset=30,
                   pulse=60, self_threshold=0.95, width=v.WIDTH, ties=TIES)
    return peaks.peak_events(v.trace(spark, sf_dir), **{**options, **overrides})


@query("local_peaks", v.sql("""SELECT session_id, class, sample, event_id, probability, detected FROM peaks""",
                            "ev", "trace", "peaks"))
def local_peaks(spark, sf_dir):
    found = peaks.local_peaks(v.trace(spark, sf_dir), QUIET, BUSY, CUTOFF, LOOK, v.WIDTH, ties=TIES)
    return found.select("session_id", "class", "sample", "event_id", "probability", F.col("_detected").alias("detected"))


@query("min_spacing", v.sql("SELECT session_id, class, sample, event_id, probability FROM spaced",
                            "ev", "trace", "peaks", "spaced"))
def min_spacing(spark, sf_dir):
    found = peaks.local_peaks(v.trace(spark, sf_dir), QUIET, BUSY, CUTOFF, LOOK, v.WIDTH, ties=TIES)
    return (peaks.min_spacing(found, v.SPACING, v.WIDTH, ties=TIES)
            .select("session_id", "class", "sample", "event_id", "probability"))


PEAK_EVENTS = f"""SELECT session_id, class, event_id, sample, greatest(0, sample - 30) AS onset_sample,
  greatest(0, sample - 30) + 60 AS end_sample, probability AS confidence, detected AS detected_sample,
  CASE WHEN source_probs[1] >= 0.95 THEN 'self'
       ELSE ['self', 'remote', 'unknown'][list_position(source_probs, list_max(source_probs))] END AS source_hint,
  round(CASE WHEN source_probs[1] >= 0.95 THEN source_probs[1] ELSE list_max(source_probs) END, 6)
    AS source_confidence,
  CASE WHEN activity < {CUTOFF} THEN 'quiet' ELSE 'busy' END AS scene_mode,
  source_probs[1] >= 0.95 AS suppressed FROM spaced"""


@query("peak_events", v.sql(PEAK_EVENTS, "ev", "trace", "peaks", "spaced"))
def peak_events(spark, sf_dir):
    return events(spark, sf_dir).withColumn("source_confidence", F.round("source_confidence", 6))
