"""Labels against detections: pairs, metrics, rates and gates."""

from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators import matching, metrics
from soundlake.plans import views as v
from soundlake.plans.registry import query

RAPID = (30, 1440)      # minutes between consecutive labels of a rapid pair
GUARD, LEAD_IN, CUTOFF = 240, 360, 0.5
CLASS_LIST = ", ".join(f"'{c}'" for c in v.TARGETS)
CLASS_ROWS = "(VALUES " + ", ".join(f"('{c}')" for c in v.TARGETS) + ")"


def greedy_sql(left: str, right: str, name: str, keys: str = "session_id, class") -> str:
    same = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""{name}_cand AS (SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, t.event_id AS tid,
  p.event_id AS pid, t.onset_sample AS t_pos, p.onset_sample AS p_pos, p.detected_sample AS p_detected,
  abs(p.onset_sample - t.onset_sample) AS d, row_number() OVER (PARTITION BY {', '.join('t.' + k.strip() for k in keys.split(','))}
    ORDER BY abs(p.onset_sample - t.onset_sample), t.event_id, p.event_id) AS rn
  FROM {left} t JOIN {right} p USING ({keys}) WHERE abs(p.onset_sample - t.onset_sample) <= {v.TOL}),
{name}_walk AS (
  SELECT {keys}, rn, tid, pid, t_pos, p_pos, p_detected, d, true AS ok, [tid] AS ut, [pid] AS up
  FROM {name}_cand WHERE rn = 1
  UNION ALL
  SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.rn, c.tid, c.pid, c.t_pos, c.p_pos, c.p_detected, c.d,
    NOT list_contains(g.ut, c.tid) AND NOT list_contains(g.up, c.pid),
    CASE WHEN NOT list_contains(g.ut, c.tid) AND NOT list_contains(g.up, c.pid) THEN list_append(g.ut, c.tid) ELSE g.ut END,
    CASE WHEN NOT list_contains(g.ut, c.tid) AND NOT list_contains(g.up, c.pid) THEN list_append(g.up, c.pid) ELSE g.up END
  FROM {name}_walk g JOIN {name}_cand c ON {same} AND c.rn = g.rn + 1),
{name} AS (SELECT {keys}, tid, pid, t_pos, p_pos, p_detected, d FROM {name}_walk WHERE ok)"""


v.CTE["targets"] = f"""targets AS (SELECT * FROM truth WHERE class IN ({CLASS_LIST})
  AND NOT coalesce(uncertain, false) AND coalesce(reviewed, true))"""
v.CTE["emitted"] = "emitted AS (SELECT * FROM pred WHERE NOT suppressed)"
v.CTE["pairs"] = greedy_sql("targets", "emitted", "pairs")
v.CTE["raw_pairs"] = greedy_sql("targets", "pred", "raw_pairs")
BASE = ("ev", "labelled", "truth", "pred", "targets", "emitted", "pairs")


def load(spark, sf_dir):
    rows = v.labelled(spark, sf_dir)
    truth = rows.filter("role = 'truth'").withColumnRenamed("event_id", "truth_id")
    raw = rows.filter("role = 'pred'").withColumnRenamed("event_id", "pred_id")
    return truth, raw, matching.usable_truth(truth, v.TARGETS), raw.filter("not suppressed")


def matched(spark, sf_dir):
    truth, raw, targets, emitted = load(spark, sf_dir)
    return truth, raw, targets, emitted, matching.match_events(targets, emitted, v.TOL)


@query("usable_truth", v.sql("SELECT session_id, class, event_id, onset_sample FROM targets",
                             "ev", "labelled", "truth", "targets"))
def usable_truth(spark, sf_dir):
    return load(spark, sf_dir)[2].select("session_id", "class", F.col("truth_id").alias("event_id"), "onset_sample")


@query("match_events", v.sql("SELECT session_id, class, tid AS truth_id, pid AS pred_id, d AS distance FROM pairs",
                             *BASE))
def match_events(spark, sf_dir):
    return matched(spark, sf_dir)[-1].drop("truth_pos")


@query("asof_scene_mode", v.sql(f"""SELECT t.session_id, t.event_id, t.onset_sample,
  CASE WHEN t.scene_mode IN ('quiet', 'busy') OR a.activity IS NULL AND f.activity IS NULL THEN t.scene_mode
       WHEN coalesce(a.activity, f.activity) < {CUTOFF} THEN 'quiet' ELSE 'busy' END AS scene_mode
FROM (SELECT *, greatest(0, onset_sample - {LEAD_IN}) AS probe FROM truth) t
LEFT JOIN LATERAL (SELECT activity FROM trace r WHERE r.session_id = t.session_id AND r.sample <= t.probe
  ORDER BY r.sample DESC, r.event_id DESC LIMIT 1) a ON true
LEFT JOIN (SELECT session_id, arg_min(activity, (sample, event_id)) AS activity FROM trace GROUP BY session_id) f
  ON f.session_id = t.session_id""", "ev", "trace", "labelled", "truth"))
def asof_scene_mode(spark, sf_dir):
    truth = load(spark, sf_dir)[0]
    filled = matching.scene_mode_asof(truth, v.trace(spark, sf_dir), CUTOFF, LEAD_IN, v.WIDTH, ties=("event_id",))
    return filled.select("session_id", F.col("truth_id").alias("event_id"), "onset_sample", "scene_mode")


v.CTE["background"] = f"""background AS (SELECT * FROM trace r WHERE NOT EXISTS (SELECT 1 FROM targets t
  WHERE t.session_id = r.session_id AND abs(t.onset_sample - r.sample) <= {GUARD}))"""


@query("background_activity", v.sql("SELECT session_id, event_id, sample, activity FROM background",
                                    "ev", "trace", "labelled", "truth", "targets", "background"))
def background_activity(spark, sf_dir):
    rows = matching.background_activity(v.trace(spark, sf_dir), load(spark, sf_dir)[2], GUARD, v.WIDTH)
    return rows.select("session_id", "event_id", "sample", "activity")


v.CTE["duplicates"] = f"""duplicates AS (SELECT p.* FROM emitted p WHERE p.event_id NOT IN (SELECT pid FROM pairs)
  AND EXISTS (SELECT 1 FROM pairs m WHERE m.session_id = p.session_id AND m.class = p.class
              AND abs(m.t_pos - p.onset_sample) <= {v.TOL}))"""


def duplicates(spark, sf_dir):
    _, _, targets, emitted, pairs = matched(spark, sf_dir)
    return pairs, matching.duplicate_predictions(targets, emitted, pairs, v.TOL, v.WIDTH)


@query("duplicate_predictions", v.sql("SELECT session_id, class, event_id AS pred_id, onset_sample FROM duplicates",
                                      *BASE, "duplicates"))
def duplicate_predictions(spark, sf_dir):
    return duplicates(spark, sf_dir)[1].select("session_id", "class", "pred_id", "onset_sample")


@query("duplicate_rate", v.sql("""SELECT d AS duplicates, m AS pairs, round(d / CAST(greatest(1, m) AS DOUBLE), 6)
  AS duplicate_rate FROM (SELECT count(*) AS d FROM duplicates), (SELECT count(*) AS m FROM pairs)""",
                               *BASE, "duplicates"))
def duplicate_rate(spark, sf_dir):
    pairs, extra = duplicates(spark, sf_dir)
    return metrics.duplicate_rate(extra, pairs).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query("overlap_flags", v.sql("""SELECT a.session_id, a.event_id, EXISTS (SELECT 1 FROM labelled b
  WHERE b.session_id = a.session_id AND b.event_id <> a.event_id AND b.onset_sample < a.end_sample
  AND a.onset_sample < b.end_sample) AS overlapping FROM labelled a""", "ev", "labelled"))
def overlap_flags(spark, sf_dir):
    rows = v.labelled(spark, sf_dir).select("session_id", "event_id", "onset_sample", "end_sample")
    return matching.overlap_flags(rows, v.WIDTH).select("session_id", "event_id", "overlapping")


@query("error_events", v.sql("""SELECT session_id, class, onset_sample, event_id, 'miss' AS kind FROM targets
  WHERE event_id NOT IN (SELECT tid FROM pairs)
UNION ALL SELECT session_id, class, onset_sample, event_id, 'false_positive' FROM emitted
  WHERE event_id NOT IN (SELECT pid FROM pairs)""", *BASE))
def error_events(spark, sf_dir):
    _, _, targets, emitted, pairs = matched(spark, sf_dir)
    return matching.error_events(targets, emitted, pairs)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = f"CAST({params.WILSON_Z} AS DOUBLE)"
    n1 = f"CAST(nullif({n}, 0) AS DOUBLE)"
    mid = f"({k} / {n1} + {z} * {z} / (2.0 * {n1})) / (1.0 + {z} * {z} / {n1})"
    mar = (f"{z} * sqrt({k} / {n1} * (1.0 - {k} / {n1}) / {n1} + {z} * {z} / (4.0 * {n1} * {n1})) "
           f"/ (1.0 + {z} * {z} / {n1})")
    return f"coalesce(greatest(0.0, {mid} - {mar}), 0.0)", f"coalesce(least(1.0, {mid} + {mar}), 1.0)"


LOW, HIGH = wilson_sql("true_positives", "support")
v.CTE["outcomes"] = """outcomes AS (
  SELECT t.session_id, t.class, true AS is_truth, p.pid IS NOT NULL AS has_pred,
    CAST(abs(p.p_pos - p.t_pos) * 1000 AS DOUBLE) AS err, CAST((p.p_detected - p.t_pos) * 1000 AS DOUBLE) AS late
  FROM targets t LEFT JOIN pairs p ON p.tid = t.event_id
  UNION ALL SELECT session_id, class, false, true, NULL, NULL FROM emitted
  WHERE event_id NOT IN (SELECT pid FROM pairs))"""


def metrics_sql(by: str, duration: str) -> str:
    head = f"{by}, " if by else ""
    domain = (f"(SELECT DISTINCT {by} FROM outcomes) k CROSS JOIN {CLASS_ROWS} d(class)" if by
              else f"{CLASS_ROWS} d(class)")
    join = " AND ".join(f"o.{c} = {'k' if c != 'class' else 'd'}.{c}" for c in ([by] if by else []) + ["class"])
    return f"""sums AS (SELECT {('k.' + by + ', ') if by else ''}d.class,
    count(*) FILTER (WHERE is_truth AND has_pred) AS true_positives,
    count(*) FILTER (WHERE has_pred AND NOT is_truth) AS false_positives,
    count(*) FILTER (WHERE is_truth AND NOT has_pred) AS false_negatives,
    quantile_cont(err, 0.5) AS e50, quantile_cont(err, 0.95) AS e95,
    quantile_cont(late, 0.5) AS d50, quantile_cont(late, 0.95) AS d95
  FROM {domain} LEFT JOIN outcomes o ON {join} GROUP BY ALL),
rates AS (SELECT *, true_positives + false_negatives AS support,
    true_positives / CAST(greatest(1, true_positives + false_positives) AS DOUBLE) AS precision,
    true_positives / CAST(greatest(1, true_positives + false_negatives) AS DOUBLE) AS recall FROM sums),
overall AS (SELECT {head}class, true_positives, false_positives, false_negatives, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(2.0 * precision * recall / greatest(1e-12, precision + recall), 6) AS f1,
    round(false_positives * CAST(60 AS DOUBLE) / {duration}, 6) AS false_alerts_per_minute,
    round(coalesce(e50, 0.0), 6) AS median_absolute_onset_error_ms, round(coalesce(e95, 0.0), 6) AS p95_absolute_onset_error_ms,
    round(coalesce(d50, 0.0), 6) AS median_delivery_latency_ms, round(coalesce(d95, 0.0), 6) AS p95_delivery_latency_ms,
    support, round({LOW}, 6) AS recall_ci95_low, round({HIGH}, 6) AS recall_ci95_high, support >= 300 AS conclusive
  FROM rates)"""


def rounded(df, digits=6):
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


@query("detection_metrics", v.sql("SELECT * FROM overall", *BASE, "outcomes", extra=metrics_sql("", "CAST(3600 AS DOUBLE)")))
def detection_metrics(spark, sf_dir):
    _, _, targets, emitted, pairs = matched(spark, sf_dir)
    return rounded(metrics.detection_metrics(targets, emitted, pairs, 3600.0, v.TARGETS, rate=1))


@query("session_metrics", v.sql("SELECT * FROM overall", *BASE, "outcomes",
                                extra=metrics_sql("session_id", "CAST(3600 AS DOUBLE)")))
def session_metrics(spark, sf_dir):
    _, _, targets, emitted, pairs = matched(spark, sf_dir)
    return rounded(metrics.detection_metrics(targets, emitted, pairs, 3600.0, v.TARGETS, rate=1, by=("session_id",)))


W_LOW, W_HIGH = wilson_sql("k", "n")


@query("wilson_interval", f"""SELECT event_type AS class, k, n, round({W_LOW}, 6) AS low, round({W_HIGH}, 6) AS high
FROM (SELECT event_type, count(*) FILTER (WHERE value > 20) AS k, count(*) AS n FROM events GROUP BY event_type)""")
def wilson_interval(spark, sf_dir):
    sums = (v.events(spark, sf_dir).groupBy("class")
            .agg(F.count_if(F.col("value") > 20).alias("k"), F.count(F.lit(1)).alias("n")))
    low, high = metrics.wilson_interval(F.col("k"), F.col("n"))
    return sums.select("class", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


v.CTE["hits"] = """hits AS (SELECT t.*, t.event_id IN (SELECT tid FROM pairs) AS hit,
  CASE WHEN t.k < 20 THEN 'simple' WHEN t.k > 35 THEN 'complex' END AS stratum FROM targets t)"""
S_LOW, S_HIGH = wilson_sql("matched", "support")
SUBSETS = {
    "quiet_remote": "source_hint = 'remote' AND (scene_mode = 'quiet' OR stratum = 'simple')",
    "busy_remote": "source_hint = 'remote' AND (scene_mode = 'busy' OR stratum = 'complex')",
    "remote": "source_hint = 'remote'",
}
v.CTE["subsets"] = "subsets AS (SELECT *, matched / CAST(greatest(1, support) AS DOUBLE) AS recall FROM (" + \
    " UNION ALL ".join(
        f"""SELECT d.class, '{name}' AS subset, count(*) FILTER (WHERE hit AND {cond}) AS matched,
  count(*) FILTER (WHERE {cond}) AS support FROM {CLASS_ROWS} d(class) LEFT JOIN hits USING (class) GROUP BY d.class"""
        for name, cond in SUBSETS.items()) + "))"


def hits(spark, sf_dir):
    _, _, targets, _, pairs = matched(spark, sf_dir)
    stratum = F.when(F.col("k") < 20, "simple").when(F.col("k") > 35, "complex")
    return metrics.with_hit(targets, pairs).withColumn("stratum", stratum)


@query("recall_subset", v.sql(f"""SELECT class, subset, matched, support, round(recall, 6) AS recall,
  round({S_LOW}, 6) AS recall_ci95_low, round({S_HIGH}, 6) AS recall_ci95_high, support >= 300 AS conclusive
  FROM subsets""", *BASE, "hits", "subsets"))
def recall_subset(spark, sf_dir):
    return rounded(metrics.recall_subset(hits(spark, sf_dir), metrics.standard_subsets(), v.TARGETS))


v.CTE["rapid"] = f"""follow AS (SELECT class, hit, onset_sample, lead(onset_sample) OVER w AS nxt, lead(hit) OVER w AS nhit
  FROM hits WINDOW w AS (PARTITION BY session_id, class ORDER BY onset_sample, event_id)),
rapid AS (SELECT class, count(*) FILTER (WHERE hit AND nhit AND nxt - onset_sample BETWEEN {RAPID[0]} AND {RAPID[1]}) AS passed,
  count(*) FILTER (WHERE nxt - onset_sample BETWEEN {RAPID[0]} AND {RAPID[1]}) AS support FROM follow GROUP BY class)"""


@query("rapid_pairs", v.sql("""SELECT class, passed, support, round(passed / CAST(greatest(1, support) AS DOUBLE), 6) AS rate
  FROM rapid""", *BASE, "hits", "rapid"))
def rapid_pairs(spark, sf_dir):
    return rounded(metrics.rapid_pairs(hits(spark, sf_dir), *RAPID, v.WIDTH))


v.CTE["source"] = """source AS (SELECT ss AS self_support, rs / CAST(greatest(1, ss) AS DOUBLE) AS raw_self_recall,
  (rs - es) / CAST(greatest(1, rs) AS DOUBLE) AS self_suppression_rate, sr AS remote_support,
  rr / CAST(greatest(1, sr) AS DOUBLE) AS raw_remote_recall, er / CAST(greatest(1, sr) AS DOUBLE) AS emitted_remote_recall,
  (rr - er) / CAST(greatest(1, sr) AS DOUBLE) AS remote_recall_loss FROM (SELECT
  count(*) FILTER (WHERE source_hint = 'self') AS ss,
  count(*) FILTER (WHERE source_hint = 'self' AND event_id IN (SELECT tid FROM raw_pairs)) AS rs,
  count(*) FILTER (WHERE source_hint = 'self' AND event_id IN (SELECT tid FROM pairs)) AS es,
  count(*) FILTER (WHERE source_hint = 'remote') AS sr,
  count(*) FILTER (WHERE source_hint = 'remote' AND event_id IN (SELECT tid FROM raw_pairs)) AS rr,
  count(*) FILTER (WHERE source_hint = 'remote' AND event_id IN (SELECT tid FROM pairs)) AS er FROM targets))"""
SOURCE = """SELECT self_support, round(raw_self_recall, 6) AS raw_self_recall,
  round(self_suppression_rate, 6) AS self_suppression_rate, remote_support, round(raw_remote_recall, 6) AS raw_remote_recall,
  round(emitted_remote_recall, 6) AS emitted_remote_recall, round(remote_recall_loss, 6) AS remote_recall_loss FROM source"""


@query("source_metrics", v.sql(SOURCE, *BASE, "raw_pairs", "source"))
def source_metrics(spark, sf_dir):
    _, raw, targets, _, pairs = matched(spark, sf_dir)
    return rounded(metrics.source_metrics(targets, matching.match_events(targets, raw, v.TOL), pairs))


v.CTE["flags"] = """flags AS (SELECT s.*, s.session_id NOT IN (SELECT session_id FROM targets) AS target_free,
  s.session_id IN (SELECT session_id FROM truth WHERE scene_mode = 'busy') AS is_complex FROM sessions s)"""
v.CTE["ambient"] = f"""ambient AS (SELECT d.class, any_value(free_seconds) AS free_seconds,
  any_value(complex_seconds) AS complex_seconds,
  count(*) FILTER (WHERE f.target_free) * CAST(60 AS DOUBLE) / greatest(any_value(free_seconds), 1e-12) AS ambient_per_minute,
  count(*) FILTER (WHERE f.is_complex AND e.event_id NOT IN (SELECT pid FROM pairs)) * CAST(60 AS DOUBLE)
    / greatest(any_value(complex_seconds), 1e-12) AS complex_per_minute
  FROM {CLASS_ROWS} d(class) CROSS JOIN (SELECT coalesce(sum(duration_seconds) FILTER (WHERE target_free), 0.0) AS free_seconds,
    coalesce(sum(duration_seconds) FILTER (WHERE is_complex), 0.0) AS complex_seconds FROM flags) t
  LEFT JOIN emitted e ON e.class = d.class LEFT JOIN flags f ON f.session_id = e.session_id GROUP BY d.class)"""


@query("ambient_rates", v.sql("""SELECT class, free_seconds, complex_seconds, round(ambient_per_minute, 6) AS ambient_per_minute,
  round(complex_per_minute, 6) AS complex_per_minute FROM ambient""", *BASE, "sessions", "flags", "ambient"))
def ambient_rates(spark, sf_dir):
    truth, _, targets, emitted, pairs = matched(spark, sf_dir)
    flags = metrics.session_flags(v.sessions(spark, sf_dir), truth, targets)
    return rounded(metrics.ambient_rates(flags, emitted, pairs, v.TARGETS))


@query("session_offsets", v.sql("""SELECT session_id, length, coalesce(sum(length) OVER (ORDER BY session_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sessions""", "ev", "sessions"))
def session_offsets(spark, sf_dir):
    return metrics.session_offsets(v.sessions(spark, sf_dir)).select("session_id", "length", "offset")


@query("union_sessions", v.sql("""SELECT role, l.session_id, event_id, CAST(onset_sample + o AS BIGINT) AS onset_sample
  FROM labelled l JOIN (SELECT session_id, coalesce(sum(length) OVER (ORDER BY session_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sessions) s USING (session_id)""",
                               "ev", "labelled", "sessions"))
def union_sessions(spark, sf_dir):
    offsets = metrics.session_offsets(v.sessions(spark, sf_dir))
    columns = ["role", "session_id", "event_id", "onset_sample"]
    rows = v.labelled(spark, sf_dir)
    both = rows.filter("role = 'truth'").select(columns).unionByName(rows.filter("role = 'pred'").select(columns))
    return metrics.shift_positions(both, offsets, ["onset_sample"]).select(columns)


def report(spark, sf_dir, isolate):
    truth, raw, _, _ = load(spark, sf_dir)
    stratum = F.when(F.col("k") < 20, "simple").when(F.col("k") > 35, "complex")
    return metrics.evaluate(truth.withColumn("stratum", stratum), raw, v.sessions(spark, sf_dir),
                            classes=v.TARGETS, tol=v.TOL, rate=1, isolate_sessions=isolate, rapid_range=RAPID)


GATES = f"""support AS (SELECT d.class, count(*) FILTER (WHERE source_hint = 'remote') AS remote,
  count(*) FILTER (WHERE source_hint = 'self') AS self FROM {CLASS_ROWS} d(class) LEFT JOIN targets USING (class) GROUP BY d.class),
gates AS (SELECT (SELECT bool_and(remote >= 300) FROM support) AS locked_remote_support,
  (SELECT bool_and(self >= 200) FROM support) AS locked_self_support,
  (SELECT max(support >= 100 AND recall >= 0.95) FROM subsets WHERE subset = 'quiet_remote' AND class = '{v.TARGETS[1]}') AS quiet_remote_recall,
  (SELECT max(support >= 1 AND recall >= 0.95) FROM subsets WHERE subset = 'remote' AND class = '{v.TARGETS[0]}') AS remote_recall,
  (SELECT max(support >= 100 AND recall >= 0.95) FROM subsets WHERE subset = 'busy_remote' AND class = '{v.TARGETS[0]}') AS busy_remote_recall,
  (SELECT coalesce(bool_and(support >= 100 AND passed / CAST(greatest(1, support) AS DOUBLE) >= 0.95), false) FROM rapid WHERE class = '{v.TARGETS[0]}') AS rapid_pairs,
  (SELECT count(*) FROM duplicates) / CAST(greatest(1, (SELECT count(*) FROM pairs)) AS DOUBLE) < 0.01 AS duplicates,
  (SELECT bool_and(free_seconds >= 3600 AND ambient_per_minute <= 0.1) FROM ambient) AS ambient_false_alerts,
  (SELECT sum(complex_per_minute) <= 2.0 FROM ambient) AS complex_false_alerts,
  (SELECT bool_and(support > 0 AND p95_absolute_onset_error_ms <= 30.0) FROM overall) AS onset_accuracy,
  (SELECT bool_and(support > 0 AND median_delivery_latency_ms <= 50.0 AND p95_delivery_latency_ms <= 100.0) FROM overall) AS delivery_latency,
  (SELECT self_suppression_rate >= 0.98 FROM source) AS self_suppression,
  (SELECT remote_recall_loss <= 0.03 FROM source) AS remote_suppression_loss)"""
GATE_NAMES = ("locked_remote_support locked_self_support quiet_remote_recall remote_recall busy_remote_recall rapid_pairs "
              "duplicates ambient_false_alerts complex_false_alerts onset_accuracy delivery_latency self_suppression "
              "remote_suppression_loss").split()


@query("recognition_gates", v.sql(f"SELECT *, {' AND '.join(GATE_NAMES)} AS accepted FROM gates", *BASE, "raw_pairs", "outcomes",
                                  "hits", "subsets", "rapid", "source", "sessions", "flags", "ambient", "duplicates",
                                  extra=metrics_sql("", "CAST(1 AS DOUBLE)") + ",\n" + GATES))
def recognition_gates(spark, sf_dir):
    return report(spark, sf_dir, True)["gates"]


CONCAT = f"""offs AS (SELECT session_id, coalesce(sum(length) OVER (ORDER BY session_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM sessions),
truth AS (SELECT l.* REPLACE (onset_sample + o AS onset_sample) FROM labelled l JOIN offs USING (session_id) WHERE role = 'truth'),
pred AS (SELECT l.* REPLACE (onset_sample + o AS onset_sample, detected_sample + o AS detected_sample)
  FROM labelled l JOIN offs USING (session_id) WHERE role = 'pred'),
{v.CTE["targets"]}, {v.CTE["emitted"]}, {greedy_sql("targets", "emitted", "pairs", "class")}, {v.CTE["outcomes"]},
{metrics_sql("", "(SELECT sum(duration_seconds) FROM sessions)")}"""


@query("evaluation_report", v.sql("SELECT * FROM overall", "ev", "labelled", "sessions", extra=CONCAT))
def evaluation_report(spark, sf_dir):
    return rounded(report(spark, sf_dir, False)["overall"])
