"""Scenes, their status and display, and the batch forms of the stream operators."""

from pyspark.sql import functions as F

from soundlake.functions import scalar as s
from soundlake.operators import peaks, scenes, streams
from soundlake.operators.ordered import ordinal
from soundlake.plans import views as v
from soundlake.plans.q_events import CUTOFF, events as found_events
from soundlake.plans.registry import query
from soundlake.streaming import sinks

PRE, LENGTH, NOW, SPAN, RETAIN = 240, 2880, 40_000, 4320, 20_000
v.CTE["scenes"] = f"""so AS (SELECT session_id, event_id, class, sample, k, value, row_number() OVER (PARTITION BY session_id ORDER BY sample, event_id) AS rn FROM ev),
sw AS (SELECT session_id, event_id, class, sample, k, value, rn, sample AS anchor FROM so WHERE rn = 1
  UNION ALL SELECT n.session_id, n.event_id, n.class, n.sample, n.k, n.value, n.rn,
    CASE WHEN n.sample - w.anchor > {v.JOIN} THEN n.sample ELSE w.anchor END
  FROM sw w JOIN so n ON n.session_id = w.session_id AND n.rn = w.rn + 1),
members AS (SELECT session_id, event_id, class, sample AS onset_sample, k, value, anchor AS anchor_sample, greatest(0, anchor - {PRE}) AS scene_start,
  greatest(0, anchor - {PRE}) + {LENGTH} AS scene_end FROM sw),
scenes AS (SELECT session_id, anchor_sample, scene_start, scene_end, count(*) AS event_count, max(onset_sample) AS last_onset,
  scene_start >= {RETAIN} AS audio_available FROM members GROUP BY ALL)"""


def members(spark, sf_dir):
    rows = v.events(spark, sf_dir).withColumnRenamed("sample", "onset_sample")
    return scenes.assign_scenes(rows, v.JOIN, PRE, LENGTH, v.WIDTH)


@query("scene_groups", v.sql("SELECT session_id, event_id, onset_sample, anchor_sample, scene_start, scene_end FROM members", "ev", "scenes"))
def scene_groups(spark, sf_dir):
    return members(spark, sf_dir).select("session_id", "event_id", "onset_sample", "anchor_sample", "scene_start", "scene_end")


@query("scene_table", v.sql("SELECT * FROM scenes", "ev", "scenes"))
def scene_table(spark, sf_dir):
    return scenes.scene_table(members(spark, sf_dir), oldest=RETAIN)


STATUS = """CASE WHEN event_count % 8 = 0 THEN 'disabled' WHEN last_onset % 11 = 0 THEN 'model-unavailable' WHEN NOT audio_available THEN 'audio-unavailable'
  WHEN last_onset % 13 = 0 THEN 'inference-failed' WHEN event_count >= 2 THEN 'estimated' ELSE 'low-confidence' END"""


def results(spark, sf_dir):
    table, last = scenes.scene_table(members(spark, sf_dir), oldest=RETAIN), F.col("last_onset")
    return table.withColumn("status", scenes.scene_status(
        F.col("event_count") % 8, last % 11 != 0, F.col("audio_available"), last % 13 == 0, F.col("event_count") - 1))


@query("scene_status", v.sql(f"SELECT session_id, anchor_sample, {STATUS} AS status FROM scenes", "ev", "scenes"))
def scene_status(spark, sf_dir):
    return results(spark, sf_dir).select("session_id", "anchor_sample", "status")


@query("scene_fanout", v.sql(f"""SELECT m.session_id, m.event_id, m.class, s.anchor_sample, {STATUS} AS status, s.event_count
  FROM members m JOIN scenes s USING (session_id, anchor_sample)""", "ev", "scenes"))
def scene_fanout(spark, sf_dir):
    return scenes.scene_fanout(members(spark, sf_dir), results(spark, sf_dir)).select(
        "session_id", "event_id", "class", "anchor_sample", "status", "event_count")


@query("enabled_class_filter", v.sql("""SELECT event_id, class FROM ev WHERE ((k % 8) >> CASE class WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) & 1 = 1""", "ev"))
def enabled_class_filter(spark, sf_dir):
    index = F.when(F.col("class") == "click", 0).when(F.col("class") == "view", 1).otherwise(2)
    return v.events(spark, sf_dir).filter(scenes.class_enabled(index, F.col("k") % 8)).select("event_id", "class")


@query("visible_interval", v.sql(f"""SELECT session_id, event_id FROM labelled WHERE end_sample >= {NOW - SPAN} AND onset_sample <= {NOW}""", "ev", "labelled"))
def visible_interval(spark, sf_dir):
    return scenes.visible_interval(v.labelled(spark, sf_dir), F.lit(NOW), SPAN).select("session_id", "event_id")


@query("recent_events", v.sql("""SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS INTEGER) AS recency,
  delivered FROM (SELECT session_id, event_id, CAST(1000 * (detected_sample - onset_sample) AS DOUBLE) AS delivered FROM labelled)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) <= 16""", "ev", "labelled"))
def recent_events(spark, sf_dir):
    rows = v.labelled(spark, sf_dir).withColumn("delivered", s.delivery_ms(F.col("detected_sample"), F.col("onset_sample"), 1))
    rows = rows.withColumn("sequence", F.col("event_id"))
    return scenes.recent_events(rows, ["session_id"], 16).select("session_id", "event_id", "recency", "delivered")


@query("active_markers", v.sql(f"""SELECT event_id, round(greatest(0.0, least(1.0, 1 - age / ttl)), 6) AS fade,
  round(CASE WHEN k >= 50 THEN greatest(0.25, c) ELSE greatest(0.16, c * 0.65) END, 6) AS visible_confidence FROM (
    SELECT *, CAST({NOW} - sample AS DOUBLE) AS age, CASE WHEN class = 'click' THEN CAST(2000 AS DOUBLE) ELSE CAST(800 AS DOUBLE) END AS ttl,
      least(value / 100, 1.0) AS c FROM ev) WHERE age >= 0 AND age < ttl""", "ev"))
def active_markers(spark, sf_dir):
    rows = v.events(spark, sf_dir).withColumns({
        "created_seconds": F.col("sample").cast("double"), "confidence": F.least(F.col("value") / 100, F.lit(1.0)),
        "status": F.when(F.col("k") >= 50, "estimated").otherwise("low-confidence")})
    shown = scenes.active_markers(rows, F.lit(float(NOW)), {"click": 2000.0}, 800.0)
    return shown.select("event_id", F.round("fade", 6).alias("fade"), F.round("visible_confidence", 6).alias("visible_confidence"))


@query("suppress_self", v.sql("""SELECT event_id, source_probs[1] >= 0.8 AS suppressed,
  CASE WHEN source_probs[1] >= 0.8 THEN 'self' ELSE ['self', 'remote', 'unknown'][list_position(source_probs, list_max(source_probs))] END AS source_hint,
  round(CASE WHEN source_probs[1] >= 0.8 THEN source_probs[1] ELSE list_max(source_probs) END, 6) AS source_confidence FROM trace""", "ev", "trace"))
def suppress_self(spark, sf_dir):
    return peaks.suppress_self(v.trace(spark, sf_dir), 0.8).select(
        "event_id", "suppressed", "source_hint", F.round("source_confidence", 6).alias("source_confidence"))


@query("scene_state", v.sql(f"SELECT event_id, CASE WHEN activity < {CUTOFF} THEN 'quiet' ELSE 'busy' END AS state FROM trace", "ev", "trace"))
def scene_state(spark, sf_dir):
    return v.trace(spark, sf_dir).select("event_id", peaks.scene_state(F.col("activity"), CUTOFF).alias("state"))


@query("suppressed_not_published", v.sql("""SELECT session_id, count(*) AS found, count(*) FILTER (WHERE source_probs[1] >= 0.8) AS suppressed,
  count(*) FILTER (WHERE source_probs[1] < 0.8) AS published FROM spaced GROUP BY session_id""", "ev", "trace", "peaks", "spaced"))
def suppressed_not_published(spark, sf_dir):
    rows = found_events(spark, sf_dir, self_threshold=0.8)
    delivered = sinks.published(rows).groupBy("session_id").agg(F.count(F.lit(1)).alias("published"))
    return sinks.counted(rows, ["session_id"]).join(delivered, "session_id", "left").withColumn("published", F.coalesce("published", F.lit(0)))


@query("event_order", v.sql("""SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY detected_sample, class, event_id) AS place
  FROM labelled""", "ev", "labelled"))
def event_order(spark, sf_dir):
    """Place of each event in its session by (detected, class)."""
    rows = ordinal(v.labelled(spark, sf_dir), ["session_id"], "detected_sample", ["class", "event_id"], v.WIDTH, "_n")
    return rows.select("session_id", "event_id", (F.col("_n") + 1).alias("place"))


# --- block streams -------------------------------------------------------------------------------------

BLOCK = 720
v.CTE["blocks"] = f"""blocks AS (SELECT session_id, sample // {BLOCK} * {BLOCK} AS first_sample, {BLOCK} AS frames, count(*) AS n, sum(k) AS load
  FROM ev GROUP BY ALL)"""


def blocks(spark, sf_dir):
    return (v.events(spark, sf_dir).withColumn("first_sample", F.floor(F.col("sample") / BLOCK).cast("bigint") * BLOCK)
            .groupBy("session_id", "first_sample").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("load"))
            .withColumn("frames", F.lit(BLOCK)))


@query("stream_generations", v.sql(f"""SELECT session_id, first_sample, CAST(sum(CASE WHEN opened THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) AS stream_generation,
  first_sample - max(CASE WHEN opened THEN first_sample END) OVER w AS generation_sample, opened AS discontinuity
  FROM (SELECT *, coalesce(first_sample <> lag(first_sample + frames) OVER (PARTITION BY session_id ORDER BY first_sample), true) AS opened FROM blocks)
  WINDOW w AS (PARTITION BY session_id ORDER BY first_sample)""", "ev", "blocks"))
def stream_generations(spark, sf_dir):
    return streams.stream_generations(blocks(spark, sf_dir), ["session_id"], "first_sample", "frames", v.WIDTH).select(
        "session_id", "first_sample", "stream_generation", "generation_sample", "discontinuity")


@query("audio_retention", v.sql(f"""SELECT session_id, first_sample, greatest(first_sample, oldest) AS retained_first,
  first_sample + frames - greatest(first_sample, oldest) AS retained_frames FROM (SELECT *, greatest(0, max(first_sample + frames)
  OVER (PARTITION BY session_id) - {RETAIN}) AS oldest FROM blocks) WHERE first_sample + frames > oldest""", "ev", "blocks"))
def audio_retention(spark, sf_dir):
    return streams.retained(blocks(spark, sf_dir), ["session_id"], "first_sample", "frames", RETAIN).select(
        "session_id", "first_sample", "retained_first", "retained_frames")


@query("backlog_policy", v.sql("""SELECT session_id, first_sample, load > 120 AS shed, CASE WHEN load > 120 THEN load - 40 ELSE 0 END::BIGINT AS discarded FROM blocks""", "ev", "blocks"))
def backlog_policy(spark, sf_dir):
    return streams.backlog_audit(blocks(spark, sf_dir), "load", 120, 40).select("session_id", "first_sample", "shed", "discarded")


@query("block_levels", v.sql(f"""SELECT session_id, sample // {BLOCK} AS block, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak
  FROM ev GROUP BY ALL""", "ev"))
def block_levels(spark, sf_dir):
    rows = v.events(spark, sf_dir).withColumn("block", F.floor(F.col("sample") / BLOCK))
    levels = streams.signal_levels(rows, ["session_id", "block"], "value")
    return levels.withColumns({"rms": F.round("rms", 6), "peak": F.round("peak", 6)})


@query("vector_levels", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms,
  round(CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE), 6) AS peak FROM embeddings""")
def vector_levels(spark, sf_dir):
    levels = streams.block_levels(v.table(spark, sf_dir, "embeddings"), "embedding")
    return levels.select("vec_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query("latency_stats", v.sql("""SELECT class, arg_max(value, event_id) AS last_ms, max(value) AS max_ms,
  list_sort(list(value))[least(len(list(value)), CAST(floor(len(list(value)) * 0.95) AS BIGINT) + 1)] AS p95_ms
  FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY class ORDER BY event_id DESC) <= 256) GROUP BY class""", "ev"))
def latency_stats(spark, sf_dir):
    return streams.latency_stats(v.events(spark, sf_dir), ["class"], "value", "event_id")


@query("live_state", v.sql("""SELECT session_id, arg_max(event_id, (sample, event_id)) AS event_id, arg_max(probability, (sample, event_id)) AS probability,
  arg_max(activity, (sample, event_id)) AS activity, max(sample) AS sample FROM trace GROUP BY session_id""", "ev", "trace"))
def live_state(spark, sf_dir):
    return streams.live_state(v.trace(spark, sf_dir), ["session_id"], ["sample", "event_id"], ["event_id", "probability", "activity", "sample"])


@query("policy_join", v.sql("""SELECT e.session_id, e.event_id, p.cutoff FROM ev e LEFT JOIN LATERAL (SELECT k AS cutoff FROM ev p
  WHERE p.session_id = e.session_id AND p.class = 'signup' AND p.sample < e.sample ORDER BY p.sample DESC, p.event_id DESC LIMIT 1) p ON true
  WHERE e.class <> 'signup'""", "ev"))
def policy_join(spark, sf_dir):
    """Sign-up events carry a new policy value for their stream."""
    rows = v.events(spark, sf_dir)
    policies = rows.filter("class = 'signup'").groupBy("session_id", F.col("sample").alias("since")).agg(
        F.max_by("k", "event_id").alias("cutoff"))
    data = rows.filter("class <> 'signup'").select("session_id", "event_id", "sample")
    return streams.policy_join(data, policies, ["session_id"], "sample", "since", v.WIDTH).select("session_id", "event_id", "cutoff")
