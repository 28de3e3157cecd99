"""The event tables replayed as streams; results equal the batch operators."""

from pyspark.sql import functions as F

from soundlake.plans import views as v
from soundlake.operators import streams
from soundlake.plans.q_events import BUSY, CUTOFF, LOOK, PEAK_EVENTS, QUIET
from soundlake.plans.q_features import BANDS, FFT, HOP, MEL, RATE, chunks
from soundlake.plans.q_scenes import LENGTH, PRE, RETAIN, blocks
from soundlake.plans.registry import query
from soundlake.session import is_local, scratch_path
from soundlake.streaming import processors, recogniser, sinks

def replayed(spark, rows, at, keys=("session_id",), ends=None, **how):
    """``rows`` as a stream in order of ``at``, written by one job in parallel; ``ends`` close it."""
    path = scratch_path(spark, "replay")
    if ends is not None:
        rows = rows.unionByName(ends.select(*[F.col(c.name) if c.name in ends.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema]))
    most = sinks.deal_by_time(rows, path, at, keys, **how)
    return sinks.replay(spark, path, rows.schema, most)


def finished(spark, stream):
    """Run the stream to its end.  A stream's state has as many partitions as the session names; a local
    session needs no more than it has cores."""
    out, name = scratch_path(spark, "stream"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    recogniser.use_typed_state(spark)
    if is_local(spark):
        spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        sinks.run_to_table(stream, out, scratch_path(spark, "offsets"))
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(out)


def scored(spark, sf_dir, spell=1 << 40):
    """The trace as score rows; a generation lasts ``spell`` minutes."""
    generation = F.floor(F.col("sample") / spell).cast("bigint")
    return v.trace(spark, sf_dir).select("session_id", "class", "sample", "event_id", "probability", "activity", "source_probs", generation.alias("stream_generation"))


def recognised(spark, rows, policies=None):
    """Events of score rows and policies replayed as one stream that ends after its last row."""
    ends = rows.groupBy("session_id", "class").agg((F.max("sample") + 1).alias("sample")).withColumns({"kind": F.lit("end"), "event_id": F.lit(1 << 60)})
    if policies is None:
        policies = rows.select("session_id", "class", F.col("sample").alias("since")).limit(0)
    both = recogniser.with_controls(rows, policies)
    stream = recogniser.recognise(replayed(spark, both, "sample", ("session_id", "class"), ends), quiet=QUIET, busy=BUSY, cutoff=CUTOFF, spacing=v.SPACING,
                                  lookahead=LOOK, onset_offset=30, pulse=60)
    return finished(spark, stream)


@query("stream_peaks", v.sql("SELECT session_id, class, sample, event_id, probability, detected FROM spaced", "ev", "trace", "peaks", "spaced"))
def stream_peaks(spark, sf_dir):
    return recognised(spark, scored(spark, sf_dir)).select("session_id", "class", "sample", "event_id", F.col("confidence").alias("probability"), F.col("detected_sample").alias("detected"))


@query("stream_events", v.sql(PEAK_EVENTS, "ev", "trace", "peaks", "spaced"))
def stream_events(spark, sf_dir):
    """All columns of an event, as in batch."""
    return recognised(spark, scored(spark, sf_dir)).drop("delivered_sample", "stream_generation").withColumn("source_confidence", F.round("source_confidence", 6))


# the policy changes for everyone at these positions: thresholds go up, then down below the first ones
CHANGES = ((10_000, 0.3, 0.5, 0.8), (28_000, 0.01, 0.02, 0.6))
LEVELS = "(" + ", ".join(f"({s}, CAST({q} AS DOUBLE), CAST({b} AS DOUBLE), CAST({t} AS DOUBLE))" for s, q, b, t in ((-1, QUIET, BUSY, .95), *CHANGES)) + ")"
JUDGED = f"""judged AS (SELECT *, coalesce(lead(sample, {LOOK}) OVER w, max(sample) OVER (PARTITION BY session_id, class) + 1) AS judged_at,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND {LOOK} FOLLOWING) AS around,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING) AS before,
  last_value(sample) OVER (w ROWS BETWEEN CURRENT ROW AND {LOOK} FOLLOWING) AS detected
  FROM trace WINDOW w AS (PARTITION BY session_id, class ORDER BY sample, event_id)),
levels(since, q, b, t) AS (VALUES {LEVELS[1:-1]}),
peaks AS (SELECT j.*, l.t AS self_at FROM judged j ASOF JOIN levels l ON j.judged_at > l.since
  WHERE probability >= CASE WHEN activity < {CUTOFF} THEN l.q ELSE l.b END AND probability >= around AND (before IS NULL OR probability > before))"""


@query("policy_driven_events", v.sql("""SELECT session_id, class, event_id, sample, detected AS detected_sample, self_at <= source_probs[1] AS suppressed FROM spaced""",
                                     "ev", "trace", extra=JUDGED + ",\n" + v.CTE["spaced"]))
def policy_driven_events(spark, sf_dir):
    """Policies ride in the stream and change what is recognised from the next row on."""
    rows = scored(spark, sf_dir)
    changes = spark.createDataFrame(CHANGES, "since bigint, quiet double, busy double, self_threshold double")
    policies = rows.select("session_id", "class").distinct().join(F.broadcast(changes), F.lit(True))
    return recognised(spark, rows, policies).select("session_id", "class", "event_id", "sample", "detected_sample", "suppressed")


SPELL = 6_000  # minutes of a generation
PARTED = f"""numbered AS (SELECT *, sample // {SPELL} AS generation, max(sample // {SPELL}) OVER (PARTITION BY session_id, class) AS final_generation FROM trace),
marked AS (SELECT *, lead(sample, {LOOK}) OVER w AS complete,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND {LOOK} FOLLOWING) AS around,
  max(probability) OVER (w ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING) AS before
  FROM numbered WINDOW w AS (PARTITION BY session_id, class, generation ORDER BY sample, event_id)),
seen AS (SELECT session_id, class, generation, max(sample) AS judged_to FROM marked WHERE complete IS NOT NULL OR generation = final_generation GROUP BY ALL),
ranked_peaks AS (SELECT *, row_number() OVER (PARTITION BY session_id, class, generation ORDER BY sample, event_id) AS rn FROM marked
  WHERE (complete IS NOT NULL OR generation = final_generation) AND probability >= CASE WHEN activity < {CUTOFF} THEN {QUIET} ELSE {BUSY} END
  AND probability >= around AND (before IS NULL OR probability > before)),
walk AS (SELECT session_id, class, generation, final_generation, rn, sample AS kept, probability AS kp, event_id AS kid, CAST(NULL AS BIGINT) AS final FROM ranked_peaks WHERE rn = 1
  UNION ALL SELECT n.session_id, n.class, n.generation, n.final_generation, n.rn,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.sample ELSE w.kept END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.probability ELSE w.kp END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} OR n.probability > w.kp THEN n.event_id ELSE w.kid END,
    CASE WHEN n.sample - w.kept >= {v.SPACING} THEN w.kid END
  FROM walk w JOIN ranked_peaks n ON n.session_id = w.session_id AND n.class = w.class AND n.generation = w.generation AND n.rn = w.rn + 1),
delivered AS (SELECT final AS event_id FROM walk WHERE final IS NOT NULL UNION ALL
  SELECT kid FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY session_id, class, generation ORDER BY rn DESC) = 1) w JOIN seen USING (session_id, class, generation)
  WHERE w.generation = final_generation OR judged_to - kept >= {v.SPACING})"""


@query("stream_generation_events", v.sql("SELECT session_id, class, event_id, sample, generation AS stream_generation FROM ranked_peaks WHERE event_id IN (SELECT event_id FROM delivered)",
                                         "ev", "trace", extra=PARTED))
def stream_generation_events(spark, sf_dir):
    """A new generation drops the candidate and the rows that the old one has pending."""
    rows = scored(spark, sf_dir, SPELL)
    return recognised(spark, rows).select("session_id", "class", "event_id", "sample", "stream_generation")


LOSSES = """fed AS (SELECT *, CASE WHEN first_sample // 7200 % 2 = 0 THEN 'speakers' ELSE 'headset' END AS endpoint, CASE WHEN load % 17 = 0 THEN load ELSE 0 END AS lost FROM blocks),
flags AS (SELECT *, coalesce(first_sample <> lag(first_sample + frames) OVER w OR endpoint <> lag(endpoint) OVER w, true) AS reset, lost > 0 AS overflow, load > 120 AS shed FROM fed
  WINDOW w AS (PARTITION BY session_id ORDER BY first_sample))"""
LOSSES_SQL = """SELECT session_id, first_sample, reset, overflow, shed, CAST(sum(reset::INT + overflow::INT + shed::INT) OVER w - 1 AS BIGINT) AS stream_generation,
  first_sample - max(CASE WHEN reset OR overflow OR shed THEN first_sample END) OVER w AS generation_sample, CAST(sum(lost) OVER w AS BIGINT) AS lost_total,
  CAST(sum(CASE WHEN shed THEN load - 40 ELSE 0 END) OVER w AS BIGINT) AS discarded_total FROM flags WINDOW w AS (PARTITION BY session_id ORDER BY first_sample)"""


def fed(spark, sf_dir):
    load = F.col("load")
    return blocks(spark, sf_dir).select("session_id", "first_sample", F.col("frames").cast("bigint").alias("frames"), F.when(F.floor(F.col("first_sample") / 7200) % 2 == 0, "speakers").otherwise("headset").alias("endpoint"),
                                        F.when(load % 17 == 0, load).otherwise(0).cast("bigint").alias("lost"), load.cast("bigint").alias("available"))


LOSS_COLUMNS = ("session_id", "first_sample", "reset", "overflow", "shed", "stream_generation", "generation_sample", "lost_total", "discarded_total")


@query("generation_losses", v.sql(LOSSES_SQL, "ev", "blocks", extra=LOSSES))
def generation_losses(spark, sf_dir):
    """Gap, endpoint, overflow and backlog each open a generation."""
    return streams.generation_losses(fed(spark, sf_dir), ["session_id"], "first_sample", "frames", v.WIDTH, limit=120, keep=40).select(*LOSS_COLUMNS)


@query("stream_losses", v.sql(LOSSES_SQL, "ev", "blocks", extra=LOSSES))
def stream_losses(spark, sf_dir):
    return finished(spark, recogniser.stream_losses(replayed(spark, fed(spark, sf_dir), "first_sample"), 120, 40)).select(*LOSS_COLUMNS)


@query("stream_live_state", v.sql(f"""SELECT session_id, sample // {SPELL} AS stream_generation, max(sample) AS sample, arg_max(event_id, (sample, event_id)) AS event_id,
  CASE WHEN arg_max(source_probs[1], (sample, event_id)) < 0.8 THEN arg_max(probability, (sample, event_id)) END AS probability
  FROM (SELECT * FROM trace WHERE source_probs[1] < 0.8 OR sample % 7 = 0) GROUP BY session_id, sample // {SPELL}
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sample // {SPELL} DESC) = 1""", "ev", "trace"))
def stream_live_state(spark, sf_dir):
    """The latest published row of each stream; a newer generation clears an older one, and so do rows without a value (here: some of the suppressed)."""
    rows = scored(spark, sf_dir, SPELL).withColumn("suppressed", F.col("source_probs")[0] >= 0.8)
    stream = replayed(spark, rows, "sample")
    clears = stream.filter("suppressed and sample % 7 = 0").withColumn("probability", F.lit(None).cast("double"))
    shown = sinks.published(stream).unionByName(clears)
    return recogniser.run_live_state(shown, ["session_id"], ["sample", "event_id"], ["probability"])


@query("stream_scenes", v.sql("SELECT session_id, event_id, onset_sample, anchor_sample, scene_start, scene_end FROM members", "ev", "scenes"))
def stream_scenes(spark, sf_dir):
    """Every event also moves the clock to its position; arrival is by (position, id)."""
    rows = v.events(spark, sf_dir).select("session_id", F.col("sample").alias("onset_sample"), "event_id", F.lit(0).alias("stream_generation"))
    marks = F.explode(F.array(F.struct(F.lit("event").alias("kind"), F.lit(0).alias("step")), F.struct(F.lit("clock").alias("kind"), F.lit(1).alias("step")))).alias("m")
    both = rows.select("*", marks).select("session_id", "onset_sample", "event_id", "stream_generation", "m.kind", "m.step")
    ends = rows.groupBy("session_id").agg((F.max("onset_sample") + 1).alias("onset_sample")).withColumns({"kind": F.lit("end"), "event_id": F.lit(1 << 60), "step": F.lit(2)})
    out = processors.stream_scenes(replayed(spark, both, "onset_sample", ends=ends), join=v.JOIN, pre_anchor=PRE, length=LENGTH,
                                   order=("onset_sample", "event_id", "step"))
    return finished(spark, out).select("session_id", "event_id", "onset_sample", "anchor_sample", "scene_start", "scene_end")


@query("stream_generations_live", v.sql("""SELECT session_id, first_sample, CAST(sum(CASE WHEN opened THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) AS stream_generation,
  first_sample - max(CASE WHEN opened THEN first_sample END) OVER w AS generation_sample
  FROM (SELECT *, coalesce(first_sample <> lag(first_sample + frames) OVER (PARTITION BY session_id ORDER BY first_sample), true) AS opened FROM blocks)
  WINDOW w AS (PARTITION BY session_id ORDER BY first_sample)""", "ev", "blocks"))
def stream_generations_live(spark, sf_dir):
    stream = replayed(spark, blocks(spark, sf_dir), "first_sample")
    return finished(spark, processors.stream_generations(stream, ["session_id"])).drop("discontinuity")


@query("stream_retention", v.sql(f"""SELECT session_id, first_sample, greatest(start, first_sample + frames - {RETAIN // 10}) AS oldest_sample, first_sample + frames AS newest_sample FROM (
  SELECT *, max(CASE WHEN opened THEN first_sample END) OVER (PARTITION BY session_id ORDER BY first_sample) AS start
  FROM (SELECT *, coalesce(first_sample <> lag(first_sample + frames) OVER (PARTITION BY session_id ORDER BY first_sample), true) AS opened FROM blocks))""", "ev", "blocks"))
def stream_retention(spark, sf_dir):
    return finished(spark, processors.stream_retention(replayed(spark, blocks(spark, sf_dir), "first_sample"), RETAIN // 10))


@query("stream_features", v.sql("""SELECT session_id, frame_idx, mel, round(pcen, 5) AS pcen, round(db, 4) AS db, round(ild, 5) + 0.0 AS ild, round(cre, 5) + 0.0 AS coh_re, round(cim, 5) + 0.0 AS coh_im FROM feat""", *MEL, "pcen"))
def stream_features(spark, sf_dir):
    """Chunks are replayed a few at a time, by chunk position."""
    stream = replayed(spark, chunks(spark, sf_dir), "first_sample")
    out = finished(spark, processors.stream_features(stream, rate=RATE, fft=FFT, hop=HOP, bands=BANDS))
    flat = out.withColumns({f"p{i}": F.col("planes")[i] for i in range(5)}).select("session_id", "frame_idx", F.posexplode(F.arrays_zip(*[f"p{i}" for i in range(5)])).alias("mel", "z"))
    return flat.select("session_id", "frame_idx", "mel", F.round("z.p0", 5).alias("pcen"), F.round("z.p1", 4).alias("db"), *[(F.round(f"z.p{i}", 5) + 0.0).alias(n) for i, n in ((2, "ild"), (3, "coh_re"), (4, "coh_im"))])


@query("stream_event_log", v.sql("""SELECT event_id, class, 2 AS schema_version, k % 4 IN (1, 3) AS click_on, least(k % 5, 3) AS listed, k % 5 AS source_count FROM ev""", "ev"))
def stream_event_log(spark, sf_dir):
    source = F.struct(F.lit(10.0).alias("azimuth_degrees"), F.lit(0.5).alias("confidence"))
    rows = v.events(spark, sf_dir).select("session_id", "event_id", "class", "sample", (F.col("k") % 4).alias("enabled_class_mask"),
                                          F.array_repeat(source, (F.col("k") % 5).cast("int")).alias("sources"))
    out = scratch_path(spark, "log")
    sinks.write_log(sinks.log_lines(replayed(spark, rows, "sample"), {"click": 0, "view": 1}), out, scratch_path(spark, "offsets")).awaitTermination()
    lines = spark.read.text(out).select(F.from_json("value", "schema_version int, event_id bigint, class string, enabled_classes struct<click:boolean,view:boolean>, "
                                                    "direction_source_count int, sources array<struct<confidence:double>>").alias("j"))
    return lines.select("j.event_id", "j.class", "j.schema_version", F.col("j.enabled_classes.click").alias("click_on"), F.size("j.sources").alias("listed"),
                        F.col("j.direction_source_count").alias("source_count"))


@query("policy_reload", v.sql("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY (sample - low) * 24 // (high - low + 1)) AS INTEGER) AS version
  FROM ev CROSS JOIN (SELECT min(sample) AS low, max(sample) AS high FROM ev)""", "ev"))
def policy_reload(spark, sf_dir):
    """The policy table gets a new version while the stream runs; each batch (a stretch of time, one file) uses the one in force then."""
    rows = v.events(spark, sf_dir).select("event_id", "sample")
    policies, out = scratch_path(spark, "policy"), scratch_path(spark, "stream")

    def publish(version):
        spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{policies}/{version}")
    current = {"version": 1}
    publish(1)

    def handle(batch, number):
        batch.write.mode("append").parquet(out)
        current["version"] += 1
        publish(current["version"])
    sinks.with_current_policy(replayed(spark, rows, "sample", ("event_id",), pieces=24, salts=1), lambda: spark.read.parquet(f"{policies}/{current['version']}"), [], handle,
                              scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "version")
