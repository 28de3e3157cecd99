"""Signals made of event values (one sample per event in time order) and clips made of embeddings."""


from pyspark.sql import functions as F

from soundlake.functions import scalar as s
from soundlake.functions import tables
from soundlake.operators import features, smoothing, tensors
from soundlake.operators.ordered import ordinal
from soundlake.plans import views as v
from soundlake.plans.registry import query

FFT, HOP, BANDS, CHUNK, RATE = 16, 4, 4, 24, 48000
TRACE_KEYS = ["session_id"]


def signal(spark, sf_dir):
    """(session_id, idx, value, other): the user's event values, and ``k`` as second channel."""
    return ordinal(v.events(spark, sf_dir), TRACE_KEYS, "sample", ["event_id"], v.WIDTH, "idx").select(
        "session_id", "idx", "value", F.col("k").cast("double").alias("other"), "event_id")


def chunks(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("chunk_idx", F.floor(F.col("idx") / CHUNK).cast("bigint"))
    packed = rows.groupBy("session_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "value", "other"))).alias("x"))
    return packed.select("session_id", (F.col("chunk_idx") * CHUNK).alias("first_sample"),
                         F.transform("x", lambda x: x["value"]).alias("left"), F.transform("x", lambda x: x["other"]).alias("right"))


v.CTE["signal"] = """signal AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sample, event_id) - 1 AS idx, value,
  CAST(k AS DOUBLE) AS other, event_id FROM ev),
sizes AS (SELECT session_id, count(*) AS n FROM signal GROUP BY session_id)"""
v.CTE["frames"] = f"""frames AS (SELECT s.session_id, f.frame_idx, s.idx - f.frame_idx * {HOP} AS "offset", s.value, s.other
  FROM sizes z, LATERAL (SELECT unnest(range(0, CASE WHEN z.n >= {FFT} THEN 1 + (z.n - {FFT}) // {HOP} ELSE 0 END)) AS frame_idx) f
  JOIN signal s ON s.session_id = z.session_id AND s.idx BETWEEN f.frame_idx * {HOP} AND f.frame_idx * {HOP} + {FFT - 1})"""
HANN = f"(0.5 * (1 - cos(2 * pi() * \"offset\" / {FFT - 1})))"
v.CTE["dft"] = f"""dft AS (SELECT session_id, frame_idx, bin, sum(value * {HANN} * cos(2 * pi() * bin * "offset" / {FFT})) AS lre,
  -sum(value * {HANN} * sin(2 * pi() * bin * "offset" / {FFT})) AS lim, sum(other * {HANN} * cos(2 * pi() * bin * "offset" / {FFT})) AS rre,
  -sum(other * {HANN} * sin(2 * pi() * bin * "offset" / {FFT})) AS rim FROM frames, range({FFT // 2 + 1}) b(bin) GROUP BY ALL)"""
BANK = features.mel_filterbank(RATE, FFT, BANDS)
BANK_ROWS = ", ".join(f"({m}, {b}, CAST({float(BANK[m, b])!r} AS DOUBLE))" for m in range(BANDS) for b in range(FFT // 2 + 1))
v.CTE["mel"] = f"""bank(mel, bin, w) AS (VALUES {BANK_ROWS}),
mel AS (SELECT session_id, frame_idx, mel, sum(w * (lre * lre + lim * lim)) / {FFT * FFT} AS l, sum(w * (rre * rre + rim * rim)) / {FFT * FFT} AS r,
  sum(w * (lre * rre + lim * rim)) / {FFT * FFT} AS cre, sum(w * (lim * rre - lre * rim)) / {FFT * FFT} AS cim,
  sum(w * ((lre + rre) * (lre + rre) + (lim + rim) * (lim + rim))) / {4 * FFT * FFT} AS mono FROM dft JOIN bank USING (bin) GROUP BY ALL)"""
v.CTE["pcen"] = """energy AS (SELECT session_id, frame_idx, mel, 0.5 * (l + r) AS e, l, r, cre, cim FROM mel),
ema AS (SELECT session_id, frame_idx, mel, e, e AS m FROM energy WHERE frame_idx = 0
  UNION ALL SELECT n.session_id, n.frame_idx, n.mel, n.e, CAST(0.975 AS DOUBLE) * p.m + CAST(0.025 AS DOUBLE) * n.e
  FROM ema p JOIN energy n ON n.session_id = p.session_id AND n.mel = p.mel AND n.frame_idx = p.frame_idx + 1),
feat AS (SELECT a.session_id, a.frame_idx, a.mel, sqrt(a.e / pow(1e-6 + a.m, 0.98) + 2) - sqrt(CAST(2 AS DOUBLE)) AS pcen,
  greatest(-100.0, least(0.0, 10 * log10(greatest(a.e, 1e-10)))) AS db,
  greatest(-1.0, least(1.0, 10 * log10((g.l + 1e-10) / (g.r + 1e-10)) / 30)) AS ild,
  greatest(-1.0, least(1.0, g.cre / (sqrt(g.l * g.r) + 1e-10))) AS cre, greatest(-1.0, least(1.0, g.cim / (sqrt(g.l * g.r) + 1e-10))) AS cim
  FROM ema a JOIN energy g USING (session_id, frame_idx, mel))"""
SIG = ("ev", "signal")
MEL = (*SIG, "frames", "dft", "mel")


FRAMED = v.sql('SELECT session_id, frame_idx, CAST("offset" AS INTEGER) AS "offset", value FROM frames', *SIG, "frames")


@query("frame_signal", FRAMED)
def frame_signal(spark, sf_dir):
    return features.frame_signal(signal(spark, sf_dir), FFT, HOP)


@query("sql_frames", FRAMED)
def sql_frames(spark, sf_dir):
    """Framing written in SQL, by a table function."""
    tables.register(spark)
    parts = chunks(spark, sf_dir).select("session_id", "first_sample", "left")
    return spark.sql("""WITH sizes AS (SELECT session_id, max(first_sample + size(left)) AS length FROM {chunks} GROUP BY session_id)
      SELECT c.session_id, f.frame_idx, f.offset, f.value FROM {chunks} c JOIN sizes s ON s.session_id = c.session_id,
        LATERAL frames_of(c.first_sample, c.left, s.length, %d, %d) f""" % (FFT, HOP), chunks=parts)


@query("sql_window_ends", v.sql("""SELECT session_id, idx + 1 AS window_end FROM signal JOIN sizes USING (session_id) WHERE idx % 20 = 0 OR idx = n - 1 OR value > 80""", *SIG))
def sql_window_ends(spark, sf_dir):
    """Window ends written in SQL, by a table function over a row per session."""
    tables.register(spark)
    return spark.sql("""SELECT s.session_id, w.window_end FROM (SELECT session_id, max(idx) + 1 AS frames, collect_list(CASE WHEN value > 80 THEN idx END) AS positives
      FROM {signal} GROUP BY session_id) s, LATERAL window_ends_of(s.frames, 20, s.positives) w""", signal=signal(spark, sf_dir))


@query("stft", v.sql("""SELECT session_id, frame_idx, bin, round(lre, 4) + 0.0 AS left_re, round(lim, 4) + 0.0 AS left_im, round(rre, 4) + 0.0 AS right_re, round(rim, 4) + 0.0 AS right_im
  FROM dft""", *SIG, "frames", "dft"))
def stft(spark, sf_dir):
    rows = features.stft(chunks(spark, sf_dir), FFT, HOP, 8)
    names = ("left_re", "left_im", "right_re", "right_im")
    flat = rows.select("session_id", "frame_idx", F.posexplode(F.arrays_zip(*names)).alias("bin", "z"))
    return flat.select("session_id", "frame_idx", F.col("bin").cast("bigint").alias("bin"), *[(F.round(f"z.{n}", 4) + 0.0).alias(n) for n in names])


def mel_rows(spark, sf_dir):
    return features.mel_project(chunks(spark, sf_dir), RATE, FFT, HOP, BANDS, 8)


@query("mel_project", v.sql("""SELECT session_id, frame_idx, mel, round(l, 4) AS left_mel, round(r, 4) AS right_mel FROM mel""", *MEL))
def mel_project(spark, sf_dir):
    flat = mel_rows(spark, sf_dir).select("session_id", "frame_idx", F.posexplode(F.arrays_zip("left_mel", "right_mel")).alias("mel", "z"))
    return flat.select("session_id", "frame_idx", "mel", F.round("z.left_mel", 4).alias("left_mel"), F.round("z.right_mel", 4).alias("right_mel"))


@query("log_mel", v.sql("SELECT session_id, frame_idx, mel, round(ln(1 + 10000 * mono), 5) AS value FROM mel", *MEL))
def log_mel(spark, sf_dir):
    rows = features.log_mel(chunks(spark, sf_dir), RATE, FFT, HOP, BANDS, 8)
    return rows.select("session_id", "frame_idx", F.posexplode("log_mel").alias("mel", "value")).withColumn("value", F.round("value", 5))


@query("pcen_features", v.sql("SELECT session_id, frame_idx, mel, round(pcen, 5) AS pcen, round(db, 4) AS level_db FROM feat", *MEL, "pcen"))
def pcen_features(spark, sf_dir):
    rows = features.pcen_features(mel_rows(spark, sf_dir), block_frames=8)
    flat = rows.select("session_id", "frame_idx", F.posexplode(F.arrays_zip("pcen", "level_db")).alias("mel", "z"))
    return flat.select("session_id", "frame_idx", "mel", F.round("z.pcen", 5).alias("pcen"), F.round("z.level_db", 4).alias("level_db"))


@query("onset_features", v.sql("""SELECT session_id, frame_idx, mel, round(pcen, 5) AS pcen, round(db, 4) AS db, round(ild, 5) + 0.0 AS ild, round(cre, 5) + 0.0 AS coh_re,
  round(cim, 5) + 0.0 AS coh_im FROM feat""", *MEL, "pcen"))
def onset_features(spark, sf_dir):
    rows = features.onset_features(mel_rows(spark, sf_dir), block_frames=8, hop=HOP, fft=FFT)
    planes = F.arrays_zip(*[F.col("planes")[i].alias(n) for i, n in enumerate(("a", "b", "c", "d", "e"))])
    flat = rows.withColumns({f"p{i}": F.col("planes")[i] for i in range(5)}).select(
        "session_id", "frame_idx", F.posexplode(F.arrays_zip("p0", "p1", "p2", "p3", "p4")).alias("mel", "z"))
    return flat.select("session_id", "frame_idx", "mel", F.round("z.p0", 5).alias("pcen"), F.round("z.p1", 4).alias("db"),
                       (F.round("z.p2", 5) + 0.0).alias("ild"), (F.round("z.p3", 5) + 0.0).alias("coh_re"), (F.round("z.p4", 5) + 0.0).alias("coh_im"))


SLOW, QUICK = 2.0 / 21.0, 1.0 / 3.0


def ema_sql(weight, column="value"):
    return f"""ema AS (SELECT session_id, idx, CAST({column} AS DOUBLE) AS y FROM signal WHERE idx = 0
  UNION ALL SELECT n.session_id, n.idx, (1 - CAST({weight!r} AS DOUBLE)) * p.y + CAST({weight!r} AS DOUBLE) * n.{column}
  FROM ema p JOIN signal n ON n.session_id = p.session_id AND n.idx = p.idx + 1)"""


@query("ema", v.sql("SELECT session_id, idx, round(y, 6) AS y FROM ema", *SIG, extra=ema_sql(SLOW)))
def ema(spark, sf_dir):
    rows = smoothing.exponential_smooth(signal(spark, sf_dir), TRACE_KEYS, "idx", [], 16, "value", SLOW, "y")
    return rows.select("session_id", "idx", F.round("y", 6).alias("y"))


@query("one_pole", v.sql("SELECT session_id, idx, round(y, 6) AS y FROM ema", *SIG, extra=ema_sql(QUICK, "other")))
def one_pole(spark, sf_dir):
    rows = smoothing.one_pole(signal(spark, sf_dir), TRACE_KEYS, "idx", [], 16, "other", QUICK, "y")
    return rows.select("session_id", "idx", F.round("y", 6).alias("y"))


ACT = "greatest(0.0, least(1.0, (-value + 80) / 60))"


@query("scene_activity", v.sql("SELECT session_id, idx, round(y, 6) AS activity FROM ema", *SIG, extra=ema_sql(2.0 / 101.0, "level").replace(
    "FROM signal", "FROM levels").replace("JOIN signal", "JOIN levels").replace("ema AS (", f"levels AS (SELECT session_id, idx, {ACT} AS level FROM signal),\nema AS (", 1)))
def scene_activity(spark, sf_dir):
    """Event values as (negative) mean levels in dB."""
    rows = signal(spark, sf_dir).withColumn("mean_db", -F.col("value"))
    out = smoothing.scene_activity(rows, TRACE_KEYS, "idx", [], 16, "mean_db")
    return out.select("session_id", "idx", F.round("activity", 6).alias("activity"))


@query("trailing_mean", v.sql("""SELECT session_id, idx, round(avg(value) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS y
  FROM signal""", *SIG))
def trailing_mean(spark, sf_dir):
    rows = smoothing.trailing_mean(signal(spark, sf_dir), TRACE_KEYS, "idx", [], 32, "value", 0.4, "y")
    return rows.select("session_id", "idx", F.round("y", 6).alias("y"))


@query("context_windows", v.sql("""SELECT session_id, idx, round(coalesce(lag(value, 3) OVER w, -100.0), 6) AS w0, round(coalesce(lag(value, 2) OVER w, -100.0), 6) AS w1,
  round(coalesce(lag(value, 1) OVER w, -100.0), 6) AS w2, round(value, 6) AS w3 FROM signal WINDOW w AS (PARTITION BY session_id ORDER BY idx)""", *SIG))
def context_windows(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("vector", F.array("value"))
    out = features.context_windows(rows, "vector", 4, TRACE_KEYS, "idx", 32, F.array(F.lit(-100.0)))
    return out.select("session_id", "idx", *[F.round(F.col("window")[i][0], 6).alias(f"w{i}") for i in range(4)])


@query("window_tensors", v.sql("""SELECT session_id, idx + 1 AS window_end, greatest(0, 128 - idx - 1) AS padded, v.c AS channel,
  CAST(sum(v.x) OVER (PARTITION BY session_id, v.c ORDER BY idx ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)
    + greatest(0, 128 - idx - 1) * 64 * CASE WHEN v.c = 1 THEN -100 ELSE 0 END AS DOUBLE) AS total, CAST(floor(value) * (v.c + 1) + 63 AS DOUBLE) AS newest
  FROM (SELECT session_id, idx, value, unnest(list_transform(range(5), lambda c: {'c': c, 'x': 64 * floor(value) * (c + 1) + 2016})) AS v FROM signal)
  QUALIFY idx % 20 = 0 OR idx = max(idx) OVER (PARTITION BY session_id)""", *SIG))
def window_tensors(spark, sf_dir):
    """Windows of 128 frames of 5 channels and 64 bands, each tensor summed by channel."""
    rows = signal(spark, sf_dir)
    number = F.floor("value").cast("double")
    planes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda m: number * (c + 1) + m))
    frames = rows.select("session_id", F.col("idx").alias("frame_idx"), planes.alias("planes"))
    last = rows.groupBy("session_id").agg((F.max("idx") + 1).cast("bigint").alias("window_end"))
    ends = rows.filter("idx % 20 = 0").select("session_id", (F.col("idx") + 1).cast("bigint").alias("window_end")).unionByName(last).distinct()

    def totals(windows):
        import numpy as np
        return np.concatenate([windows.sum(axis=(2, 3), dtype=np.float64), windows[:, :, -1, -1]], axis=1)
    cut = tensors.window_tensors(frames, ends, "planes", (5, 64), reduce=totals)
    each = cut.select("session_id", "window_end", "tensor", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("channel"))
    return each.select("session_id", "window_end", F.greatest(F.lit(0), 128 - F.col("window_end")).alias("padded"), F.col("channel").cast("bigint").alias("channel"),
                       F.get("tensor", F.col("channel")).alias("total"), F.get("tensor", F.col("channel") + 5).alias("newest"))


@query("window_ends", v.sql("""SELECT session_id, idx + 1 AS window_end FROM signal JOIN sizes USING (session_id) WHERE idx % 20 = 0 OR idx = n - 1 OR value > 80""", *SIG))
def window_ends(spark, sf_dir):
    return features.window_ends(signal(spark, sf_dir), TRACE_KEYS, "idx", F.col("value") > 80, 20, 32).select("session_id", "window_end")


@query("distinct_ends", v.sql("""SELECT session_id, idx + 1 AS window_end FROM signal WHERE idx % 20 = 0
  UNION SELECT session_id, idx + 1 FROM signal WHERE value > 80 UNION SELECT session_id, n FROM sizes""", *SIG))
def distinct_ends(spark, sf_dir):
    rows = signal(spark, sf_dir)
    end = (F.col("idx") + 1).alias("window_end")
    last = rows.groupBy("session_id").agg((F.max("idx") + 1).alias("window_end"))
    return rows.filter("idx % 20 = 0").select("session_id", end).union(rows.filter("value > 80").select("session_id", end)).union(last).distinct()


@query("onset_targets", v.sql("""SELECT session_id, class, frame_idx, max(w) AS label, arg_max(source_hint, event_id) AS source_hint FROM (
  SELECT session_id, class, event_id, source_hint, greatest(0, CAST(ceil((onset_sample + 60 - 240) / CAST(60 AS DOUBLE)) AS BIGINT)) + s AS frame_idx, w
  FROM labelled, (VALUES (0, CAST(1.0 AS DOUBLE)), (1, CAST(0.6 AS DOUBLE)), (2, CAST(0.2 AS DOUBLE))) g(s, w)
  WHERE NOT uncertain AND class IN ('click', 'purchase', 'view')) JOIN sessions USING (session_id)
  WHERE frame_idx < (length - 240) // 60 + 1 GROUP BY ALL""", "ev", "labelled", "sessions"))
def onset_targets(spark, sf_dir):
    rows = v.labelled(spark, sf_dir)
    lengths = v.sessions(spark, sf_dir).select("session_id", F.expr("(length - 240) div 60 + 1").alias("frame_count"))
    return features.onset_targets(rows, lengths, hop=60, fft=240, classes=v.TARGETS)


@query("extract_windows", v.sql("""SELECT w.session_id, window_id, round(sum(s.value), 4) AS total, count(s.idx) AS got FROM (
  SELECT session_id, event_id AS window_id, idx - 5 AS a, idx + 7 AS b FROM signal) w JOIN sizes z USING (session_id)
  LEFT JOIN signal s ON s.session_id = w.session_id AND s.idx >= a AND s.idx < b AND a >= 0 AND b <= n GROUP BY ALL""", *SIG))
def extract_windows(spark, sf_dir):
    windows = signal(spark, sf_dir).select("session_id", F.col("event_id").alias("window_id"), (F.col("idx") - 5).alias("window_start"), F.lit(12).alias("window_frames"))
    out = features.extract_windows(chunks(spark, sf_dir), windows, 40)
    return out.select("session_id", "window_id", F.round(F.aggregate("left", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                      F.coalesce(F.size("left"), F.lit(0)).alias("got")).withColumn("got", F.greatest(F.lit(0), F.col("got")))


@query("local_snr", v.sql("""SELECT event_id, round(20 * log10(greatest(1e-9, sqrt(a)) / greatest(1e-5, sqrt(b))), 4) AS snr_db FROM (
  SELECT e.event_id, avg(s.value * s.value) FILTER (WHERE s.idx >= e.idx AND s.idx < e.idx + 3) AS a, avg(s.value * s.value) AS b
  FROM signal e JOIN signal s ON s.session_id = e.session_id AND s.idx >= e.idx - 10 AND s.idx < e.idx + 10 GROUP BY e.event_id)""", *SIG))
def local_snr(spark, sf_dir):
    rows = signal(spark, sf_dir)
    events = rows.select("session_id", "event_id", F.col("idx").alias("onset_sample"), (F.col("idx") + 3).alias("end_sample"))
    return features.local_snr(rows, events, 10, 32).select("event_id", F.round("snr_db", 4).alias("snr_db"))


@query("activity_bounds", v.sql("""SELECT session_id, greatest(0, f - 2) AS trim_start, least(n, l + 4) AS trim_end, f AS audible FROM (
  SELECT s.session_id, min(idx) AS f, max(idx) AS l, max(n) AS n FROM signal s JOIN sizes USING (session_id)
  JOIN (SELECT session_id, max(abs(value)) AS p FROM signal GROUP BY session_id) m USING (session_id) WHERE abs(value) >= greatest(0.005, p * 0.02) GROUP BY s.session_id)""", *SIG))
def activity_bounds(spark, sf_dir):
    return features.signal_bounds(signal(spark, sf_dir), "session_id", "idx", "value", 2, 3)


def clips(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    gate = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.2, F.lit(0.0)).otherwise(x.cast("double")))
    return e.select(F.col("vec_id").alias("clip_id"), gate.alias("left"), F.reverse(gate).alias("right"), F.lit(50).alias("sample_rate"))


@query("trim_silence", """WITH c AS (SELECT vec_id AS clip_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.2 THEN 0.0 ELSE CAST(x AS DOUBLE) END) AS l FROM embeddings),
e AS (SELECT clip_id, i, greatest(abs(l[i]), abs(l[65 - i])) AS env FROM c, range(1, 65) r(i)),
m AS (SELECT clip_id, max(env) AS p FROM e GROUP BY clip_id),
b AS (SELECT e.clip_id, min(i - 1) AS f, max(i - 1) AS g FROM e JOIN m USING (clip_id) WHERE env >= greatest(0.005, p * 0.02) GROUP BY e.clip_id)
SELECT c.clip_id, CASE WHEN f IS NULL THEN 64 ELSE least(64, g + 10 + 1) - greatest(0, f - 1) END AS kept, CASE WHEN f IS NULL THEN 0 ELSE f - greatest(0, f - 1) END AS onset_offset
FROM c LEFT JOIN b USING (clip_id)""")
def trim_silence(spark, sf_dir):
    out = features.trim_silence(clips(spark, sf_dir), rate=50)
    return out.select("clip_id", F.size("left").alias("kept"), "onset_offset")


@query("fit_clip", """SELECT vec_id AS clip_id, pos, round(coalesce(CAST(embedding[CASE WHEN i >= 1 AND i <= 64 THEN i END] AS DOUBLE), 0.0), 6) AS value FROM (
  SELECT *, pos - (10 - label * 3) + 1 AS i FROM embeddings, range(0, 50) r(pos))""")
def fit_clip(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    clip = F.transform("embedding", lambda x: x.cast("double"))
    placed = e.select(F.col("vec_id").alias("clip_id"), F.posexplode(features.fit_clip(clip, F.col("label") * 3, F.lit(10), 50)).alias("pos", "value"))
    return placed.select("clip_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query("channel_ops", """SELECT vec_id AS clip_id, i, round((CAST(embedding[2 * i + 1] AS DOUBLE) + embedding[2 * i + 2]) / 2, 6) AS mono,
  round(CAST(embedding[2 * i + 2] AS DOUBLE), 6) AS swapped_left FROM embeddings, range(32) r(i)""")
def channel_ops(spark, sf_dir):
    """Embeddings read as interleaved stereo."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), features.deinterleave(wide, 0).alias("left"),
                                                       features.deinterleave(wide, 1).alias("right"))
    out = rows.select("clip_id", F.posexplode(F.arrays_zip(features.downmix(F.col("left"), F.col("right")).alias("mono"), F.col("right").alias("swapped"))).alias("i", "z"))
    return out.select("clip_id", F.col("i").cast("bigint").alias("i"), F.round("z.mono", 6).alias("mono"), F.round("z.swapped", 6).alias("swapped_left"))


@query("mirror_augment", """SELECT vec_id AS clip_id, p, j, round(CASE WHEN label < 5 AND p IN (2, 4) THEN -1 ELSE 1 END * CAST(embedding[p * 4 + j + 1] AS DOUBLE), 6) AS plane,
  round(CASE WHEN label < 5 THEN -1 ELSE 1 END * CAST(embedding[21] AS DOUBLE), 6) AS x, round(CAST(embedding[22] AS DOUBLE), 6) AS y, round(CAST(embedding[23] AS DOUBLE), 6) AS z
  FROM embeddings, range(5) r(p), range(4) q(j)""")
def mirror_augment(spark, sf_dir):
    e = F.col("embedding")
    num = lambda i: e[i].cast("double")
    rows = v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"), "label", F.array(*[F.array(*[num(4 * p + j) for j in range(4)]) for p in range(5)]).alias("planes"),
        F.array(F.array(F.array(num(20), num(21), num(22)))).alias("target"))
    out = features.mirror_augment(rows, "planes", "target", F.col("label") < 5)
    flat = out.select("clip_id", F.posexplode("planes").alias("p", "v"), F.col("target")[0][0].alias("t")).select("clip_id", "p", F.posexplode("v").alias("j", "plane"), "t")
    return flat.select("clip_id", F.col("p").cast("bigint").alias("p"), F.col("j").cast("bigint").alias("j"), F.round("plane", 6).alias("plane"),
                       *[F.round(F.col("t")[i], 6).alias(n) for i, n in enumerate("xyz")])


@query("resample_linear", v.sql("""SELECT a.session_id, o.j AS out_idx, round(a.value + (coalesce(b.value, a.value) - a.value) * (o.j * 2 / CAST(3 AS DOUBLE) - a.idx), 5) AS value
  FROM (SELECT session_id, unnest(range(0, CAST(ceil(n * 3 / CAST(2 AS DOUBLE)) AS BIGINT))) AS j FROM sizes) o
  JOIN signal a ON a.session_id = o.session_id AND a.idx = (o.j * 2) // 3 LEFT JOIN signal b ON b.session_id = a.session_id AND b.idx = a.idx + 1""", *SIG))
def resample_linear(spark, sf_dir):
    rows = signal(spark, sf_dir).select("session_id", "idx", "value")
    return features.resample_linear(rows, 2, 3, "session_id", "idx", "value", 32).withColumn("value", F.round("value", 5))


@query("to_stereo_48k", """WITH x AS (SELECT vec_id AS clip_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
  d AS (SELECT j, k, j * 2 / CAST(3 AS DOUBLE) - k AS away FROM (SELECT range AS j FROM range(96)), (SELECT range AS k FROM range(64))),
  w AS (SELECT j, k, CASE WHEN away = 0 THEN 1.0 ELSE sin(pi() * away) / (pi() * away) END * pow(cos(pi() * away / 64), 2) AS w FROM d WHERE abs(away) < 32)
  SELECT clip_id, j AS idx, round(sum(v * w), 5) + 0.0 AS left_value, round(sum(-v * w), 5) + 0.0 AS right_value FROM x JOIN w USING (k) GROUP BY clip_id, j""")
def to_stereo_48k(spark, sf_dir):
    """Band-limited resampling of each embedding, and of its negative, as the channels of a clip."""
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("left"), F.transform("embedding", lambda x: -x).alias("right"),
                                                       F.lit(32000).alias("sample_rate"))
    return features.resample_clips(rows).select("clip_id", F.posexplode(F.arrays_zip("left", "right")).alias("idx", "v")).select(
        "clip_id", F.col("idx").cast("long").alias("idx"), (F.round("v.left", 5) + 0.0).alias("left_value"), (F.round("v.right", 5) + 0.0).alias("right_value"))


@query("scalar_signal", """SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (pow(10, value / 2595) - 1), 6) AS hz,
  round(greatest(-100.0, least(0.0, 10 * log10(greatest(value / 1000, 1e-10)))), 6) AS db, round(pow(10, value / 200), 6) AS gain,
  round(greatest(-1.0, least(1.0, 10 * log10((value + 1e-10) / (50 + 1e-10)) / 30)), 6) AS ild, round(0.5 * (1 - cos(value * (2 * pi() / 99))), 6) AS hann,
  round(value * 48000.0 / 1024, 6) AS bin_hz FROM events""")
def scalar_signal(spark, sf_dir):
    x = F.col("value")
    columns = {"mel": s.hz_to_mel(x), "hz": s.mel_to_hz(x), "db": s.power_db(x / 1000), "gain": s.amplitude_gain(x / 10), "ild": s.level_difference(x, F.lit(50.0)),
               "hann": s.hann(x, 100), "bin_hz": s.bin_to_hz(x)}
    return v.table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("scalar_time", """SELECT event_id, round(event_id * 1000.0 / 48000, 6) AS ms, event_id * 48000 // 1000 AS samples, (event_id * 1000 + 24000) // 48000 AS whole_ms,
  CAST(round_even(event_id * (48000.0 / CAST(32000 AS DOUBLE)), 0) AS BIGINT) AS rescaled, (event_id - 1) * 240 + 1024 AS frame_end FROM events""")
def scalar_time(spark, sf_dir):
    x = F.col("event_id")
    return v.table(spark, sf_dir, "events").select(
        "event_id", F.round(s.samples_to_ms(x), 6).alias("ms"), s.ms_to_samples(x).alias("samples"), s.samples_to_whole_ms(x).alias("whole_ms"),
        s.rescale_position(x, 32000).alias("rescaled"), s.frame_end_sample(x).alias("frame_end"))


@query("scalar_text", """SELECT event_id, coalesce(regexp_full_match(k, '[0-9]+'), false) AS digits, CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(k AS BIGINT) END AS u32,
  CASE WHEN event_type = 'view' THEN event_type ELSE 'none' END AS word, sha256(event_type) AS digest, 'asset_' || substr(sha256(event_type), 1, 16) AS asset,
  regexp_full_match(event_type || '_' || k, '[A-Za-z0-9][A-Za-z0-9_-]{0,79}') AS id_ok, lower(k) IN ('1', 'true', 'yes', 'y') AS flag FROM (SELECT *, props->>'$.k' AS k FROM events)""")
def scalar_text(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    digest = s.content_hash(F.col("event_type"))
    return rows.select("event_id", s.strict_float(F.col("k")).isNotNull().alias("digits"), s.strict_u32(F.col("k")).alias("u32"),
                       s.word_domain(F.col("event_type"), ("view",), "none").alias("word"), digest.alias("digest"), s.asset_id(digest).alias("asset"),
                       s.session_id_ok(F.concat_ws("_", "event_type", "k")).alias("id_ok"), s.parse_bool(F.col("k")).alias("flag"))
