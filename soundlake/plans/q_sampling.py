"""Allocation, sampling, training windows, scoring and losses."""

from pyspark.sql import functions as F

from soundlake.operators import features, sampling, scoring
from soundlake.plans import views as v
from soundlake.plans.q_features import SIG, signal
from soundlake.plans.q_matching import rounded
from soundlake.plans.registry import query

COMBOS = {0: ("-",), 1: ("f", "g"), 2: ("ff", "gg", "fg"), 3: ("fff", "ggg", "ffg", "fgg")}
OFFSETS = {1: 1, 2: 0, 3: 2}


def hash_sql(*parts):
    return f"CAST('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 12) AS BIGINT)"


@query("proportional_allocation", """WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
e AS (SELECT source, total, i, p * total AS x, floor(p * total) AS b FROM t, (VALUES (0, CAST(0.10 AS DOUBLE)), (1, CAST(0.15 AS DOUBLE)), (2, CAST(0.35 AS DOUBLE)), (3, CAST(0.40 AS DOUBLE))) g(i, p))
SELECT source, i AS share_idx, CAST(b AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY x - b DESC, i) <= total - sum(b) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS allocated FROM e""")
def proportional_allocation(spark, sf_dir):
    totals = v.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return sampling.proportional_allocation(totals, "total", (0.10, 0.15, 0.35, 0.40), ["source"])


COMBO_SQL = "CASE cnt " + " ".join(f"WHEN {n} THEN {list(names)}[1 + (k + {OFFSETS.get(n, 0)}) % {len(names)}]" for n, names in COMBOS.items()) + " END"


@query("class_round_robin", v.sql(f"SELECT event_id, cnt, {COMBO_SQL} AS combination FROM (SELECT event_id, k % 4 AS cnt, row_number() OVER (PARTITION BY k % 4 ORDER BY event_id) - 1 AS k FROM ev)", "ev"))
def class_round_robin(spark, sf_dir):
    rows = v.events(spark, sf_dir).select("event_id", (F.col("k") % 4).alias("cnt"))
    return sampling.class_round_robin(rows, "cnt", "event_id", 4096, COMBOS, OFFSETS).select("event_id", "cnt", "combination")


@query("stratified_pick", f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql("'7'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS r,
  count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.2)""")
def stratified_pick(spark, sf_dir):
    rows = v.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_pick(rows, ["lang"], "doc_id", 7, F.floor(F.col("stratum_size") * 0.2)).select("doc_id", "lang")


def windows(spark, sf_dir):
    value, k = F.col("value"), F.col("k")
    return v.events(spark, sf_dir).select("event_id", F.when(k < 30, "real").otherwise("synthetic").alias("domain"), (value > 40).alias("positive"),
                                          (value > 20).alias("hard"), F.array(value / 100, k / 400.0).alias("scores"))


POOLS = f"""w AS (SELECT event_id, CASE WHEN k < 30 THEN 'real' ELSE 'synthetic' END AS domain, CASE WHEN value > 40 THEN 'positive' WHEN value > 20 THEN 'hard' ELSE 'negative' END AS kind FROM ev),
n AS (SELECT count(*) AS n FROM w),
steps AS (SELECT domain || ':' || part AS pool, domain, kind, lo, hi FROM (SELECT 'real' AS domain, 'positive' AS part, 'positive' AS kind, 0 AS lo, (n // 2) // 2 AS hi FROM n
  UNION ALL SELECT 'real', 'negative', 'hard', (n // 2) // 2, n // 2 FROM n
  UNION ALL SELECT 'synthetic', 'positive', 'positive', n // 2, n // 2 + (n - n // 2) // 2 FROM n UNION ALL SELECT 'synthetic', 'negative', 'hard', n // 2 + (n - n // 2) // 2, n FROM n)),
pool AS (SELECT s.pool, w.event_id, row_number() OVER (PARTITION BY s.pool ORDER BY {hash_sql("'5'", "CAST(event_id AS VARCHAR)")}, event_id) - 1 AS rank, count(*) OVER (PARTITION BY s.pool) AS size
  FROM w JOIN steps s ON s.domain = w.domain AND s.kind = w.kind),
draws AS (SELECT d AS draw, s.pool, {hash_sql("'5:draw'", "CAST(d AS VARCHAR)")} AS h FROM n, range(n) r(d) JOIN steps s ON d >= s.lo AND d < s.hi)"""


@query("balanced_order", v.sql("SELECT d.draw, d.pool, p.event_id FROM draws d JOIN pool p ON p.pool = d.pool AND p.rank = d.h % p.size", "ev",
                               extra=POOLS.replace("FROM n, range(n) r(d)", "FROM (SELECT unnest(range(0, n)) AS d FROM n)")))
def balanced_order(spark, sf_dir):
    return sampling.balanced_order(windows(spark, sf_dir), "event_id", 5, "hard").select("draw", "pool", "event_id")


@query("weighted_sample", f"""WITH s AS (SELECT vec_id AS scene_id, [0.75, 1.0, 1.45, 1.75][1 + label % 4]::DOUBLE * CASE WHEN label >= 5 THEN CAST(1.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM embeddings),
g AS (SELECT w, count(*) AS n, sum(w * count(*)) OVER (ORDER BY w) AS hi, sum(w * count(*)) OVER () AS total FROM s GROUP BY w),
p AS (SELECT scene_id, w, row_number() OVER (PARTITION BY w ORDER BY {hash_sql("'9'", "CAST(scene_id AS VARCHAR)")}, scene_id) - 1 AS rank FROM s),
d AS (SELECT d AS draw, {hash_sql("'9:weight'", "CAST(d AS VARCHAR)")} / CAST(281474976710656 AS DOUBLE) AS u, {hash_sql("'9:draw'", "CAST(d AS VARCHAR)")} AS h FROM range(800) r(d)),
c AS (SELECT draw, h, min(g.w) AS w FROM d JOIN g ON d.u * g.total < g.hi GROUP BY draw, h)
SELECT c.draw, p.scene_id FROM c JOIN g ON g.w = c.w JOIN p ON p.w = c.w AND p.rank = c.h % g.n""")
def weighted_sample(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id"), "label")
    weight = sampling.scene_weight(F.col("label") % 4, F.col("label") >= 5)
    return sampling.weighted_sample(rows, "scene_id", weight, 800, 9).select("draw", "scene_id")


@query("hard_negatives", v.sql("SELECT event_id FROM ev WHERE NOT value > 40 AND greatest(value / 100, k / CAST(400 AS DOUBLE)) >= 0.2", "ev"))
def hard_negatives(spark, sf_dir):
    return sampling.hard_negatives(windows(spark, sf_dir), F.col("scores")).select("event_id")


@query("class_weights", v.sql("""SELECT class, positives, round(greatest(1.0, least(8.0, max(positives) OVER () / CAST(greatest(positives, 1) AS DOUBLE))), 6) AS weight
  FROM (SELECT class, count(*) FILTER (WHERE value / 40 >= 0.5) AS positives FROM ev GROUP BY class)""", "ev"))
def class_weights(spark, sf_dir):
    return rounded(sampling.class_weights(v.events(spark, sf_dir).withColumn("label", F.col("value") / 40)))


@query("count_histogram", """SELECT CAST(r.c AS INTEGER) AS cnt, count(label) AS scenes, count(label) FILTER (WHERE label >= 5) AS close FROM range(4) r(c)
  LEFT JOIN embeddings ON label % 4 = r.c GROUP BY r.c""")
def count_histogram(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").withColumn("cnt", F.col("label") % 4)
    return sampling.count_histogram(rows, "cnt", F.col("label") >= 5)


STRIDE = 24
# frames of a session: what its length holds
TRAIN = f"""ses AS (SELECT session_id, CASE WHEN max(k) > 97 THEN 'real' ELSE 'synthetic' END AS domain,
  greatest(1, (max(sample) + 100 - 240) // 60 + 1) AS n FROM ev GROUP BY session_id),
lab AS (SELECT session_id, frame_idx, max(w) AS label FROM (SELECT session_id, greatest(0, CAST(ceil((onset_sample + 60 - 240) / CAST(60 AS DOUBLE)) AS BIGINT)) + s AS frame_idx, w
  FROM labelled, (VALUES (0, CAST(1.0 AS DOUBLE)), (1, CAST(0.6 AS DOUBLE)), (2, CAST(0.2 AS DOUBLE))) g(s, w) WHERE NOT uncertain)
  JOIN ses USING (session_id) WHERE frame_idx < n GROUP BY ALL),
ends AS (SELECT session_id, unnest(range(1, n + 1, {STRIDE})) AS window_end FROM ses UNION SELECT session_id, n FROM ses UNION SELECT session_id, frame_idx + 1 FROM lab),
win AS (SELECT e.session_id, domain, window_end, coalesce(label, 0.0) AS label, coalesce(label, 0.0) >= 0.5 AS positive FROM ends e JOIN ses USING (session_id)
  LEFT JOIN lab ON lab.session_id = e.session_id AND lab.frame_idx + 1 = e.window_end)"""


def training(spark, sf_dir):
    rows = v.labelled(spark, sf_dir)
    lengths = rows.groupBy("session_id").agg(F.when(F.max("k") > 97, "real").otherwise("synthetic").alias("domain")).join(v.sessions(spark, sf_dir).select(
        "session_id", F.greatest(F.lit(1), F.expr("(length - 240) div 60 + 1")).alias("frame_count")), "session_id")
    labels = features.onset_targets(rows, lengths, hop=60, fft=240)
    return sampling.training_windows(labels, lengths, STRIDE)


@query("training_windows", v.sql("SELECT * FROM win", "ev", "labelled", extra=TRAIN))
def training_windows(spark, sf_dir):
    return training(spark, sf_dir).select("session_id", "domain", "window_end", "label", "positive")


@query("cache_summary", v.sql("""SELECT count(*) AS windows, count(*) FILTER (WHERE positive) AS positive, count(*) FILTER (WHERE NOT positive) AS negative,
  count(*) FILTER (WHERE domain = 'real') AS real, count(*) FILTER (WHERE domain = 'synthetic') AS synthetic FROM win""", "ev", "labelled", extra=TRAIN))
def cache_summary(spark, sf_dir):
    return sampling.cache_summary(training(spark, sf_dir))


@query("score_windows", v.sql("""SELECT session_id, idx, round(greatest(0.0, least(1.0, (value - (coalesce(lag(value, 3) OVER w, 0.0) + coalesce(lag(value, 2) OVER w, 0.0)
  + coalesce(lag(value, 1) OVER w, 0.0) + value) / 4) / 100 + 0.5)), 6) AS score FROM signal WINDOW w AS (PARTITION BY session_id ORDER BY idx)""", *SIG))
def score_windows(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("vector", F.array("value"))
    framed = features.context_windows(rows, "vector", 4, ["session_id"], "idx", 32, F.array(F.lit(0.0)))
    scored = scoring.score_windows(framed, scoring.MeanContrast(), ["session_id", "idx"], shape=(4, 1))
    return scored.select("session_id", "idx", F.round(F.col("scores")[0], 6).alias("score"))


class FirstEighteen:
    """Scene scorer that returns the first 18 inputs, doubled."""

    def load(self):
        return lambda batch: 2.0 * batch.reshape(len(batch), -1)[:, :18]


@query("score_scenes", """SELECT vec_id AS scene_id, c AS cls, t AS track, round(2 * CAST(embedding[c * 9 + t * 3 + 1] AS DOUBLE), 6) AS x,
  round(2 * CAST(embedding[c * 9 + t * 3 + 2] AS DOUBLE), 6) AS y, round(2 * CAST(embedding[c * 9 + t * 3 + 3] AS DOUBLE), 6) AS z FROM embeddings, range(2) a(c), range(3) b(t)""")
def score_scenes(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id"), "embedding")
    out = scoring.score_scenes(rows, FirstEighteen(), ["scene_id"], "embedding", shape=(64,))
    flat = out.select("scene_id", F.posexplode("tracks").alias("cls", "m")).select("scene_id", "cls", F.posexplode("m").alias("track", "v"))
    return flat.select("scene_id", F.col("cls").cast("bigint").alias("cls"), F.col("track").cast("bigint").alias("track"), *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate("xyz")])


@query("parity_diff", """SELECT vec_id, CASE WHEN label = 9 THEN NULL ELSE CAST(label AS DOUBLE) / 16384 END AS max_diff,
  label < 2 AS within FROM embeddings""")
def parity_diff(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * 1024) / 1024.0).alias("out"))
    other = rows.filter("label <> 9").select("vec_id", F.transform("out", lambda x, i: x + F.when(i == 7, F.col("label") / 16384.0).otherwise(0.0)).alias("out"))
    return scoring.parity_diff(rows, other, ["vec_id"], "out", 1e-4)


@query("focal_onset_loss", v.sql("""SELECT round(onset_loss, 6) AS onset_loss, round(source_loss, 6) AS source_loss, round(onset_loss + 0.35 * source_loss, 6) AS loss FROM (
  SELECT avg(pow(1 - (y * p + (1 - y) * (1 - p)), 2) * -(CASE WHEN class = 'view' THEN 2 ELSE 1 END * y * ln(p) + (1 - y) * ln(1 - p))) AS onset_loss,
    coalesce(avg(-ln(greatest(1e-12, source_probs[2]))) FILTER (WHERE y >= 0.5), 0.0) AS source_loss FROM (
    SELECT *, CASE WHEN value > 30 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y, greatest(1e-12, least(1 - 1e-12, probability)) AS p FROM trace))""", "ev", "trace"))
def focal_onset_loss(spark, sf_dir):
    rows = v.trace(spark, sf_dir).withColumns({"label": F.when(F.col("value") > 30, 1.0).otherwise(0.0), "source_index": F.lit(1)})
    return rounded(sampling.focal_onset_loss(rows, {"view": 2.0}))
