"""Directions per scene: decoding, assignment, metrics, calibration."""

import itertools

from pyspark.sql import functions as F

from soundlake import params
from soundlake.functions import geometry as g
from soundlake.operators import direction as d
from soundlake.plans import views as v
from soundlake.plans.q_matching import rounded
from soundlake.plans.registry import query

THRESHOLD, PRESENT, SCALE = 0.6, 0.7, 4.0
GRID = [0.1 + 0.025 * i for i in range(33)]
EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
PI = "pi()"


def scenes(spark, sf_dir):
    """Each embedding as one scene: 18 numbers give the estimated tracks, the next 18 the true targets."""
    e = F.col("embedding")

    def vec(start):
        return F.array(*[e[start + a].cast("double") * SCALE for a in range(3)])

    def target(start):
        raw = vec(start)
        return F.when(g.norm(raw) >= PRESENT, F.transform(raw, lambda x: x / g.norm(raw))).otherwise(
            F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))

    def tensor(make, base):
        return F.array(*[F.array(*[make(base + 9 * c + 3 * t) for t in range(3)]) for c in range(2)])
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("scene_id"), "label", tensor(vec, 0).alias("tracks"), tensor(target, 18).alias("target"))


def decoded(spark, sf_dir):
    rows = scenes(spark, sf_dir)
    rows = d.decode_tracks(rows.withColumn("truths", d.truth_list("target", 2)), "tracks", [THRESHOLD, THRESHOLD])
    return rows.withColumns({
        "target_count": F.size("truths"),
        "stratum": F.when(F.col("label") >= 5, "close-15-30").otherwise("standard"),
        "room": F.concat(F.lit("room"), F.col("label")), "capture_session": F.concat(F.lit("s"), F.col("label") % 3),
        "profile": F.concat(F.lit("p"), F.floor(F.col("label") / 5).cast("string"))})


# --- the same views as SQL ---------------------------------------------------------------------------

def norm_sql(p):
    return f"sqrt({p}x * {p}x + {p}y * {p}y + {p}z * {p}z)"


def angle_sql(a, b):
    return (f"(CASE WHEN {norm_sql(a)} <= 1e-9 OR {norm_sql(b)} <= 1e-9 THEN 180.0 ELSE degrees(acos(greatest(-1.0, "
            f"least(1.0, ({a}x * {b}x + {a}y * {b}y + {a}z * {b}z) / ({norm_sql(a)} * {norm_sql(b)}))))) END)")


def az_sql(p):
    return f"((degrees(atan2({p}x, {p}z)) + 360.0) - 360.0 * floor((degrees(atan2({p}x, {p}z)) + 360.0) / 360.0))"


def el_sql(p):
    return f"degrees(atan2({p}y, sqrt({p}x * {p}x + {p}z * {p}z)))"


def merge_sql(a, b):
    parts = ", ".join(f"{k} := {a}.{k} * {a}.conf + {b}.{k} * {b}.conf" for k in "xyz")
    return f"struct_pack({parts}, conf := greatest({a}.conf, {b}.conf), track := {a}.track)"


def near_sql(a, b):
    return f"{angle_sql(a + '.', b + '.')} < {params.DUPLICATE_MERGE_DEGREES}"


def decode_sql(threshold: str = str(THRESHOLD), extra_keys: str = "", source: str = "trk") -> str:
    """Decoding of one class's three tracks in three steps, then the strongest three per scene."""
    keys = "scene_id" + extra_keys
    vecs = ", ".join(f"max(CASE WHEN t = {t} THEN struct_pack(x := x, y := y, z := z, conf := least({norm_sql('')}, 1.0), "
                     f"track := t) END) AS v{t}" for t in range(3))
    return f"""d0 AS (SELECT {keys}, c, {vecs} FROM {source} GROUP BY ALL),
d1 AS (SELECT *, CASE WHEN v0.conf >= {threshold} THEN v0 END AS a FROM d0),
d2 AS (SELECT * REPLACE (CASE WHEN v1.conf < {threshold} THEN a WHEN a IS NULL THEN v1
    WHEN {near_sql('v1', 'a')} THEN {merge_sql('a', 'v1')} ELSE a END AS a),
  CASE WHEN v1.conf >= {threshold} AND a IS NOT NULL AND NOT ({near_sql('v1', 'a')}) THEN v1 END AS b FROM d1),
d3 AS (SELECT {keys}, c,
  CASE WHEN v2.conf < {threshold} THEN a WHEN a IS NULL THEN v2 WHEN {near_sql('v2', 'a')} THEN {merge_sql('a', 'v2')} ELSE a END AS a,
  CASE WHEN v2.conf < {threshold} OR a IS NULL OR {near_sql('v2', 'a')} THEN b WHEN b IS NULL THEN v2
    WHEN {near_sql('v2', 'b')} THEN {merge_sql('b', 'v2')} ELSE b END AS b,
  CASE WHEN v2.conf >= {threshold} AND a IS NOT NULL AND NOT ({near_sql('v2', 'a')}) AND b IS NOT NULL
    AND NOT ({near_sql('v2', 'b')}) THEN v2 END AS e FROM d2),
d4 AS (SELECT {keys}, c, 0 AS slot, a AS s FROM d3 WHERE a IS NOT NULL
  UNION ALL SELECT {keys}, c, 1, b FROM d3 WHERE b IS NOT NULL UNION ALL SELECT {keys}, c, 2, e FROM d3 WHERE e IS NOT NULL),
sources AS (SELECT {keys}, c, s.track AS track, {az_sql('s.')} AS azimuth,
    greatest(-60.0, least(60.0, {el_sql('s.')})) AS elevation, s.conf AS confidence,
    row_number() OVER (PARTITION BY {keys} ORDER BY s.conf DESC, c, slot) AS pos FROM d4
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY s.conf DESC, c, slot) <= 3)"""


def vector_rows(start):
    axes = ", ".join(f"{SCALE} * CAST(embedding[{start + 1 + a} + 9 * c + 3 * t] AS DOUBLE) AS {n}"
                     for a, n in enumerate("xyz"))
    return f"SELECT vec_id AS scene_id, label, c, t, {axes} FROM embeddings, range(2) AS cc(c), range(3) AS tt(t)"


v.CTE["trk"] = f"trk AS ({vector_rows(0)})"
v.CTE["tru"] = f"""tru AS (SELECT scene_id, label, c, t, x / {norm_sql('')} AS x, y / {norm_sql('')} AS y, z / {norm_sql('')} AS z,
  row_number() OVER (PARTITION BY scene_id, c ORDER BY t) - 1 AS ti FROM ({vector_rows(18)}) WHERE {norm_sql('')} >= {PRESENT})"""
v.CTE["sources"] = decode_sql()
PERMS = []
for _p, _t in itertools.product(range(1, 4), repeat=2):
    for _o, _chosen in enumerate(itertools.permutations(range(max(_p, _t)), min(_p, _t))):
        for _i, _j in enumerate(_chosen):
            PERMS.append(f"({_p}, {_t}, {_o}, {_i if _p <= _t else _j}, {_j if _p <= _t else _i})")
v.CTE["pairing"] = f"""perms(np, nt, ord, pi, ti) AS (VALUES {', '.join(PERMS)}),
ps AS (SELECT *, row_number() OVER (PARTITION BY scene_id, c ORDER BY pos) - 1 AS pi,
  cos(radians(elevation)) * sin(radians(azimuth)) AS x, sin(radians(elevation)) AS y,
  cos(radians(elevation)) * cos(radians(azimuth)) AS z FROM sources),
errs AS (SELECT p.scene_id, p.c, p.pi, t.ti, {angle_sql('p.', 't.')} AS err, abs(p.elevation - {el_sql('t.')}) AS el_err,
  p.confidence, count(DISTINCT p.pi) OVER w AS np, count(DISTINCT t.ti) OVER w AS nt
  FROM ps p JOIN tru t ON t.scene_id = p.scene_id AND t.c = p.c WINDOW w AS (PARTITION BY p.scene_id, p.c)),
options AS (SELECT e.*, m.ord FROM errs e JOIN perms m ON m.np = e.np AND m.nt = e.nt AND m.pi = e.pi AND m.ti = e.ti),
totals AS (SELECT scene_id, c, ord, sum(err) AS total, count(*) FILTER (WHERE err <= 20) AS w20,
  count(*) FILTER (WHERE err <= 30) AS w30 FROM options GROUP BY ALL),
best AS (SELECT scene_id, c, arg_min(ord, (total, ord)) AS ord, max(w20) AS w20, max(w30) AS w30 FROM totals GROUP BY ALL),
matches AS (SELECT o.* FROM options o JOIN best USING (scene_id, c, ord))"""


@query("decode_tracks", v.sql("""SELECT scene_id, pos, c AS cls, CAST(track AS INTEGER) AS track, round(azimuth, 5) AS azimuth,
  round(elevation, 5) AS elevation, round(confidence, 6) AS confidence FROM sources""", "trk", "sources"))
def decode_tracks(spark, sf_dir):
    rows = decoded(spark, sf_dir).select("scene_id", F.posexplode("sources").alias("p", "s"))
    return rows.select("scene_id", (F.col("p") + 1).alias("pos"), "s.cls", "s.track", F.round("s.azimuth", 5).alias("azimuth"),
                       F.round("s.elevation", 5).alias("elevation"), F.round("s.confidence", 6).alias("confidence"))


@query("top_sources", v.sql("""SELECT scene_id, count(*) AS kept, round(max(confidence), 6) AS strongest,
  round(min(confidence), 6) AS weakest FROM sources GROUP BY scene_id""", "trk", "sources"))
def top_sources(spark, sf_dir):
    rows = decoded(spark, sf_dir).filter(F.size("sources") > 0)
    return rows.select("scene_id", F.size("sources").alias("kept"),
                       F.round(F.col("sources")[0]["confidence"], 6).alias("strongest"),
                       F.round(F.element_at("sources", -1)["confidence"], 6).alias("weakest"))


@query("assign_directions", v.sql("""SELECT scene_id, c AS cls, pi AS prediction, ti AS truth, round(err, 4) AS error,
  round(el_err, 4) AS elevation_error, round(confidence, 6) AS confidence FROM matches""", "trk", "tru", "sources", "pairing"))
def assign_directions(spark, sf_dir):
    rows = d.assign_directions(decoded(spark, sf_dir), 2)
    return rows.withColumns({"error": F.round("error", 4), "elevation_error": F.round("elevation_error", 4),
                             "confidence": F.round("confidence", 6)})


@query("count_within", v.sql("""SELECT vec_id AS scene_id, r.c AS cls, coalesce(w20, 0) AS w20, coalesce(w30, 0) AS w30 FROM embeddings CROSS JOIN range(2) r(c)
  LEFT JOIN best ON best.scene_id = vec_id AND best.c = r.c""",
                             "trk", "tru", "sources", "pairing"))
def count_within(spark, sf_dir):
    return d.scene_outcomes(decoded(spark, sf_dir), 2, ["scene_id"]).select(
        "scene_id", "cls", "w20", "w30")


@query("pairwise_separation", v.sql(f"""SELECT scene_id, i, j, round({angle_sql('a.', 'b.')}, 4) AS separation FROM
  (SELECT a, b, a.scene_id AS scene_id, a.n AS i, b.n AS j FROM n a JOIN n b ON a.scene_id = b.scene_id AND a.n < b.n)""",
                                    "tru", extra="""n AS (SELECT scene_id, x, y, z, CAST(row_number() OVER (PARTITION BY scene_id
  ORDER BY c, t) - 1 AS INTEGER) AS n FROM tru)"""))
def pairwise_separation(spark, sf_dir):
    return d.pairwise_separation(decoded(spark, sf_dir)).withColumn("separation", F.round("separation", 4))


@query("close_pair_check", v.sql(f"""SELECT scene_id, round(closest, 4) AS closest, closest >= 15 - 1e-6 AS separated,
  closest >= 15 - 1e-6 AND closest <= 30 + 1e-6 AS is_close FROM (SELECT a.scene_id, min({angle_sql('a.', 'b.')}) AS closest
  FROM n a JOIN n b ON a.scene_id = b.scene_id AND a.n < b.n GROUP BY a.scene_id)""", "tru",
                                 extra="""n AS (SELECT scene_id, x, y, z, row_number() OVER (PARTITION BY scene_id
  ORDER BY c, t) - 1 AS n FROM tru)"""))
def close_pair_check(spark, sf_dir):
    return d.close_pair_check(decoded(spark, sf_dir)).withColumn("closest", F.round("closest", 4))


v.CTE["greedy_dir"] = f"""gp AS (SELECT s.scene_id, s.pos, s.c, s.confidence, cos(radians(elevation)) * sin(radians(azimuth)) AS x,
  sin(radians(elevation)) AS y, cos(radians(elevation)) * cos(radians(azimuth)) AS z FROM sources s),
gc AS (SELECT p.scene_id, p.pos, p.confidence, t.c * 3 + t.t AS tid, {angle_sql('p.', 't.')} AS err
  FROM gp p JOIN tru t ON t.scene_id = p.scene_id AND t.c = p.c),
g1 AS (SELECT scene_id, 1 AS pos, arg_min(tid, (err, tid)) AS tid FROM gc WHERE pos = 1 GROUP BY scene_id),
g2 AS (SELECT scene_id, 2 AS pos, arg_min(tid, (err, tid)) AS tid FROM gc WHERE pos = 2
  AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.scene_id = gc.scene_id AND g1.tid = gc.tid) GROUP BY scene_id),
g3 AS (SELECT scene_id, 3 AS pos, arg_min(tid, (err, tid)) AS tid FROM gc WHERE pos = 3
  AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.scene_id = gc.scene_id AND g1.tid = gc.tid)
  AND NOT EXISTS (SELECT 1 FROM g2 WHERE g2.scene_id = gc.scene_id AND g2.tid = gc.tid) GROUP BY scene_id),
greedy AS (SELECT gc.scene_id, gc.confidence, gc.err FROM gc JOIN (SELECT * FROM g1 UNION ALL SELECT * FROM g2
  UNION ALL SELECT * FROM g3) x ON x.scene_id = gc.scene_id AND x.pos = gc.pos AND x.tid = gc.tid)"""


def greedy(spark, sf_dir):
    rows = decoded(spark, sf_dir).withColumn("m", d.greedy_matches())
    return rows.select("scene_id", F.explode("m").alias("m")).select("scene_id", "m.confidence", "m.error")


@query("greedy_direction_match", v.sql("""SELECT scene_id, round(confidence, 6) AS confidence, round(err, 4) AS error
  FROM greedy""", "trk", "tru", "sources", "greedy_dir"))
def greedy_direction_match(spark, sf_dir):
    return greedy(spark, sf_dir).withColumns({"confidence": F.round("confidence", 6), "error": F.round("error", 4)})


EDGE_ROWS = ", ".join(f"({i}, CAST({e} AS DOUBLE))" for i, e in enumerate(EDGES))


@query("uncertainty_table", v.sql(f"""SELECT ord, confidence, round(min(p90) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING), 4) AS p90
  FROM (SELECT ord, e.confidence, coalesce(quantile_cont(err, 0.9), 180.0) AS p90 FROM (VALUES {EDGE_ROWS}) e(ord, confidence)
  LEFT JOIN greedy g ON g.confidence >= e.confidence GROUP BY ALL)""", "trk", "tru", "sources", "greedy_dir"))
def uncertainty_table(spark, sf_dir):
    return d.uncertainty_table(greedy(spark, sf_dir), EDGES).withColumn("p90", F.round("p90", 4))


METRICS = """base AS (SELECT scene_id, label, count(*) FILTER (WHERE kind = 'p') AS np, count(*) FILTER (WHERE kind = 't') AS nt
  FROM (SELECT vec_id AS scene_id, label, 'x' AS kind FROM embeddings UNION ALL
        SELECT scene_id, label, 'p' FROM sources JOIN (SELECT vec_id AS scene_id, label FROM embeddings) USING (scene_id)
        UNION ALL SELECT scene_id, label, 't' FROM tru) GROUP BY ALL),
report AS (SELECT count(*) AS scene_count, count(*) FILTER (WHERE nt = 2) AS two_source_support,
  count(*) FILTER (WHERE nt = 3) AS three_source_support, count(DISTINCT label) AS room_count,
  count(DISTINCT label % 3) AS capture_session_count, count(DISTINCT label // 5) AS profile_count,
  coalesce(avg(CAST(np = nt AS INTEGER)), 0.0) AS exact_count_accuracy,
  coalesce(avg(CAST(np = nt AS INTEGER)) FILTER (WHERE nt = 2), 0.0) AS exact_two,
  coalesce(avg(CAST(np = nt AS INTEGER)) FILTER (WHERE nt = 3), 0.0) AS exact_three,
  coalesce(avg(CAST(np = nt AS INTEGER)) FILTER (WHERE label >= 5), 0.0) AS close_exact,
  sum(np) AS n_pred, sum(nt) AS n_truth FROM base),
within AS (SELECT sum(w20) AS w20, sum(w30) AS w30 FROM best),
rates AS (SELECT w20 / CAST(greatest(1, n_pred) AS DOUBLE) AS p20, w20 / CAST(greatest(1, n_truth) AS DOUBLE) AS r20,
  w30 / CAST(greatest(1, n_pred) AS DOUBLE) AS p30, w30 / CAST(greatest(1, n_truth) AS DOUBLE) AS r30 FROM report, within),
dm AS (SELECT scene_count, two_source_support, three_source_support, room_count, capture_session_count,
  (SELECT count(DISTINCT CASE WHEN degrees(asin(y)) < -20 THEN 'down' WHEN degrees(asin(y)) > 20 THEN 'up' ELSE 'level' END) FROM tru)
    AS elevation_band_count, profile_count, round(exact_count_accuracy, 6) AS exact_count_accuracy,
  round(exact_two, 6) AS exact_two, round(exact_three, 6) AS exact_three, round(close_exact, 6) AS close_exact,
  round(p20, 6) AS precision_20, round(r20, 6) AS recall_20, round(2 * p20 * r20 / greatest(1e-12, p20 + r20), 6) AS f1_20,
  round(p30, 6) AS precision_30, round(r30, 6) AS recall_30, round(2 * p30 * r30 / greatest(1e-12, p30 + r30), 6) AS f1_30,
  (SELECT round(coalesce(quantile_cont(err, 0.5), 180.0), 5) FROM matches) AS median_error,
  (SELECT round(coalesce(quantile_cont(err, 0.9), 180.0), 5) FROM matches) AS p90_error,
  (SELECT round(coalesce(quantile_cont(el_err, 0.9), 180.0), 5) FROM matches) AS p90_elevation_error,
  (SELECT round(coalesce(quantile_cont(err, 0.9), 180.0), 5) FROM matches m JOIN base b USING (scene_id) WHERE b.label >= 5) AS close_p90_error,
  (SELECT round(count(*) FILTER (WHERE err > 45) / CAST(greatest(1, count(*)) AS DOUBLE), 6) FROM matches WHERE confidence >= 0.8)
    AS catastrophic_rate FROM report, rates)"""


def metrics_row(spark, sf_dir):
    return d.direction_metrics(decoded(spark, sf_dir), 2)


def rounded_metrics(row):
    fine = {"median_error", "p90_error", "p90_elevation_error", "close_p90_error"}
    return row.withColumns({n: F.round(n, 5 if n in fine else 6) for n, t in row.dtypes if t == "double"})


@query("direction_metrics", v.sql("SELECT * FROM dm", "trk", "tru", "sources", "pairing", extra=METRICS))
def direction_metrics(spark, sf_dir):
    return rounded_metrics(metrics_row(spark, sf_dir))


SYNTHETIC = ("exact_count_accuracy >= 0.9", "exact_two >= 0.85", "exact_three >= 0.85", "precision_20 >= 0.9",
             "recall_20 >= 0.9", "f1_20 >= 0.9", "median_error <= 10", "p90_error <= 20", "close_exact >= 0.75",
             "close_p90_error <= 15", "catastrophic_rate < 0.01", "true")
REAL = ("scene_count >= 1200", "two_source_support >= 200", "three_source_support >= 200", "room_count >= 3",
        "capture_session_count >= 3", "elevation_band_count >= 3", "profile_count = 1", "exact_count_accuracy >= 0.8",
        "exact_two >= 0.75", "exact_three >= 0.75", "f1_30 >= 0.8", "median_error <= 15", "p90_error <= 30",
        "p90_elevation_error <= 25", "true", "true", "true")


def gate_sql(kind, terms):
    return (f"SELECT '{kind}' AS gate, {' + '.join(f'CAST({t} AS INTEGER)' for t in terms)} AS terms_passed, "
            f"{' AND '.join(terms)} AS accepted FROM dm")


@query("direction_gates", v.sql(gate_sql("synthetic", SYNTHETIC) + " UNION ALL " + gate_sql("real", REAL),
                                "trk", "tru", "sources", "pairing", extra=METRICS))
def direction_gates(spark, sf_dir):
    row = metrics_row(spark, sf_dir)
    out = [d.direction_gates(row, kind).select(F.lit(kind).alias("gate"), "terms_passed", "accepted")
           for kind in ("synthetic", "real")]
    return out[0].unionByName(out[1])


GRID_ROWS = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(GRID))


@query("calibrate_activity", v.sql("""SELECT c AS cls, round(arg_max(thr, (score, -ord)), 6) AS threshold, round(max(score), 6) AS score FROM (
  SELECT c, ord, thr, 2 * p * r / greatest(1e-12, p + r) - 0.02 * abs(thr - 0.5) AS score FROM (
    SELECT c, ord, thr, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS p, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS r FROM (
      SELECT c, ord, thr, sum(least(np, nt)) AS tp, sum(np - least(np, nt)) AS fp, sum(nt - least(np, nt)) AS fn FROM (
        SELECT k.scene_id, k.c, k.ord, k.thr, coalesce(s.n, 0) AS np, coalesce(t.n, 0) AS nt
        FROM (SELECT DISTINCT scene_id, c, ord, thr FROM grid_trk) k
        LEFT JOIN (SELECT scene_id, c, ord, count(*) AS n FROM d4 GROUP BY ALL) s
          ON s.scene_id = k.scene_id AND s.c = k.c AND s.ord = k.ord
        LEFT JOIN (SELECT scene_id, c, count(*) AS n FROM tru GROUP BY ALL) t ON t.scene_id = k.scene_id AND t.c = k.c)
      GROUP BY ALL))) GROUP BY c""", "trk", "tru",
    extra=f"grid_trk AS (SELECT trk.*, ord, thr FROM trk, (VALUES {GRID_ROWS}) g(ord, thr)),\n"
          + decode_sql("thr", ", ord, thr", "grid_trk")))
def calibrate_activity(spark, sf_dir):
    rows = scenes(spark, sf_dir).withColumn("truths", d.truth_list("target", 2))
    best = d.calibrate_activity(d.activity_counts(rows, "tracks", "truths", 2, GRID))
    return best.withColumns({"threshold": F.round("threshold", 6), "score": F.round("score", 6)})


OPTIONS = []
for _n, _maps in enumerate(d._active_options()):
    for _o, _m in enumerate(_maps):
        for _k in range(3):
            OPTIONS.append(f"({_n}, {_o}, {_k}, {_m[_k] if _m else -1})")


LOSSES = f"""opts(n, ord, track, target) AS (VALUES {', '.join(OPTIONS)}),
losses AS (SELECT scene_id, sum(cost) / 2 AS loss FROM (SELECT scene_id, c, min(cost) AS cost FROM (
    SELECT k.scene_id, k.c, o.ord, sum((k.x - coalesce(t.x, 0)) ** 2 + (k.y - coalesce(t.y, 0)) ** 2 + (k.z - coalesce(t.z, 0)) ** 2) / 9 AS cost
    FROM trk k LEFT JOIN (SELECT scene_id, c, count(*) AS n FROM tru GROUP BY ALL) n ON n.scene_id = k.scene_id AND n.c = k.c
    JOIN opts o ON o.n = coalesce(n.n, 0) AND o.track = k.t
    LEFT JOIN tru t ON t.scene_id = k.scene_id AND t.c = k.c AND t.ti = o.target GROUP BY ALL) GROUP BY ALL) GROUP BY scene_id)"""


@query("adpit_loss", v.sql("SELECT scene_id, round(loss, 6) AS loss FROM losses", "trk", "tru", extra=LOSSES))
def adpit_loss(spark, sf_dir):
    return scenes(spark, sf_dir).select("scene_id", F.round(d.adpit_loss("tracks", "target", 2), 6).alias("loss"))


@query("mean_adpit_loss", v.sql("""SELECT w.weighted, count(*) AS scene_count, CAST(sum(CASE WHEN w.weighted THEN 1 + coalesce(n, 0) ELSE 1 END) AS DOUBLE) AS total_weight,
  round(sum(loss * CASE WHEN w.weighted THEN 1 + coalesce(n, 0) ELSE 1 END) / sum(CASE WHEN w.weighted THEN 1 + coalesce(n, 0) ELSE 1 END), 6) AS loss
  FROM losses LEFT JOIN (SELECT scene_id, count(*) AS n FROM tru GROUP BY scene_id) USING (scene_id), (VALUES (true), (false)) w(weighted) GROUP BY w.weighted""",
                                "trk", "tru", extra=LOSSES))
def mean_adpit_loss(spark, sf_dir):
    """Plain, and with weights that rise with the number of targets."""
    rows = scenes(spark, sf_dir)
    targets = 1 + F.size(d.truth_list("target", 2))
    out = [d.mean_adpit_loss(rows, "tracks", "target", 2, weight).withColumn("weighted", F.lit(weight is not None)) for weight in (None, targets)]
    return out[0].unionByName(out[1]).withColumn("loss", F.round("loss", 6))


@query("truth_tensor", v.sql("""SELECT scene_id, c AS cls, CAST(ti AS INTEGER) AS track, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z
  FROM tru""", "tru"))
def truth_tensor(spark, sf_dir):
    """Targets as angles, encoded back into the tensor."""
    rows = scenes(spark, sf_dir).withColumn("truths", d.truth_list("target", 2))

    def described(t):
        at = g.vector_direction(F.array(t["x"], t["y"], t["z"]))
        return F.struct(F.element_at(F.array(F.lit("a"), F.lit("b")), t["cls"] + 1).alias("sound_class"), F.struct(
            at["azimuth"].alias("azimuth_degrees"), at["elevation"].alias("elevation_degrees")).alias("rendered_direction"))
    tensor = d.truth_tensor(F.transform("truths", described), ("a", "b"))
    flat = rows.select("scene_id", F.posexplode(tensor).alias("cls", "m")).select(
        "scene_id", "cls", F.posexplode("m").alias("track", "v")).filter(g.norm(F.col("v")) > 0.5)
    return flat.select("scene_id", "cls", "track", *[F.round(F.col("v")[i], 5).alias(n) for i, n in enumerate("xyz")])


@query("direction_geometry", v.sql(f"""SELECT scene_id, c AS cls, t AS track, round({az_sql('')}, 4) AS azimuth, round({el_sql('')}, 4) AS elevation,
  round(least({norm_sql('')}, 1.0), 6) AS confidence,
  CASE WHEN {az_sql('')} >= 315 OR {az_sql('')} < 45 THEN 'front' WHEN {az_sql('')} < 135 THEN 'right' WHEN {az_sql('')} < 225 THEN 'rear' ELSE 'left' END AS quadrant,
  CASE WHEN {el_sql('')} < -20 THEN 'down' WHEN {el_sql('')} > 20 THEN 'up' ELSE 'level' END AS band,
  round(CASE WHEN u <= 0 THEN 60.0 WHEN u <= 0.5 THEN 60.0 - 70.0 * u WHEN u <= 1 THEN 25.0 - 34.0 * (u - 0.5) END, 4) AS uncertainty
  FROM (SELECT *, least({norm_sql('')}, 1.0) AS u FROM trk)""", "trk"))
def direction_geometry(spark, sf_dir):
    rows = scenes(spark, sf_dir).select("scene_id", F.posexplode("tracks").alias("cls", "m")).select(
        "scene_id", "cls", F.posexplode("m").alias("track", "v")).withColumn("at", g.vector_direction(F.col("v")))
    table = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(e).alias("p90"))
                      for c, e in ((0.0, 60.0), (0.5, 25.0), (1.0, 8.0))])
    return rows.select(
        "scene_id", "cls", "track", F.round("at.azimuth", 4).alias("azimuth"), F.round("at.elevation", 4).alias("elevation"),
        F.round("at.confidence", 6).alias("confidence"), g.azimuth_quadrant(F.col("at.azimuth")).alias("quadrant"),
        g.elevation_band(F.col("at.elevation")).alias("band"),
        F.round(g.uncertainty_lookup(table, F.col("at.confidence")), 4).alias("uncertainty"))
