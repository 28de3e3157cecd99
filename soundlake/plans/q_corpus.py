"""Inventories, splits, audits and rule checks over documents, parts and conversations."""

from pyspark.sql import functions as F

from soundlake.functions import scalar as s
from soundlake.operators import corpus, validation
from soundlake.operators.ordered import sorted_index
from soundlake.plans import views as v
from soundlake.plans.q_matching import rounded
from soundlake.plans.registry import query
from soundlake.session import scratch_path
from soundlake.sources import tables

LANGS = ("en", "fr")
LANG_LIST = "'en', 'fr'"


def assets(spark, sf_dir):
    """Every document as an asset: language is the label, source the family, the text the content."""
    rows = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("asset_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))).alias("relative_path"),
        F.col("lang").alias("label"), F.col("source").alias("source_group"), s.content_hash(F.col("text")).alias("sha256"),
        (F.col("n_chars") >= 60).alias("included"),
        F.when(F.col("n_chars") < 400, "review").otherwise("accepted").alias("review_status"),
        F.col("n_chars").alias("active_offset_samples"))
    return corpus.content_duplicates(rows)


v.CTE["assets"] = """assets0 AS (SELECT CAST(doc_id AS VARCHAR) AS asset_id,
  source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS relative_path, lang AS label,
  source AS source_group, sha256(text) AS sha256, n_chars >= 60 AS included,
  CASE WHEN n_chars < 400 THEN 'review' ELSE 'accepted' END AS review_status, n_chars AS active_offset_samples FROM documents),
assets AS (SELECT *, CASE WHEN relative_path = min(relative_path) OVER (PARTITION BY sha256) THEN ''
  ELSE min(relative_path) OVER (PARTITION BY sha256) END AS duplicate_of FROM assets0)"""
v.CTE["split"] = f"""canon AS (SELECT *, CASE WHEN label IN ({LANG_LIST}) THEN label ELSE 'negative' END AS training_label,
  CASE WHEN label IN ({LANG_LIST}) AND source_group <> '' THEN source_group ELSE asset_id END AS grp
  FROM assets WHERE included AND duplicate_of = ''),
groups AS (SELECT training_label, grp, count(*) AS n,
  sha256('20260720:' || training_label || ':' || training_label || ':' || grp) AS h FROM canon GROUP BY ALL),
placed AS (SELECT *, sum(n) OVER (PARTITION BY training_label ORDER BY h) - n / CAST(2 AS DOUBLE) AS mid,
  sum(n) OVER (PARTITION BY training_label) AS total FROM groups),
split AS (SELECT c.*, CASE WHEN mid <= total * CAST(0.70 AS DOUBLE) THEN 'train' WHEN mid <= total * CAST(0.85 AS DOUBLE) THEN 'dev'
  ELSE 'test' END AS split FROM canon c JOIN placed USING (training_label, grp))"""


@query("content_duplicates", v.sql("SELECT asset_id, relative_path, sha256, duplicate_of FROM assets", "assets"))
def content_duplicates(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", "relative_path", "sha256", "duplicate_of")


@query("canonical_assets", v.sql("SELECT asset_id, relative_path FROM assets WHERE included AND duplicate_of = ''", "assets"))
def canonical_assets(spark, sf_dir):
    return corpus.canonical_assets(assets(spark, sf_dir)).select("asset_id", "relative_path")


@query("training_label", v.sql(f"""SELECT asset_id, CASE WHEN label IN ({LANG_LIST}) THEN label ELSE 'negative' END AS training_label,
  label IN ({LANG_LIST}) AS is_target FROM assets""", "assets"))
def training_label(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", corpus.training_label(LANGS).alias("training_label"),
                                        corpus.is_target(LANGS).alias("is_target"))


@query("manifest_summary", v.sql(f"""SELECT count(*) AS total, count(*) FILTER (WHERE included) AS included,
  count(*) FILTER (WHERE duplicate_of <> '') AS duplicates,
  count(*) FILTER (WHERE review_status NOT IN ('reviewed', 'accepted')) AS needs_review,
  count(*) FILTER (WHERE label = 'en') AS count_en,
  count(*) FILTER (WHERE label = 'fr') AS count_fr,
  count(*) FILTER (WHERE label NOT IN ({LANG_LIST})) AS count_negative FROM assets""", "assets"))
def manifest_summary(spark, sf_dir):
    return corpus.manifest_summary(assets(spark, sf_dir), LANGS)


@query("grouped_split", v.sql("SELECT asset_id, training_label, split FROM split", "assets", "split"))
def grouped_split(spark, sf_dir):
    return corpus.grouped_split(assets(spark, sf_dir), classes=LANGS).select("asset_id", "training_label", "split")


@query("manifest_order", v.sql("""SELECT row_number() OVER (ORDER BY split, training_label, relative_path) AS line, relative_path
  FROM split""", "assets", "split"))
def manifest_order(spark, sf_dir):
    """Position in the sorted manifest."""
    rows = corpus.grouped_split(assets(spark, sf_dir), classes=LANGS).select("split", "training_label", "relative_path")
    return sorted_index(rows, ["split", "training_label", "relative_path"], "_n").select((F.col("_n") + 1).alias("line"), "relative_path")


@query("leakage_check", v.sql("""SELECT 'content' AS kind, sha256 AS item FROM bad GROUP BY sha256 HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'group', tl || ':' || g FROM bad GROUP BY tl, g HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'no-split', relative_path FROM bad WHERE split = ''""", "assets", extra=f"""bad AS (SELECT *,
  CASE WHEN label IN ({LANG_LIST}) THEN label ELSE 'negative' END AS tl,
  CASE WHEN label IN ({LANG_LIST}) AND source_group <> '' THEN source_group ELSE asset_id END AS g,
  CASE WHEN active_offset_samples < 100 THEN '' WHEN substr(sha256(asset_id), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split FROM assets)"""))
def leakage_check(spark, sf_dir):
    """A split made per asset, which leaks groups and copies."""
    rows = assets(spark, sf_dir).withColumn("split", F.when(F.col("active_offset_samples") < 100, "").when(
        F.substring(F.sha2("asset_id", 256), 1, 1) < "8", "train").otherwise("test"))
    return corpus.leakage_check(rows, LANGS)


@query("review_queue", v.sql("SELECT asset_id, relative_path FROM assets WHERE review_status = 'review'", "assets"))
def review_queue(spark, sf_dir):
    return corpus.review_queue(assets(spark, sf_dir)).select("asset_id", "relative_path")


@query("dataset_fingerprint", v.sql("SELECT count(*) AS rows, 64 AS digits FROM assets", "assets"))
def dataset_fingerprint(spark, sf_dir):
    """The digest itself has no SQL twin; its row count and length do."""
    print_ = corpus.dataset_fingerprint(assets(spark, sf_dir), ["asset_id", "sha256", "duplicate_of"])
    return print_.select("rows", F.length("fingerprint").alias("digits"))


# --- paths -------------------------------------------------------------------------------------------

FOLDER_SQL = "[" + ", ".join(f"'{f}'" for f in corpus.FIREARM_FOLDERS) + "]"
PATH_SQL = f"""CASE WHEN p_size < 10 THEN 'player/footsteps/' || CASE WHEN p_size < 3 THEN 'land_' ELSE '' END || split_part(p_name, ' ', 1)
    || CASE WHEN p_size < 6 THEN '_ct_0' ELSE '_t_0' END || p_size || '.wav'
  WHEN p_size < 35 THEN 'weapons/' || {FOLDER_SQL}[1 + p_size % 33] || '/' || replace(p_name, ' ', '_') ||
    CASE WHEN p_size < 15 THEN '_clean' WHEN p_size < 20 THEN '_boltback' WHEN p_size < 25 THEN '_silencer_on' ELSE '' END || '.wav'
  WHEN p_size < 40 THEN 'weapons/fx/' || split_part(p_name, ' ', 1) || '/a.wav'
  WHEN p_size < 45 THEN 'weapons/knife_' || split_part(p_name, ' ', 1) || '/b.wav' ELSE replace(p_name, ' ', '/') || '_zoom.wav' END"""


def paths(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    first = F.split_part(name, F.lit(" "), F.lit(1))
    folder = F.element_at(F.array(*[F.lit(f) for f in corpus.FIREARM_FOLDERS]), (1 + size % 33).cast("int"))
    snake = F.regexp_replace(name, " ", "_")
    path = (F.when(size < 10, F.concat(F.lit("player/footsteps/"), F.when(size < 3, "land_").otherwise(""), first,
                                       F.when(size < 6, "_ct_0").otherwise("_t_0"), size.cast("string"), F.lit(".wav")))
            .when(size < 35, F.concat(F.lit("weapons/"), folder, F.lit("/"), snake, F.when(size < 15, "_clean").when(
                size < 20, "_boltback").when(size < 25, "_silencer_on").otherwise(""), F.lit(".wav")))
            .when(size < 40, F.concat(F.lit("weapons/fx/"), first, F.lit("/a.wav")))
            .when(size < 45, F.concat(F.lit("weapons/knife_"), first, F.lit("/b.wav")))
            .otherwise(F.concat(F.regexp_replace(name, " ", "/"), F.lit("_zoom.wav"))))
    return v.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


TOKEN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(stem, '{'|'.join(w)}') THEN '{n}'" for n, w in corpus.MECHANICAL_TOKENS.items()) + " END"


@query("classify_path", f"""WITH a AS (SELECT p_partkey, {PATH_SQL} AS path FROM part),
b AS (SELECT *, string_split(path, '/') AS parts, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM a),
c AS (SELECT *, parts[1] AS top, parts[2] AS sec, len(parts) AS depth, {TOKEN_SQL} AS token,
  regexp_replace(regexp_replace(stem, '_[0-9]+$', ''), '(_ct|_t)$', '') AS surface FROM b),
k AS (SELECT *, CASE WHEN depth >= 3 AND top = 'player' AND sec = 'footsteps' THEN 1
  WHEN depth >= 3 AND top = 'weapons' AND list_contains({FOLDER_SQL}, sec) THEN CASE WHEN token IS NOT NULL THEN 2 ELSE 3 END
  WHEN token IS NOT NULL THEN 4 WHEN top = 'player' THEN 5 WHEN depth >= 2 AND top = 'weapons' AND sec = 'fx' THEN 6
  WHEN depth >= 2 AND top = 'weapons' THEN 7 ELSE 8 END AS rule FROM c)
SELECT p_partkey, path, CASE rule WHEN 1 THEN 'footstep' WHEN 2 THEN 'mechanical' WHEN 3 THEN 'gunshot' WHEN 4 THEN 'mechanical' ELSE 'other' END AS label,
  CASE rule WHEN 1 THEN CASE WHEN surface LIKE 'land\\_%' ESCAPE '\\' THEN 'landing' ELSE 'step' END WHEN 2 THEN token WHEN 3 THEN 'weapon_report' WHEN 4 THEN token
    WHEN 5 THEN 'player' WHEN 6 THEN 'projectile_fx' WHEN 7 THEN CASE WHEN sec LIKE 'knife%' OR sec = 'bknife' THEN 'melee' ELSE 'weapon_other' END
    ELSE 'other' END AS subtype,
  CASE rule WHEN 1 THEN 'surface:' || surface WHEN 2 THEN 'weapon:' || sec WHEN 3 THEN 'weapon:' || sec
    WHEN 4 THEN CASE WHEN top = 'weapons' AND depth >= 2 THEN 'weapon:' || sec ELSE 'mechanical:misc' END WHEN 5 THEN 'other:player'
    WHEN 6 THEN CASE WHEN depth >= 3 THEN 'other:weapon_fx/' || parts[3] ELSE 'other:weapon_fx' END WHEN 7 THEN 'other:weapon/' || sec
    ELSE 'other:' || top END AS "group",
  CASE WHEN rule = 3 AND contains(stem, 'clean') THEN 'review' ELSE 'accepted' END AS review FROM k""")
def classify_path(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumn("c", corpus.classify_path(F.col("path")))
    return rows.select("p_partkey", "path", "c.label", "c.subtype", "c.group", "c.review")


# --- sessions ----------------------------------------------------------------------------------------

ROLES = ("user", "assistant")


def talks(spark, sf_dir):
    """Conversations as labelled sessions: a turn is an event, its role the class."""
    marks = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), "quality", "toxic")
    turns = v.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    timeline = turns.join(marks, "session_id", "left").select(
        "session_id", "turn", F.col("role").alias("class"), (F.col("turn") * 1000).alias("onset_sample"),
        (F.col("turn") * 1000 + F.length("text")).alias("end_sample"),
        F.when(F.length("text") < 100, "self").when(F.length("text") < 800, "remote").otherwise("model").alias("source_hint"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("reviewed"), (F.coalesce("toxic", F.lit(0)) == 1).alias("uncertain"),
        F.lit(None).cast("string").alias("scene_mode"))
    digest = F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 1)
    split = F.when(digest < "9", "train").when(digest < "c", "dev").otherwise("test")
    sessions = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars")).select(
        "session_id", F.when(F.col("n") > 2, split).alias("split"), F.concat(split, F.lit("_"), F.col("session_id").cast("string")).alias("name"),
        F.concat(F.lit("m"), F.col("n").cast("string")).alias("map"), F.concat(F.lit("d"), (F.col("longest") % 7).cast("string")).alias("capture_day"),
        (F.col("chars") / 4.0).alias("duration_seconds"), (F.col("n") * 1000 - 200).alias("length"),
        F.when(F.col("n") > 4, "real-session-v4").otherwise("mix-v2").alias("generator_version"))
    return sessions, timeline


v.CTE["talks"] = """timeline AS (SELECT conv_id AS session_id, turn, role AS class, turn * 1000 AS onset_sample, turn * 1000 + length(text) AS end_sample,
  CASE WHEN length(text) < 100 THEN 'self' WHEN length(text) < 800 THEN 'remote' ELSE 'model' END AS source_hint,
  coalesce(quality, 1) = 1 AS reviewed, coalesce(toxic, 0) = 1 AS uncertain FROM conversations LEFT JOIN labels ON doc_id = conv_id),
talks0 AS (SELECT conv_id AS session_id, count(*) AS n, max(length(text)) AS longest, sum(length(text)) AS chars,
  substr(sha256(CAST(conv_id AS VARCHAR)), 1, 1) AS digest FROM conversations GROUP BY conv_id),
talks AS (SELECT session_id, CASE WHEN digest < '9' THEN 'train' WHEN digest < 'c' THEN 'dev' ELSE 'test' END AS split, 'm' || n AS map,
  'd' || (longest % 7) AS capture_day, chars / CAST(4 AS DOUBLE) AS duration_seconds, n * 1000 - 200 AS length,
  CASE WHEN n > 4 THEN 'real-session-v4' ELSE 'mix-v2' END AS generator_version FROM talks0)"""
v.CTE["audit"] = """tgt AS (SELECT * FROM timeline WHERE class IN ('user', 'assistant') AND NOT uncertain),
audit AS (SELECT count(*) AS sessions, sum(duration_seconds) AS duration_seconds,
  coalesce(sum(duration_seconds) FILTER (WHERE session_id NOT IN (SELECT session_id FROM tgt)), 0.0) AS target_free_seconds,
  coalesce(sum(duration_seconds) FILTER (WHERE split = 'test' AND session_id NOT IN (SELECT session_id FROM tgt)), 0.0) AS test_target_free_seconds,
  string_agg(DISTINCT map, ',' ORDER BY map) AS maps, string_agg(DISTINCT capture_day, ',' ORDER BY capture_day) AS capture_days,
  coalesce(string_agg(DISTINCT map, ',' ORDER BY map) FILTER (WHERE split = 'test'), '') AS test_maps,
  coalesce(string_agg(DISTINCT capture_day, ',' ORDER BY capture_day) FILTER (WHERE split = 'test'), '') AS test_capture_days,
  (SELECT count(*) FROM timeline WHERE uncertain) AS uncertain_events, (SELECT count(*) FROM timeline WHERE NOT reviewed) AS unreviewed_events FROM talks),
sup AS (SELECT split || ':' || class || ':' || source_hint AS key, count(*) AS n FROM tgt JOIN talks USING (session_id) GROUP BY 1)"""


def audit(spark, sf_dir):
    sessions, timeline = talks(spark, sf_dir)
    return corpus.corpus_audit(sessions, timeline, ROLES)


@query("corpus_audit", v.sql("""SELECT *, (SELECT string_agg(key || '=' || n, ';' ORDER BY key) FROM sup) AS support FROM audit""", "talks", "audit"))
def corpus_audit(spark, sf_dir):
    row = audit(spark, sf_dir)
    lists = {n: F.array_join(n, ",") for n in ("maps", "capture_days", "test_maps", "test_capture_days")}
    pairs = F.transform(F.map_entries("support"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return row.withColumns({**lists, "support": F.array_join(pairs, ";")})


def need(source, n):
    return " AND ".join(f"coalesce((SELECT n FROM sup WHERE key = 'test:{c}:{source}'), 0) >= {n}" for c in ROLES)


GATES = f"""SELECT (SELECT count(DISTINCT split_part(key, ':', 1)) FILTER (WHERE key LIKE 'train:%' OR key LIKE 'dev:%') = 2 FROM sup) AS train_and_dev_present,
  unreviewed_events = 0 AS all_labels_reviewed, {need('remote', 30)} AS locked_remote_support, {need('self', 20)} AS locked_self_support,
  test_target_free_seconds >= 3600 AS target_free_hour,
  (SELECT count(DISTINCT map) >= 3 FROM talks WHERE split = 'test') AS map_diversity,
  (SELECT count(DISTINCT capture_day) >= 3 FROM talks WHERE split = 'test') AS capture_day_diversity FROM audit"""


@query("readiness_gates", v.sql("""SELECT *, train_and_dev_present AND all_labels_reviewed AND locked_remote_support AND locked_self_support
  AND target_free_hour AND map_diversity AND capture_day_diversity AS ready FROM gates""", "talks", "audit", extra=f"gates AS ({GATES})"))
def readiness_gates(spark, sf_dir):
    return corpus.readiness_gates(audit(spark, sf_dir), ROLES, remote=30, own=20)


@query("require_reviewed", v.sql("SELECT session_id, bool_and(reviewed) AS all_reviewed FROM timeline GROUP BY session_id", "talks"))
def require_reviewed(spark, sf_dir):
    return corpus.require_reviewed(talks(spark, sf_dir)[1])


@query("domain_tag", v.sql("""SELECT session_id, CASE WHEN generator_version LIKE 'real-session%' THEN 'real' ELSE 'synthetic' END AS domain FROM talks""", "talks"))
def domain_tag(spark, sf_dir):
    return talks(spark, sf_dir)[0].select("session_id", corpus.domain_tag().alias("domain"))


@query("prefer_real_dev", v.sql("SELECT session_id, generator_version FROM talks WHERE generator_version LIKE 'real-session%'", "talks"))
def prefer_real_dev(spark, sf_dir):
    rows = talks(spark, sf_dir)[0].withColumn("domain", corpus.domain_tag())
    return corpus.prefer_real(rows).select("session_id", "generator_version")


@query("session_bundle", v.sql("""SELECT t.session_id, t.length, t.split FROM talks t
  WHERE t.session_id % 5 <> 0 OR t.session_id IN (SELECT session_id FROM tgt WHERE source_hint = 'remote')""", "talks", "audit"))
def session_bundle(spark, sf_dir):
    """Label files are written and listed; a file without a label still makes a session, four in five have one at least."""
    sessions, timeline = talks(spark, sf_dir)
    labels = timeline.filter("class in ('user', 'assistant') and not uncertain and source_hint = 'remote'")
    path = scratch_path(spark, "labels")
    tables.write_timeline(labels, path, sessions=sessions.filter("session_id % 5 <> 0"))
    listed = tables.timeline_sessions(spark, path).select(F.col("session_id").cast("bigint").alias("session_id"))
    meta = sessions.select("session_id", F.coalesce("split", F.element_at(F.split("name", "_"), 1)).alias("split"))
    return corpus.session_bundle(sessions.select("session_id", "length"), listed, meta)


@query("normalize_timeline", v.sql("""SELECT session_id, turn, class, onset_sample, end_sample,
  CASE WHEN source_hint = 'model' THEN 'unknown' ELSE source_hint END AS source_hint, 'unknown' AS scene_mode,
  concat_ws(',', CASE WHEN class NOT IN ('user', 'assistant', 'negative') THEN 'class' END,
    CASE WHEN NOT (onset_sample >= 0 AND onset_sample < length AND onset_sample < end_sample AND end_sample <= length) THEN 'bounds' END) AS violations
  FROM timeline JOIN talks USING (session_id)""", "talks"))
def normalize_timeline(spark, sf_dir):
    sessions, timeline = talks(spark, sf_dir)
    rows = validation.normalize_timeline(timeline.join(sessions.select("session_id", "length"), "session_id"), "length", ROLES)
    return rows.select("session_id", "turn", "class", "onset_sample", "end_sample", "source_hint", "scene_mode",
                       F.array_join("violations", ",").alias("violations"))


# --- rule tables ---------------------------------------------------------------------------------------

def scene_rows(spark, sf_dir):
    """Suppliers as scene manifest rows: nation and balance decide the targets, some rows break rules."""
    key, nation, balance = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    turn = F.pmod(F.floor(balance), F.lit(400)).cast("double")

    def target(offset):
        return F.struct(F.when(balance < 0, "voice").otherwise("gunshot").alias("sound_class"), F.struct(
            (turn + offset).alias("azimuth_degrees"), (F.pmod(F.floor(balance / 7), F.lit(130)) - 65.0).alias("elevation_degrees")
        ).alias("rendered_direction"))
    targets = F.slice(F.array(target(0.0), target(20.0), target(70.0)), 1, (nation % 4).cast("int"))
    return v.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.when(nation == 7, F.lit("dup")).otherwise(key.cast("string"))).alias("scene_id"),
        F.when(nation == 3, "scenes-v0").otherwise("scenes-v1").alias("schema_version"), F.lit("r1").alias("renderer_version"),
        F.lit(48000).alias("sample_rate"), F.lit(12304).alias("sample_count"), F.when(nation == 5, 47).otherwise(48).alias("feature_frames"),
        F.concat(F.when(nation == 9, "/").when(nation == 10, "../").otherwise(""), F.lit("w/"), key.cast("string"), F.lit(".wav")).alias("relative_path"),
        F.when(nation == 11, "xyz").otherwise(F.sha2(F.col("s_name"), 256)).alias("wav_sha256"),
        F.when(nation == 12, "none").otherwise("train").alias("split"), (nation % 4).alias("target_count"), targets.alias("targets"),
        F.when(nation == 13, "far").when(nation % 2 == 0, "close-15-30").otherwise("standard").alias("stratum"))


@query("validate_scenes", """WITH r AS (SELECT s_suppkey, s_nationkey AS n, s_acctbal AS b,
  CASE WHEN s_nationkey = 7 THEN 'sdup' ELSE 's' || s_suppkey END AS scene_id, s_nationkey % 4 AS k,
  CAST(floor(s_acctbal) AS BIGINT) - 400 * CAST(floor(floor(s_acctbal) / 400.0) AS BIGINT) AS az,
  CAST(floor(s_acctbal / 7) AS BIGINT) - 130 * CAST(floor(floor(s_acctbal / 7) / 130.0) AS BIGINT) - 65 AS el,
  CASE WHEN s_nationkey = 13 THEN 'far' WHEN s_nationkey % 2 = 0 THEN 'close-15-30' ELSE 'standard' END AS stratum FROM supplier),
g AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, sin(radians(el)) ** 2 + cos(radians(el)) ** 2 * cos(radians(20)))))) AS near20,
  degrees(acos(greatest(-1.0, least(1.0, sin(radians(el)) ** 2 + cos(radians(el)) ** 2 * cos(radians(50)))))) AS near50 FROM r)
SELECT scene_id, rule FROM (
  SELECT scene_id, unnest([CASE WHEN n = 3 THEN 'schema' END, CASE WHEN n = 5 THEN 'contract' END,
    CASE WHEN n = 7 AND count(*) OVER (PARTITION BY scene_id) > 1 THEN 'scene_id_unique' END, CASE WHEN n IN (9, 10) THEN 'path_relative' END, CASE WHEN n = 11 THEN 'digest' END,
    CASE WHEN n = 12 THEN 'split' END, CASE WHEN k > 0 AND b < 0 THEN 'target_class' END,
    CASE WHEN (k >= 1 AND az >= 360) OR (k >= 2 AND az + 20 >= 360) OR (k >= 3 AND az + 70 >= 360) OR (k >= 1 AND abs(el) > 60) THEN 'direction' END,
    CASE WHEN n <> 3 AND n = 13 THEN 'stratum' END, CASE WHEN n <> 3 AND k >= 2 AND near20 < 15 - 1e-6 THEN 'separation' END,
    CASE WHEN n <> 3 AND stratum = 'close-15-30' AND NOT (k >= 2 AND near20 <= 30 + 1e-6) THEN 'close_pair' END]) AS rule FROM g) WHERE rule IS NOT NULL""")
def validate_scenes(spark, sf_dir):
    return validation.validate_scenes(scene_rows(spark, sf_dir), "scenes-v1", "r1")


@query("validate_policy", """WITH p AS (SELECT s_suppkey AS policy_id, s_acctbal / 10000 AS thr, s_nationkey AS n,
  CASE WHEN s_nationkey = 4 THEN 'a/b.bin' WHEN s_nationkey = 5 THEN '' ELSE s_name END AS file FROM supplier)
SELECT policy_id, rule FROM (SELECT policy_id, unnest([CASE WHEN NOT (thr > 0 AND thr <= 1) THEN 'threshold_a' END,
  CASE WHEN NOT (n > 0 AND n < 15) THEN 'duplicate_merge_degrees' END, CASE WHEN n = 0 OR n <= 10 THEN 'confidence_rises' END,
  CASE WHEN 8 + n > 25 THEN 'error_narrows' END, CASE WHEN file = '' OR contains(file, '/') THEN 'model_file' END,
  CASE WHEN n = 6 THEN 'model_sha256' END]) AS rule FROM p) WHERE rule IS NOT NULL""")
def validate_policy(spark, sf_dir):
    """Suppliers as direction policies: balance is the threshold, the nation shapes the tables."""
    n = F.col("s_nationkey")
    steps = [(F.lit(0.0), F.lit(60.0)), (n / 50.0, F.lit(25.0)), (F.lit(0.2) + F.when(n > 10, n / 50.0).otherwise(n / 100.0 - 0.2), 8.0 + n)]
    table = F.array(*[F.struct(c.cast("double").alias("confidence"), e.cast("double").alias("p90")) for c, e in steps])
    rows = v.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("policy_id"), F.create_map(
            F.lit("threshold_a"), F.col("s_acctbal") / 10000, F.lit("duplicate_merge_degrees"), n.cast("double")).alias("policy"),
        table.alias("uncertainty"), F.when(n == 4, "a/b.bin").when(n == 5, "").otherwise(F.col("s_name")).alias("model_file"),
        F.lit("aa").alias("model_sha256"), F.when(n == 6, "bb").otherwise("aa").alias("model_digest"))
    rules = {**validation.direction_policy_rules(("a",)), **validation.model_file_rules()}
    return validation.violations(rows, rules, ["policy_id"])


# setting: its value in terms of the balance b and the nation n, its rule
RECOGNITION = {"scene_activity_cutoff": ("b * 2", "x > 0 AND x < 1"), "self_suppression_threshold": ("n / 20", "x > 0 AND x <= 1"),
               "peak_lookahead_frames": ("n - 2", "x >= 0"), "pulse_ms": ("n - 3", "x > 0"), "inference_stride_frames": ("20 - n", "x > 0"),
               "threshold_quiet_a": ("b", "x > 0 AND x <= 1"), "threshold_busy_a": ("b + 0.3", "x > 0 AND x <= 1"),
               "minimum_spacing_ms_a": ("n - 1", "x > 0"), "onset_offset_samples_a": ("n - 4", "x >= 0")}
SETTINGS = " UNION ALL ".join(f"SELECT policy_id, '{name}' AS rule, {rule} AS holds FROM (SELECT policy_id, {value} AS x FROM p)"
                              for name, (value, rule) in RECOGNITION.items())


@query("validate_recognition_policy", f"""WITH p AS (SELECT s_suppkey AS policy_id, CAST(s_acctbal AS DOUBLE) / 10000 AS b, CAST(s_nationkey AS DOUBLE) AS n FROM supplier)
SELECT policy_id, rule FROM ({SETTINGS}) WHERE NOT holds""")
def validate_recognition_policy(spark, sf_dir):
    """Suppliers as recognition policies: balance and nation shape the settings."""
    rows = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("policy_id"), (F.col("s_acctbal").cast("double") / 10000).alias("b"),
                                                     F.col("s_nationkey").cast("double").alias("n"))
    settings = F.create_map(*[x for name, (value, _) in RECOGNITION.items() for x in (F.lit(name), F.expr(f"CAST({value} AS DOUBLE)"))])
    return validation.violations(rows.select("policy_id", settings.alias("policy")), validation.policy_rules(("a",)), ["policy_id"])


@query("validate_corpus_contract", """SELECT s_suppkey AS meta_id, rule FROM (SELECT s_suppkey, unnest([CASE WHEN s_nationkey <> 8 THEN 'feature_frames' END,
  CASE WHEN s_nationkey = 2 THEN 'mel_bins' END]) AS rule FROM supplier) WHERE rule IS NOT NULL""")
def validate_corpus_contract(spark, sf_dir):
    n = F.col("s_nationkey")
    meta = F.map_from_arrays(F.array(F.lit("feature_frames"), F.when(n == 2, "other").otherwise("mel_bins")), F.array(n.cast("string"), F.lit("64")))
    rows = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("meta_id"), meta.alias("meta"))
    return validation.contract_violations(rows, {"feature_frames": "8", "mel_bins": "64"}, keep=["meta_id"])


@query("clamp_policy", """SELECT c_custkey AS policy_id, greatest(0.01, least(1.0, CASE WHEN c_acctbal < -900 THEN 0.95 ELSE c_acctbal / 5000 END)) AS threshold,
  greatest(1.0, least(5000.0, c_acctbal)) AS minimum_spacing_ms FROM customer""")
def clamp_policy(spark, sf_dir):
    balance = F.col("c_acctbal")
    rows = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("policy_id"), F.when(balance < -900, F.lit(float("nan"))).otherwise(balance / 5000).alias("threshold"),
        balance.alias("minimum_spacing_ms"))
    limits = {k: validation.TUNING_LIMITS[k] for k in ("threshold", "minimum_spacing_ms")}
    return validation.clamp_policy(rows, limits)


@query("finite_check", """SELECT vec_id, len(embedding) = 64 AND label <> 3 AS ok FROM embeddings""")
def finite_check(spark, sf_dir):
    values = F.transform("embedding", lambda x, i: F.when((i == 5) & (F.col("label") == 3), F.lit(float("nan"))).otherwise(x.cast("double")))
    return v.table(spark, sf_dir, "embeddings").select("vec_id", validation.finite_check(values, 64).alias("ok"))
