"""Asset inventories, splits and the audit of labelled sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators.ordered import running

# Folder and token lists the path rules are defined by.
FIREARM_FOLDERS = (
    "ak47", "aug", "awp", "bizon", "cz75a", "deagle", "elite", "famas", "fiveseven", "g3sg1", "galilar", "glock18",
    "hkp2000", "m249", "m4a1", "mac10", "mag7", "mp5", "mp7", "mp9", "negev", "nova", "p250", "p90", "revolver",
    "sawedoff", "scar20", "sg556", "ssg08", "tec9", "ump45", "usp", "xm1014",
)
MECHANICAL_TOKENS = {
    "reload": ("clip", "reload", "box", "chain", "cover", "insertshell"),
    "weapon_action": ("bolt", "slide", "pump", "hammer", "prepare", "sideback", "siderelease", "mech"),
    "attachment": ("silencer_on", "silencer_off", "silencer_screw"),
    "draw": ("draw", "deploy"),
    "zoom": ("zoom",),
    "switch": ("switch",),
    "grenade_handling": ("pinpull", "throw"),
    "device_handling": ("plant", "disarm", "key_press", "initiate", "click"),
    "handling": ("movement", "lowammo", "special", "taunt", "element"),
}
NEGATIVE_LABELS = ("mechanical", "other", "negative")
SPLITS = ("train", "dev", "test")


def is_target(classes: Sequence[str] = params.CLASS_NAMES) -> Column:
    return F.col("label").isin(*classes)


def training_label(classes: Sequence[str] = params.CLASS_NAMES) -> Column:
    return F.when(is_target(classes), F.col("label")).otherwise("negative")


def canonical_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("included") & (F.coalesce("duplicate_of", F.lit("")) == ""))


def domain_tag() -> Column:
    real = F.coalesce(F.col("generator_version").startswith("real-session"), F.lit(False)) | F.col("name").contains("_real_")
    return F.when(real, "real").otherwise("synthetic")


def classify_path(path: Column) -> Column:
    """Ordered rules: footsteps by surface, handling noises by token, firearm reports, the rest."""
    parts = F.split(F.lower(path), "/")
    top, second, depth = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    surface = F.regexp_replace(F.regexp_replace(stem, "_[0-9]+$", ""), "(_ct|_t)$", "")
    token = F.lit(None).cast("string")
    for name, words in reversed(MECHANICAL_TOKENS.items()):
        token = F.when(stem.rlike("|".join(words)), name).otherwise(token)
    footstep = (depth >= 3) & (top == "player") & (second == "footsteps")
    weapon = (depth >= 2) & (top == "weapons")
    firearm = (depth >= 3) & (top == "weapons") & second.isin(*FIREARM_FOLDERS)

    def row(label, subtype, group, review="accepted"):
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(label).alias("label"), as_col(subtype).alias("subtype"), as_col(group).alias("group"),
                        as_col(review).alias("review"))
    of_weapon = F.concat(F.lit("weapon:"), second)
    return (
        F.when(footstep, row("footstep", F.when(surface.startswith("land_"), "landing").otherwise("step"),
                             F.concat(F.lit("surface:"), surface)))
        .when(firearm & token.isNotNull(), row("mechanical", token, of_weapon))
        .when(firearm, row("gunshot", "weapon_report", of_weapon,
                           F.when(stem.contains("clean"), "review").otherwise("accepted")))
        .when(token.isNotNull(), row("mechanical", token, F.when(weapon, of_weapon).otherwise("mechanical:misc")))
        .when(top == "player", row("other", "player", "other:player"))
        .when(weapon & (second == "fx"), row("other", "projectile_fx", F.when(
            depth >= 3, F.concat(F.lit("other:weapon_fx/"), F.get(parts, F.lit(2)))).otherwise("other:weapon_fx")))
        .when(weapon, row("other", F.when(second.startswith("knife") | (second == "bknife"), "melee")
                          .otherwise("weapon_other"), F.concat(F.lit("other:weapon/"), second)))
        .otherwise(row("other", "other", F.concat(F.lit("other:"), F.coalesce(top, F.lit("misc"))))))


def content_duplicates(assets: DataFrame, digest: str = "sha256", path: str = "relative_path") -> DataFrame:
    """Later paths with the same content point to the first path.  One aggregate per content, joined back:
    a content with very many copies is pre-aggregated and its rows stay spread.  Assets without a digest are no copies."""
    first = (assets.filter(F.coalesce(digest, F.lit("")) != "").groupBy(digest)
             .agg(F.min(path).alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").drop("_copies"))
    joined = assets.join(first, digest, "left")
    copy = F.col("_first").isNotNull() & (F.col(path) != F.col("_first"))
    return joined.withColumn("duplicate_of", F.when(copy, F.col("_first")).otherwise(F.lit(""))).drop("_first")


def manifest_summary(assets: DataFrame, classes: Sequence[str] = params.CLASS_NAMES) -> DataFrame:
    label = training_label(classes)
    return assets.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("included")).alias("included"),
        F.count_if(F.coalesce("duplicate_of", F.lit("")) != "").alias("duplicates"),
        F.count_if(~F.col("review_status").isin("reviewed", "accepted")).alias("needs_review"),
        *[F.count_if(label == name).alias(f"count_{name}") for name in (*classes, "negative")])


def grouping_value(classes: Sequence[str]) -> Column:
    family = F.when(F.coalesce("source_group", F.lit("")) != "", F.col("source_group")).otherwise(F.col("asset_id"))
    return F.when(is_target(classes), family).otherwise(F.col("asset_id"))


def grouped_split(assets: DataFrame, seed: int = params.SPLIT_SEED, classes: Sequence[str] = params.CLASS_NAMES,
                  limits: tuple[float, float] = params.SPLIT_LIMITS) -> DataFrame:
    """Leakage-safe train/dev/test: whole groups in hash order, placed by the middle of their cumulative
    count.  The order is cut into hash ranges, so a label with one group per item is not one sort."""
    rows = canonical_assets(assets).withColumn("training_label", training_label(classes)).withColumn(
        "_group", grouping_value(classes))
    # the hashed text repeats the label
    text = F.concat_ws(":", F.lit(str(seed)), "training_label", "training_label", "_group")
    sizes = (rows.groupBy("training_label", "_group").agg(F.count(F.lit(1)).alias("_size"))
             .withColumn("_hash", F.sha2(text, 256))
             .withColumn("_pos", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")))
    placed = running(sizes, ["training_label"], "_pos", ["_hash"], 1 << 22, {"_cum": ("sum", "_size")})
    totals = sizes.groupBy("training_label").agg(F.sum("_size").alias("_total"))
    middle = F.col("_cum") - F.col("_size") / 2.0
    split = (F.when(middle <= F.col("_total") * limits[0], "train")
             .when(middle <= F.col("_total") * limits[1], "dev").otherwise("test"))
    decided = placed.join(F.broadcast(totals), "training_label").select("training_label", "_group", split.alias("split"))
    return rows.drop("split").join(decided, ["training_label", "_group"]).drop("_group")


def manifest_order(assets: DataFrame) -> DataFrame:
    return assets.orderBy("split", "training_label", "relative_path")


def leakage_check(assets: DataFrame, classes: Sequence[str] = params.CLASS_NAMES) -> DataFrame:
    """Contents or groups that appear in more than one split, and assets without a split."""
    two = F.min("split") != F.max("split")
    content = (assets.filter(F.coalesce("sha256", F.lit("")) != "").groupBy(F.col("sha256").alias("item"))
               .agg(two.alias("bad")).filter("bad").select(F.lit("content").alias("kind"), "item"))
    group = (assets.groupBy(F.concat_ws(":", training_label(classes), grouping_value(classes)).alias("item"))
             .agg(two.alias("bad")).filter("bad").select(F.lit("group").alias("kind"), "item"))
    missing = assets.filter(F.coalesce("split", F.lit("")) == "").select(
        F.lit("no-split").alias("kind"), F.col("relative_path").alias("item"))
    return content.unionByName(group).unionByName(missing)


def review_queue(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("review_status") == "review")


def session_bundle(recordings: DataFrame, timelines: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sessions that have all three parts.  ``timelines`` has the session of every label file, also of files without a
    label: a target-free recording is a session."""
    labelled = timelines.select("session_id").distinct()
    return recordings.join(metadata, "session_id").join(labelled, "session_id", "left_semi")


def require_reviewed(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("session_id").agg(F.bool_and(F.coalesce("reviewed", F.lit(True))).alias("all_reviewed"))


def corpus_audit(sessions: DataFrame, timeline: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row over all sessions: duration, target-free time, maps, days, support and open labels."""
    target = F.col("class").isin(*classes) & ~F.col("uncertain")
    per_session = timeline.groupBy("session_id").agg(
        F.count_if(target).alias("targets"), F.count_if(F.col("uncertain")).alias("uncertain_events"),
        F.count_if(~F.col("reviewed")).alias("unreviewed_events"))
    rows = sessions.join(per_session, "session_id", "left").fillna(0, ["targets", "uncertain_events", "unreviewed_events"])
    split = F.coalesce("split", F.element_at(F.split("name", "_"), 1))
    rows = rows.withColumn("split", split)
    free, test = F.col("targets") == 0, F.col("split") == "test"

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("duration_seconds"))), F.lit(0.0))

    def names(column, cond=None):
        value = F.when(F.col(column) != "", F.col(column))
        return F.sort_array(F.collect_set(value if cond is None else F.when(cond, value)))
    head = rows.agg(
        F.count(F.lit(1)).alias("sessions"), total(F.lit(True)).alias("duration_seconds"),
        total(free).alias("target_free_seconds"), total(free & test).alias("test_target_free_seconds"),
        names("map").alias("maps"), names("capture_day").alias("capture_days"), names("map", test).alias("test_maps"),
        names("capture_day", test).alias("test_capture_days"), F.sum("uncertain_events").alias("uncertain_events"),
        F.sum("unreviewed_events").alias("unreviewed_events"))
    keyed = (timeline.filter(target).groupBy("session_id", "class", "source_hint").agg(F.count(F.lit(1)).alias("n"))
             .join(rows.select("session_id", "split"), "session_id")
             .groupBy(F.concat_ws(":", "split", "class", "source_hint").alias("key")).agg(F.sum("n").alias("n")))
    support = keyed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("support"))
    return head.crossJoin(F.broadcast(support))


def readiness_gates(audit: DataFrame, classes: Sequence[str], remote: int = 300, own: int = 200) -> DataFrame:
    def enough(source, minimum):
        out = F.lit(True)
        for name in classes:
            out = out & (F.coalesce(F.col("support")[f"test:{name}:{source}"], F.lit(0)) >= minimum)
        return out
    splits = F.transform(F.map_keys("support"), lambda k: F.element_at(F.split(k, ":"), 1))
    gates = {
        "train_and_dev_present": F.array_contains(splits, "train") & F.array_contains(splits, "dev"),
        "all_labels_reviewed": F.col("unreviewed_events") == 0,
        "locked_remote_support": enough("remote", remote), "locked_self_support": enough("self", own),
        "target_free_hour": F.col("test_target_free_seconds") >= 3600.0,
        "map_diversity": F.size("test_maps") >= 3, "capture_day_diversity": F.size("test_capture_days") >= 3,
    }
    ready = F.lit(True)
    for gate in gates.values():
        ready = ready & gate
    return audit.select(*[g.alias(n) for n, g in gates.items()], ready.alias("ready"))


def prefer_real(records: DataFrame, domain: str = "domain") -> DataFrame:
    """Real-domain records when there are any, otherwise all."""
    any_real = records.agg(F.coalesce(F.bool_or(F.col(domain) == "real"), F.lit(False)).alias("_any"))
    return records.crossJoin(F.broadcast(any_real)).filter(~F.col("_any") | (F.col(domain) == "real")).drop("_any")


def dataset_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One digest for a whole table, independent of row order.

    Rows are digested and summed per bucket of the digest (sums do not depend on order and count
    repeated rows), then the bucket sums are digested: no list of all rows is formed.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    word = lambda i: F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    parts = df.select(row.alias("_d")).groupBy(F.substring("_d", 1, 3).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(word(i)).cast("string").alias(f"_w{i}") for i in range(5)])
    line = F.concat_ws("|", "_b", F.col("_n").cast("string"), *[f"_w{i}" for i in range(5)])
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"),
                     F.sum("_n").alias("rows"))
