"""Deterministic allocation and sampling by hashing: equal inputs give equal samples on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlake import params
from soundlake.operators.ordered import ordinal

HASH_SLICE = 1 << 36      # positions are 48-bit hashes, so a key is cut into up to 4096 slices


def hash_position(*parts: Column) -> Column:
    """48 uniform bits of a SHA-256 over the parts joined with ':'."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("bigint")


def proportional_allocation(totals: DataFrame, total: str, proportions: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Largest-remainder split of each total; equal remainders go to the earlier share."""
    shares = F.posexplode(F.array(*[F.lit(float(p)) for p in proportions])).alias("share_idx", "_p")
    rows = totals.select(*keys, total, shares).withColumn("_exact", F.col("_p") * F.col(total))
    rows = rows.withColumn("_base", F.floor("_exact"))
    group = Window.partitionBy(*keys)
    left = F.col(total) - F.sum("_base").over(group)
    place = F.row_number().over(group.orderBy((F.col("_exact") - F.col("_base")).desc(), "share_idx"))
    return rows.withColumns({"_left": left, "_place": place}).select(
        *keys, "share_idx", (F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).alias("allocated"))


def class_round_robin(scenes: DataFrame, count: str, order: str, width: int, combinations: dict[int, Sequence[str]],
                      offsets: dict[int, int] | None = None) -> DataFrame:
    """The k-th scene with a given target count takes combination (k + offset) mod n of that count."""
    numbered = ordinal(scenes, [count], order, [], width, "_k")
    choice = F.lit(None).cast("string")
    for value, names in combinations.items():
        index = F.pmod(F.col("_k") + (offsets or {}).get(value, 0), F.lit(len(names))).cast("int")
        choice = F.when(F.col(count) == value, F.get(F.array(*[F.lit(n) for n in names]), index)).otherwise(choice)
    return numbered.withColumn("combination", choice).drop("_k")


def stratified_pick(rows: DataFrame, strata: Sequence[str], ident: str, seed: int | str, take: Column) -> DataFrame:
    """Exactly ``take`` rows per stratum in hash order.  ``take`` may use ``stratum_size``."""
    ranked = ordinal(rows.withColumn("_h", hash_position(F.lit(str(seed)), F.col(ident))), strata, "_h", [ident],
                     HASH_SLICE, "_rank")
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    return ranked.join(sizes, list(strata)).filter(F.col("_rank") < take).drop("_h", "_rank", "stratum_size")


def _draw(pool: DataFrame, draws: DataFrame, ident: str, seed: int | str) -> DataFrame:
    """``draws`` (draw, pool, size) with replacement from ``pool`` (pool, ident): a hashed rank each."""
    ranked = ordinal(pool.withColumn("_h", hash_position(F.lit(str(seed)), F.col(ident))), ["pool"], "_h", [ident],
                     HASH_SLICE, "_rank").select("pool", ident, "_rank")
    picked = draws.withColumn("_rank", F.pmod(hash_position(F.lit(f"{seed}:draw"), F.col("draw")), F.col("size")))
    return picked.join(ranked, ["pool", "_rank"]).select("draw", "pool", ident)


def balanced_order(windows: DataFrame, ident: str, seed: int | str, hard: str | None = None) -> DataFrame:
    """One epoch with replacement over ``windows`` (ident, domain, positive[, hard flag]).

    Half real and half synthetic when both exist; half positive inside each.  Hard negatives of the
    domain replace its negatives; an empty pool of a domain falls back to that of all windows.
    """
    is_hard = F.col(hard) if hard else F.lit(False)
    kinds = windows.select(ident, "domain", F.when(F.col("positive"), "positive").when(is_hard, "hard").otherwise("negative").alias("kind"))
    sizes = {(r["domain"], r["kind"]): r["n"] for r in
             kinds.groupBy("domain", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}     # at most six rows
    count = sum(sizes.values())
    domains = sorted({d for d, _ in sizes})
    quotas = ([("real", count // 2), ("synthetic", count - count // 2)]
              if {"real", "synthetic"} <= set(domains) else [("all", count)])

    def members(domain, *names):
        chosen = [(d, k) for d, k in sizes if k in names and domain in ("all", d)]
        return chosen, sum(sizes[c] for c in chosen)

    pools, steps, at = [], [], 0
    for domain, quota in quotas:
        for label, part, options in (
                ("positive", quota // 2, ((domain, "positive"), ("all", "positive"))),
                ("negative", quota - quota // 2, ((domain, "hard"), (domain, "negative", "hard"), ("all", "negative", "hard")))):
            for wanted in options:
                chosen, size = members(*wanted)
                if size:
                    break
            if part and not size:
                raise ValueError(f"no {label} windows to draw from")
            name = f"{domain}:{label}"
            pools.append((name, chosen))
            steps.append((name, at, at + part, size))
            at += part
    pool_of = F.array_compact(F.array(*[F.when(
        F.struct("domain", "kind").isin([F.struct(F.lit(d), F.lit(k)) for d, k in chosen]), F.lit(name))
        for name, chosen in pools if chosen]))
    pool = kinds.withColumn("pool", F.explode(pool_of)).select("pool", ident)
    name, size = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for label, low, high, n in steps:
        inside = (F.col("draw") >= low) & (F.col("draw") < high)
        name, size = F.when(inside, label).otherwise(name), F.when(inside, F.lit(n)).otherwise(size)
    draws = windows.sparkSession.range(count).select(F.col("id").alias("draw"), name.alias("pool"), size.alias("size"))
    # the hash of the draw is its place in the shuffled epoch
    return _draw(pool, draws, ident, seed).withColumn("place", hash_position(F.lit(f"{seed}:order"), F.col("draw")))


def weighted_sample(scenes: DataFrame, ident: str, weight: Column, draws: int, seed: int | str) -> DataFrame:
    """``draws`` rows with replacement, each with probability proportional to its weight.

    Weights take few values: a draw first picks a weight by its total share, then a row inside it, which
    is the same distribution without a cumulative sum over all rows.
    """
    rows = scenes.withColumn("_w", weight)
    counted = rows.groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    groups = sorted((r["_w"], r["n"]) for r in counted.limit(1001).collect())
    if len(groups) > 1000:
        raise ValueError("weights must come from a small set of values")
    total = sum(w * n for w, n in groups)
    bounds, low = [], 0.0
    for w, n in groups:
        low += w * n
        bounds.append((repr(w), n, low if (w, n) != groups[-1] else float("inf")))
    uniform = hash_position(F.lit(f"{seed}:weight"), F.col("draw")) / float(1 << 48) * total
    steps = F.array(*[F.struct(F.lit(name).alias("pool"), F.lit(n).cast("bigint").alias("size"), F.lit(high).alias("high"))
                      for name, n, high in bounds])
    wanted = (scenes.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("_u", uniform)
              .withColumn("_s", F.element_at(F.filter(steps, lambda s: F.col("_u") < s["high"]), 1))
              .select("draw", "_s.pool", "_s.size"))
    labels = F.lit(None).cast("string")
    for w, _ in groups:
        labels = F.when(F.col("_w") == w, repr(w)).otherwise(labels)
    return _draw(rows.withColumn("pool", labels), wanted, ident, seed)


def scene_weight(count: Column, close: Column) -> Column:
    # Weight by target count, and the factor of close scenes.
    base = F.get(F.array(*[F.lit(w) for w in (0.75, 1.0, 1.45, 1.75)]), count.cast("int"))
    return base * F.when(close, 1.75).otherwise(1.0)


def hard_negatives(windows: DataFrame, scores: Column, level: float = 0.20) -> DataFrame:
    return windows.filter(~F.col("positive") & (F.array_max(scores) >= level))


def class_weights(labels: DataFrame, low: float = 1.0, high: float = 8.0) -> DataFrame:
    """Rarer classes weigh more: largest positive count over the class's, held in [low, high]."""
    counts = labels.groupBy("class").agg(F.count_if(F.col("label") >= 0.5).alias("positives"))
    most = counts.agg(F.max("positives").alias("_most"))
    weight = F.greatest(F.lit(low), F.least(F.lit(high), F.col("_most") / F.greatest(F.col("positives"), F.lit(1))))
    return counts.crossJoin(F.broadcast(most)).select("class", "positives", weight.alias("weight"))


def count_histogram(scenes: DataFrame, count: str, close: Column, largest: int = params.MAX_SOURCES) -> DataFrame:
    """Scenes per target count, zeros kept, and how many of them are close."""
    domain = scenes.sparkSession.range(largest + 1).select(F.col("id").cast("int").alias(count))
    sums = scenes.groupBy(F.col(count).cast("int").alias(count)).agg(F.count(F.lit(1)).alias("scenes"), F.count_if(close).alias("close"))
    return domain.join(sums, count, "left").fillna(0, ["scenes", "close"])


def cache_summary(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.count_if("positive").alias("positive"),
                       F.count_if(~F.col("positive")).alias("negative"), F.count_if(F.col("domain") == "real").alias("real"),
                       F.count_if(F.col("domain") == "synthetic").alias("synthetic"))


def training_windows(labels: DataFrame, lengths: DataFrame, stride: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Window index: every ``stride``-th end, the last one, and the end after each labelled frame, with its
    class labels.  ``labels`` (session, class, frame_idx, label) holds only frames with a label;
    ``lengths`` has ``frame_count`` and ``domain``."""
    grid = lengths.select(*keys, "domain", "frame_count", F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.col("frame_count")).cast("bigint"), F.lit(stride).cast("bigint"))).alias("window_end"))
    last = lengths.select(*keys, "domain", "frame_count", F.col("frame_count").cast("bigint").alias("window_end"))
    marked = labels.filter("label > 0").select(*keys, (F.col("frame_idx") + 1).alias("window_end")).distinct().join(
        lengths.select(*keys, "domain", "frame_count"), list(keys))
    ends = (grid.unionByName(last).unionByName(marked.select(grid.columns))
            .filter("window_end > 0 and window_end <= frame_count").distinct())
    strongest = labels.groupBy(*keys, (F.col("frame_idx") + 1).alias("window_end")).agg(F.max("label").alias("label"))
    return (ends.join(strongest, [*keys, "window_end"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
            .withColumn("positive", F.col("label") >= 0.5).drop("frame_count"))


def focal_onset_loss(rows: DataFrame, weights: dict[str, float], gamma: float = 2.0, source_share: float = 0.35) -> DataFrame:
    """Mean focal cross-entropy of stored onset scores plus the source cross-entropy of labelled rows.

    Rows: class, label, probability, source_index (NULL = ignore), source_probs.
    """
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), F.col("probability")))
    y, weight = F.col("label"), F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("class") == name, F.lit(float(value))).otherwise(weight)
    cross = -(weight * y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))
    right = y * p + (1.0 - y) * (1.0 - p)
    known = (y >= 0.5) & F.col("source_index").isNotNull()
    source = F.when(known, -F.ln(F.greatest(F.lit(1e-12), F.get(F.col("source_probs"), F.col("source_index")))))
    return rows.agg(F.avg(F.pow(1.0 - right, F.lit(gamma)) * cross).alias("onset_loss"),
                    F.coalesce(F.avg(source), F.lit(0.0)).alias("source_loss")).withColumn(
        "loss", F.col("onset_loss") + source_share * F.col("source_loss"))
