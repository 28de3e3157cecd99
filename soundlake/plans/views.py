"""The given tables seen as recordings, score traces, labels and events; once for Spark, once as SQL.

Positions are whole minutes since 2024-01-01 (``BASE`` minutes after 1970).  ``k`` is the integer the event's JSON properties carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 28_401_120
TOL = 360            # match tolerance, minutes
SPACING = 1440       # minimum spacing of kept peaks, minutes
JOIN = 720           # scene join span, minutes
WIDTH = 14 * 1440    # slice width, minutes
TARGETS = ("click", "purchase", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("class"),
        # the column has no zone: take its wall clock, whatever the session's zone is
        F.expr("unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone())) div 60000000 "
               f"- {BASE}").alias("sample"),
        "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def trace(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        "session_id", "class", "sample", "event_id", "value",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
        (k / 100.0).alias("activity"),
        F.array(k / 100.0, (100 - k) * 0.007, (100 - k) * 0.003).alias("source_probs"))


def labelled(spark, sf_dir) -> DataFrame:
    """Every event, as a reviewed label (k < 50) or as a detection (k >= 50)."""
    k, value = F.col("k"), F.col("value")
    return events(spark, sf_dir).select(
        "session_id", "class", "event_id", "k", "value",
        F.when(k < 50, "truth").otherwise("pred").alias("role"),
        F.col("sample").alias("onset_sample"), (F.col("sample") + 60).alias("end_sample"),
        (F.col("sample") + F.when(k % 3 == 0, 5).otherwise(20)).alias("detected_sample"),
        F.when(k < 15, "self").when(k < 40, "remote").when(k < 50, "unknown")
         .when(k < 65, "self").otherwise("remote").alias("source_hint"),
        F.least(value / 100.0, F.lit(1.0)).alias("confidence"),
        F.when(value > 60, F.lit(None)).when(value > 20, "quiet").otherwise("busy").alias("scene_mode"),
        (value >= 1).alias("reviewed"), (value < 3).alias("uncertain"), (k >= 90).alias("suppressed"))


def sessions(spark, sf_dir) -> DataFrame:
    """One row per user: the recording its events lie in."""
    return events(spark, sf_dir).groupBy("session_id").agg((F.max("sample") + 100).alias("length")).select(
        "session_id", "length", (F.col("length") * 60.0).alias("duration_seconds"))


CTE = {
    "ev": f"""ev AS (SELECT user_id AS session_id, event_type AS class,
  epoch_us(ts) // 60000000 - {BASE} AS sample, event_id,
  value, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""",
    "trace": """trace AS (SELECT session_id, class, sample, event_id, value,
  least(value / CAST(100 AS DOUBLE), 1.0) AS probability, k / CAST(100 AS DOUBLE) AS activity,
  [k / CAST(100 AS DOUBLE), (100 - k) * CAST(0.007 AS DOUBLE), (100 - k) * CAST(0.003 AS DOUBLE)] AS source_probs
  FROM ev)""",
    "labelled": """labelled AS (SELECT session_id, class, event_id, k, value,
  CASE WHEN k < 50 THEN 'truth' ELSE 'pred' END AS role, sample AS onset_sample, sample + 60 AS end_sample,
  sample + CASE WHEN k % 3 = 0 THEN 5 ELSE 20 END AS detected_sample,
  CASE WHEN k < 15 THEN 'self' WHEN k < 40 THEN 'remote' WHEN k < 50 THEN 'unknown'
       WHEN k < 65 THEN 'self' ELSE 'remote' END AS source_hint,
  least(value / CAST(100 AS DOUBLE), 1.0) AS confidence,
  CASE WHEN value > 60 THEN NULL WHEN value > 20 THEN 'quiet' ELSE 'busy' END AS scene_mode,
  value >= 1 AS reviewed, value < 3 AS uncertain, k >= 90 AS suppressed FROM ev)""",
    "sessions": """sessions AS (SELECT session_id, max(sample) + 100 AS length,
  (max(sample) + 100) * CAST(60 AS DOUBLE) AS duration_seconds FROM ev GROUP BY session_id)""",
    "truth": "truth AS (SELECT * FROM labelled WHERE role = 'truth')",
    "pred": "pred AS (SELECT * FROM labelled WHERE role = 'pred')",
}


def sql(body: str, *ctes: str, extra: str = "") -> str:
    """The shared views named in ``ctes`` (in order), then ``extra`` CTEs, then the query."""
    parts = [CTE[c] for c in ctes]
    if extra:
        parts.append(extra.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()
