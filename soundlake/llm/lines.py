"""Exact line dedup in DataFrame operations only: repeated lines stay in the smallest document that holds them.

Lines become 128-bit hashes.  The hashes are range-partitioned and sorted by document and position, and the first
occurrence is read off the head of each run.  A run is cut into slices by document, so that a line that stands in a
third of all documents is many small runs; one representative document per slice then goes through the same step
again.  Texts never travel with the hashes: the result is one run-length coded keep bitmap per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import ascii_lower, cut, partitions, row_key, text_of

BLANK = " \t\n\x0b\f\r"
BITMAP = "array<struct<start:int,length:int>>"


def _hashed_lines(docs: DataFrame, min_chars: int, slices: int) -> DataFrame:
    text = text_of()
    r1, r2 = row_key("doc_id", text)
    lines = docs.select("doc_id", r1.alias("r1"), r2.alias("r2"), F.split(text, "\n", -1).alias("lines"))
    rows = lines.select("doc_id", "r1", "r2", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    rows = rows.select("doc_id", "r1", "r2", "n_lines", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    rows = rows.withColumn("key", ascii_lower(F.col("key")))
    return rows.select("doc_id", "r1", "r2", "n_lines", "pos", F.xxhash64("key").alias("h1"),
                       F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"))


def _first_holder(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``first``: the smallest document of each run of equal keys (null ids last)."""
    run = (Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "pos")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.repartitionByRange(n, *keys).withColumn("first", F.first("doc_id").over(run))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, r1, r2 (the row's key), n_lines, n_dropped, keep: runs of kept line positions.  Rows that lose nothing are absent.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of under ``min_chars`` code points stay.
    Rows with the same doc_id are one document; null ids are one document, the largest.  Null texts are empty.
    """
    n = partitions(docs.sparkSession)
    seen = cut(_first_holder(_hashed_lines(docs, min_chars, max(64, n)), ["h1", "h2", "slice"], n))
    later = ~F.col("doc_id").eqNullSafe(F.col("first"))
    heads = _first_holder(seen.where(~later).drop("first", "slice"), ["h1", "h2"], n)
    place = ["doc_id", "r1", "r2", "n_lines", "pos"]
    dropped = seen.where(later).select(*place).unionByName(heads.where(later).select(*place))
    per_doc = dropped.groupBy("doc_id", "r1", "r2").agg(F.max("n_lines").alias("n_lines"),
                                                        F.array_sort(F.collect_set("pos")).alias("gone"))
    edges = F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines"))
    between = F.zip_with(F.slice(edges, 1, F.size("gone") + 1), F.slice(edges, 2, F.size("gone") + 1),
                         lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return per_doc.select("doc_id", "r1", "r2", "n_lines", F.size("gone").alias("n_dropped"),
                          F.filter(between, lambda run: run["length"] > 0).cast(BITMAP).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped."""
    r1, r2 = row_key("doc_id", text_of())
    found = bitmaps.select("r1", "r2", "keep", "n_dropped")
    # the key's names must not meet columns of the input
    keyed = docs.select(F.struct("*").alias("doc"), r1.alias("r1"), r2.alias("r2"))
    joined = keyed.join(found, ["r1", "r2"], "left").withColumn("text", F.coalesce(F.col("doc.text").cast("string"), F.lit("")))
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(
        "keep", lambda run: F.slice(lines, run["start"] + 1, run["length"]))), "\n"))
    extra = {"kept_text": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long")}
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in extra]
    return joined.select(*own, *(v.alias(k) for k, v in extra.items()))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with kept_text, n_lines, n_dropped; see ``keep_bitmaps`` for the rule."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
