"""PCM recordings: distributed decode of WAV files to chunk rows, and the way back."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlake import params
from soundlake.functions.scalar import asset_id, content_hash
from soundlake.operators import corpus
from soundlake.operators.features import blocks_of, extract_windows, interpolate
from soundlake.session import cut_lineage
from soundlake.sources import wav

def decode_pcm(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and float [frames, channels] of 8- or 16-bit PCM with one or two channels."""
    head = wav.read_header(io.BytesIO(content), len(content))
    raw = content[head.data:head.data + head.frames * head.width * head.channels]
    return head.rate, wav.decode(raw, head.width, head.channels)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def scan_recordings(spark: SparkSession, path: str, chunk: int = wav.CHUNK, split_bytes: int = wav.SPLIT_BYTES) -> DataFrame:
    """WAV files of a directory as chunk rows; an undecodable file is one row with ``error``.

    Files that continue a recording are rows of that recording; a chunk that two files share is two rows.  A task reads about
    ``split_bytes``, whatever the size of the files.
    """
    spark.dataSource.register(wav.Recordings)
    return spark.read.format(wav.FORMAT).option("chunk", chunk).option("split_bytes", split_bytes).load(wav.resolved(spark, path))


def encode_sample(x: Column) -> Column:
    """Clip to +-1 and scale to 16 bits, negative by 32768 and positive by 32767, halves to even."""
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
    return F.rint(held * F.when(held < 0, 32768.0).otherwise(32767.0)).cast("smallint")


def write_recordings(chunks: DataFrame, path: str, rate: int = params.SAMPLE_RATE, part_frames: int = 1 << 28, packed: bool = False) -> DataFrame:
    """Stereo 16-bit WAV files under ``path``; returns (session_id, path, frames).

    A recording longer than ``part_frames`` continues in files ``<session>_part00001`` and so on, so no task
    meets more than that; a chunk in their header names the recording and position.  Samples are streamed.  Files appear
    under their names when all tasks are done; a file of the same name is replaced.

    ``packed``: WAV files of up to 1 MB become members of tar shards, which ``scan_recordings`` reads like files; the path of a member is
    the folder's.  A folder that holds anything is refused then, as members cannot be replaced.
    """
    spark = chunks.sparkSession
    if packed:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(at) and len(system.listStatus(at)):
            raise FileExistsError(f"{path} is not empty")
    spark.dataSource.register(wav.Recordings)
    pieces = blocks_of(chunks.select("session_id", "first_sample", "left", "right"), part_frames, 0)
    session = F.col("session_id").cast("string")
    name = F.when(F.col("block") == 0, session).otherwise(F.format_string("%s_part%05d", session, F.col("block")))
    pieces = pieces.select(name.alias("file"), "piece_start", F.when(F.col("block") > 0, session).alias("recording"), "left", "right")
    sized = cut_lineage(pieces.groupBy("file").agg(F.sum(F.size("left")).alias("frames"), F.min("piece_start").alias("position"), F.min("recording").alias("recording")))
    coded = pieces.select("file", "piece_start", F.transform("left", encode_sample).alias("left"), F.transform("right", encode_sample).alias("right")).join(sized, "file")
    ordered = coded.repartition("file").sortWithinPartitions("file", "piece_start").select("file", "position", "frames", "recording", "left", "right")
    ordered.write.format(wav.FORMAT).option("rate", rate).option("packed", packed).mode("append").save(wav.resolved(spark, path))
    base = path.rstrip("/")
    place = F.concat(F.lit(base + "/"), "file", F.lit(".wav"))
    if packed:
        place = F.when(4 * F.col("frames") <= wav.PACKED_BYTES, base).otherwise(place)
    return sized.select(F.col("file").alias("session_id"), place.alias("path"), "frames")


def onset_in_clip(rate: int, values: np.ndarray, before: float = 0.02) -> int:
    """Audible onset of a clip at the common rate, counted from where its silence is trimmed to."""
    if not len(values):
        if rate != params.SAMPLE_RATE:
            raise ValueError("an empty clip has no rate to change")
        return 0
    sides = values.astype(float).T
    if rate != params.SAMPLE_RATE:
        sides = [interpolate(x, rate, params.SAMPLE_RATE).astype(np.float32) for x in sides]
    level = np.abs(sides).max(axis=0)
    loud = np.flatnonzero(level >= max(0.005, 0.02 * float(level.max(initial=0))))
    return min(int(loud[0]), round(before * params.SAMPLE_RATE)) if len(loud) else 0


def scan_inventory_tree(spark: SparkSession, root: str) -> DataFrame:
    """All WAV files below ``root`` as assets: hash, class by path, onset; the first path of a content is canonical."""
    @F.pandas_udf("struct<frames:bigint,offset:bigint>")
    def probe(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                rate, values = decode_pcm(content)
                rows.append((len(values), onset_in_clip(rate, values)))
            except ValueError:
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["frames", "offset"])
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
             .filter(~stem_of(F.col("path")).startswith("._")))
    base = root.rstrip("/") + "/"
    rows = files.select(F.substring_index("path", base, -1).alias("relative_path"), content_hash(F.col("content")).alias("sha256"),
                        probe("content").alias("p")).withColumn("c", corpus.classify_path(F.col("relative_path")))
    valid = F.col("p.frames").isNotNull()
    assets = rows.select(
        asset_id(F.col("sha256")).alias("asset_id"), "relative_path", F.col("c.label").alias("label"), F.col("c.group").alias("source_group"),
        "sha256", valid.alias("included"), F.lit("").alias("split"), F.col("c.subtype").alias("subtype"),
        F.when(valid, F.col("c.review")).otherwise("invalid").alias("review_status"),
        F.coalesce("p.offset", F.lit(-1)).alias("active_offset_samples"))
    return corpus.content_duplicates(assets)


def export_clips(chunks: DataFrame, intervals: DataFrame, path: str, rate: int = params.SAMPLE_RATE) -> DataFrame:
    """One WAV per interval (window_id, window_start, window_frames) that lies inside its recording, packed in shards: clips are short and
    as many as the data has rows.  ``path`` must be empty."""
    clips = extract_windows(chunks, intervals).filter("left is not null").select(
        F.concat_ws("_", F.col("session_id").cast("string"), F.col("window_id").cast("string")).alias("session_id"),
        F.lit(0).cast("bigint").alias("first_sample"), "left", "right")
    return write_recordings(clips, path, rate, packed=True)
