"""Ends of a live pipeline: event log, policies per micro-batch, published and suppressed events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Version of the event log and how many sources a line lists.
LOG_SCHEMA_VERSION = 2
LOG_SOURCES = 3


def log_lines(rows: DataFrame, class_bits: dict[str, int], mask: str = "enabled_class_mask", sources: str = "sources") -> DataFrame:
    """One JSON text per event with its scene's result; at most three sources."""
    enabled = F.struct(*[(F.getbit(F.col(mask), F.lit(bit)) == 1).alias(name) for name, bit in class_bits.items()])
    listed = F.slice(F.col(sources), 1, LOG_SOURCES)
    fields = [F.lit(LOG_SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in rows.columns if c not in (mask, sources)],
              enabled.alias("enabled_classes"), F.size(sources).alias("direction_source_count"), listed.alias("sources")]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def write_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append log lines; the file sink's commit log gives each batch exactly once."""
    return stream.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a Parquet table and stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def with_current_policy(stream: DataFrame, read_policy: Callable[[], DataFrame], on: Sequence[str],
                        handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Join every micro-batch with the policy table as it is at that moment.  The policy is one row per key
    of ``on``, or one row altogether; without ``on`` a second row is an error, and without any row the events stay with null policy columns."""
    def each(batch: DataFrame, number: int) -> None:
        policy = read_policy()
        if not on and len(policy.take(2)) > 1:
            raise ValueError("the policy table has more than one row")
        joined = batch.join(policy, list(on), "left") if on else batch.join(F.broadcast(policy), F.lit(True), "left")
        handle(joined, number)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(events: DataFrame) -> DataFrame:
    """Suppressed events are found and counted, but not delivered."""
    return events.filter(~F.col("suppressed"))


def counted(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.count_if("suppressed").alias("suppressed"))


def deal_by_time(rows: DataFrame, path: str, at: str, keys: Sequence[str], pieces: int = 6, salts: int | None = None) -> int:
    """Write ``rows`` so that ``replay`` gives each key's rows in order; returns the most files of one stretch of time.

    One job writes all: time is cut into ``pieces`` stretches, a stretch is dealt by key over ``salts`` tasks.  A file source takes
    the oldest files first, so the files' times are then set in the order of their stretches.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(at), F.max(at)).first()
    salts = salts or spark.sparkContext.defaultParallelism
    low, span = low or 0, max(1, (high or 0) - (low or 0) + 1)
    piece = F.floor((F.col(at) - low) * pieces / span).cast("int")
    dealt = rows.withColumn("_stretch", piece).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    dealt.repartition("_stretch", "_salt").sortWithinPartitions("_stretch", *keys, at).drop("_salt").write.partitionBy("_stretch").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted((f.getPath() for f in system.listStatus(root) if f.isDirectory()), key=lambda p: int(p.getName().removeprefix("_stretch=")))
    start, most = 1_600_000_000_000, 1
    for k, folder in enumerate(folders):
        files = [f.getPath() for f in system.listStatus(folder)]
        most = max(most, len(files))
        for n, file in enumerate(files):
            system.setTimes(file, start + 1000 * (100_000 * k + n), -1)
    return most


def replay(spark, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream, oldest first."""
    names = [f.name for f in schema]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).select(*names)
