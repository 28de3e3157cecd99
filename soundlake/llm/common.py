"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlake.session import cut_lineage

WORDS = rb"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
cut = cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(doc_id: str, text: Column) -> tuple[Column, Column]:
    """128 bits that identify a row by its id and text; rows equal in both share the key, and null ids are allowed."""
    return F.xxhash64(F.col(doc_id), text), F.xxhash64(F.lit(7), text, F.col(doc_id))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; strings of one-byte characters take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_list(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow column as bytes, nulls as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): well spread bits for any integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
