"""Column expressions: units, text parsing and signal formulas.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundlake import params


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


# --- frequency and level ---------------------------------------------------------------------------

def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def power_db(energy: Column) -> Column:
    return clamp(10.0 * F.log10(F.greatest(energy, F.lit(1e-10))), -100.0, 0.0)


def energy_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def amplitude_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def pcen(energy: Column, smooth: Column, alpha: float = params.PCEN_ALPHA, delta: float = params.PCEN_DELTA,
         root: float = params.PCEN_ROOT, epsilon: float = params.PCEN_EPSILON) -> Column:
    return F.pow(energy / F.pow(epsilon + smooth, F.lit(alpha)) + delta, F.lit(root)) - delta ** root


def level_difference(left: Column, right: Column) -> Column:
    return clamp(10.0 * F.log10((left + 1e-10) / (right + 1e-10)) / 30.0, -1.0, 1.0)


def coherence(cross: Column, left: Column, right: Column) -> Column:
    """One part (real or imaginary) of the band coherence."""
    return clamp(cross / (F.sqrt(left * right) + 1e-10), -1.0, 1.0)


def bin_to_hz(index: Column, rate: int = params.SAMPLE_RATE, fft: int = params.FFT_SIZE) -> Column:
    return index * float(rate) / fft


def hann(index: Column, size: int) -> Column:
    import math
    return 0.5 * (1.0 - F.cos(index * (2.0 * math.pi / (size - 1))))


def dbfs(level: Column, floor: float = -120.0) -> Column:
    return F.when(level > 0, F.greatest(20.0 * F.log10(level), F.lit(floor))).otherwise(F.lit(floor))


# --- time ------------------------------------------------------------------------------------------

def samples_to_ms(samples: Column, rate: int = params.SAMPLE_RATE) -> Column:
    return samples * 1000.0 / rate


def ms_to_samples(ms: Column, rate: int = params.SAMPLE_RATE) -> Column:
    return F.floor(ms * rate / 1000).cast("bigint")


def samples_to_whole_ms(samples: Column, rate: int = params.SAMPLE_RATE) -> Column:
    return F.floor((samples * 1000 + rate // 2) / rate).cast("bigint")


def rescale_position(position: Column, from_rate: Column | int, to_rate: int = params.SAMPLE_RATE) -> Column:
    """Nearest position at the new rate; halves go to the even neighbour."""
    rate = from_rate if isinstance(from_rate, Column) else F.lit(from_rate)
    return F.rint(position * (F.lit(float(to_rate)) / rate)).cast("bigint")


def frame_end_sample(end: Column, hop: int = params.HOP_SIZE, fft: int = params.FFT_SIZE) -> Column:
    return (end - 1) * hop + fft


def delivery_ms(newest: Column, anchor: Column, rate: int = params.SAMPLE_RATE) -> Column:
    return F.greatest(F.lit(0), newest - anchor) * 1000.0 / rate


# --- text ------------------------------------------------------------------------------------------

# Accepted spellings and identifier format.
TRUE_WORDS = ("1", "true", "yes", "y")
SESSION_ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"


def parse_bool(text: Column, fallback: bool = False) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(fallback)).otherwise(F.lower(text).isin(*TRUE_WORDS))


def session_id_ok(text: Column) -> Column:
    return F.coalesce(text.rlike(SESSION_ID_PATTERN), F.lit(False))


def strict_u32(text: Column) -> Column:
    """Whole unsigned decimal text within 32 bits, else NULL."""
    number = text.try_cast("bigint")
    return F.when(text.rlike("^[0-9]+$") & (number <= 4_294_967_295), number)


def strict_float(text: Column) -> Column:
    """Finite decimal text without anything around it, else NULL."""
    number = text.try_cast("double")
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain & (F.abs(number) < float("inf")), number)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def asset_id(digest: Column) -> Column:
    return F.concat(F.lit("asset_"), F.substring(digest, 1, 16))


def canonical_json(column: Column) -> Column:
    """Map as JSON with sorted keys, so that equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def cache_key(fields: dict[str, Column], length: int = 20) -> Column:
    parts = [c for name in sorted(fields) for c in (F.lit(name), fields[name].cast("string"))]
    return F.substring(F.sha2(F.to_json(F.create_map(*parts)), 256), 1, length)


def word_domain(value: Column, allowed: Sequence[str], fallback: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))
