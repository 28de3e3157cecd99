"""Default parameters.  Every operator takes overrides; nothing reads these implicitly at run time.

Fixed values: they must agree with the signal contract the features and scenes are defined by.
"""

from __future__ import annotations

SAMPLE_RATE = 48_000
FFT_SIZE = 1024
HOP_SIZE = 240
MEL_BINS = 64
CONTEXT_FRAMES = 128
INFERENCE_STRIDE_FRAMES = 2
MEL_MIN_HZ = 50.0
MEL_MAX_HZ = 18_000.0

CLASS_NAMES = ("gunshot", "footstep")
SOURCE_NAMES = ("self", "remote", "unknown")

PCEN_SMOOTHING = 0.025
PCEN_ALPHA = 0.98
PCEN_DELTA = 2.0
PCEN_ROOT = 0.5
PCEN_EPSILON = 1e-6
ACTIVITY_FRAMES = 100

ONSET_WEIGHTS = (1.0, 0.6, 0.2)
MATCH_TOLERANCE = SAMPLE_RATE // 10
BACKGROUND_GUARD = SAMPLE_RATE // 4
RAPID_MIN_MS, RAPID_MAX_MS = 60, 250

SCENE_FRAMES = 48
SCENE_SAMPLES = FFT_SIZE + (SCENE_FRAMES - 1) * HOP_SIZE
SCENE_PRE_ANCHOR = SAMPLE_RATE * 40 // 1000
SCENE_JOIN = SAMPLE_RATE * 120 // 1000
MIN_SEPARATION_DEGREES = 15.0
CLOSE_MAX_DEGREES = 30.0
DUPLICATE_MERGE_DEGREES = 7.5
ELEVATION_BOUNDS = (-60.0, 60.0)
MAX_SOURCES = 3
TRACKS = 3

SPLIT_LIMITS = (0.70, 0.85)
SPLIT_SEED = 20260720
COUNT_PROPORTIONS = (0.10, 0.15, 0.35, 0.40)
WILSON_Z = 1.959963984540054
