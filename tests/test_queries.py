"""Registered queries against their SQL on the smallest tables.  All of them with SOUNDLAKE_ALL=1."""

import os

import pytest

from check_sql import compare
from soundlake.plans import registry

SF = os.environ.get("SOUNDLAKE_SF", "/root/testdata/sf0.001")
CORE = ("peak_events match_events asof_scene_mode overlap_flags detection_metrics scene_groups assign_directions grouped_split "
        "corpus_audit validate_scenes onset_features calibrate_suppression balanced_order stream_peaks").split()
NAMES = list(registry.all_queries()) if os.environ.get("SOUNDLAKE_ALL") else CORE


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    note, _, ok = compare(spark, SF, name, registry.all_queries()[name], registry.all_sql().get(name))
    assert ok, note


def test_registry_names():
    queries, statements = registry.all_queries(), registry.all_sql()
    assert set(statements) <= set(queries) and len(queries) > 120
