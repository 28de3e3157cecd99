from importlib import import_module

MODULES = ("q_events", "q_matching", "q_direction", "q_corpus", "q_scenes", "q_calibration", "q_features", "q_sampling", "q_sources", "q_streaming")


def load_all() -> None:
    for name in MODULES:
        import_module(f"soundlake.plans.{name}")
