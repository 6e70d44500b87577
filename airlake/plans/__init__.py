"""Registered queries, one module per area of the operator inventory."""

from importlib import import_module

AREAS = ("sources", "normalize", "quality", "joins", "aggregates", "windows", "scalars", "exposure", "alerts",
         "serving", "streams", "models", "flagship")


def load_all() -> None:
    for area in AREAS:
        import_module(f"airlake.plans.{area}")
