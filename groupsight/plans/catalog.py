"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from groupsight.plans import q_clean, q_evaluate, q_features, q_models, q_sampling, q_sources, q_stats, q_streaming  # noqa: F401
from groupsight.plans.registry import ORACLES, QUERIES
from groupsight.session import ship_package


def _shipped(f: Callable) -> Callable:
    """f with the package made importable in Python workers."""

    def run(spark, sf_dir: str):
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    return {name: _shipped(f) for name, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
