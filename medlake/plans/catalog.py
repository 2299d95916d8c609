"""Registry of runnable queries: name -> callable(spark, sf_dir) -> DataFrame.

Names start with the operator key of the inventory they exercise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medlake.plans import risk

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


register("X0_risk_category_counts")(risk.risk_category_counts)


def _load_all() -> None:
    """Import the query modules so their ``@register`` calls run."""
    from medlake.plans import q_audit, q_care, q_clinical, q_core, q_ml, q_monitor, q_stream  # noqa: F401


_load_all()
