"""All registered queries and their SQL forms, collected from the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ("sources", "imports", "order_metrics", "d2c", "facts", "leads", "model", "calendar", "projection", "diagnosis",
         "actions", "outreach", "followup", "grounding", "streams")
#: Run after all others: the whole training, two of them with 200 rounds of trees.
SLOW = ("h15_shipped_scores", "h12_challengers", "h15_model_report")


def _modules(package: str):
    for area in AREAS:
        try:
            yield importlib.import_module(f"bizlens.{package}.{area}")
        except ModuleNotFoundError as e:
            if e.name != f"bizlens.{package}.{area}":
                raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _modules("plans.queries"):
        out.update(m.QUERIES)
    for name in SLOW:
        out[name] = out.pop(name)
    return out


def oracles() -> dict[str, str]:
    known = queries()
    out: dict = {}
    for m in _modules("oracles"):
        out.update(m.oracles() if callable(getattr(m, "oracles", None)) else m.ORACLES)
    return {k: v for k, v in out.items() if k in known}
