"""Names of all operators' queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus, files, preference, retrieval, sessions, text, training
from .plans.common import view

Query = Callable[[SparkSession, str], DataFrame]


def modules() -> list:
    """The modules of ``marlstone.plans``, each with QUERIES and ORACLE."""
    return [files, text, corpus, retrieval, sessions, preference, training]


def queries() -> dict[str, Query]:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in modules() for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten of the benchmark passages, each hit marked if it holds the passage."""
    return retrieval.flagship(*[view(spark, sf_dir, t) for t in ("queries_v", "documents", "qrels_v")])
