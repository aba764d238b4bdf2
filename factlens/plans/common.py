"""Tables that several queries of one session share: computed once per folder of tables, in the shared folder.

They are computed again when a table of the folder was written since, and after ``forget``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.bindings import view
from factlens.operators.facts import latest_filed
from factlens.operators.metrics import compute_metrics
from factlens.operators.rules import LABELS
from factlens.storage import materialize, modified, tasks_for

#: Facts that a task is dealt where their tags are looked at one by one, in sorts and hash tables.
LATEST_A_TASK = 150_000

_KEPT: dict[tuple[str, str, int, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, modified(spark, sf_dir), name)
    if key not in _KEPT:
        _KEPT[key] = materialize(make(), name)
    return _KEPT[key]


def forget() -> None:
    """Let every query compute from the given tables again."""
    _KEPT.clear()


def flow(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sales by company and quarter, which facts and filings are made of."""
    return {"sales": once(spark, sf_dir, "sales", lambda: view(spark, sf_dir, "sales"))}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "facts", lambda: view(spark, sf_dir, "facts", flow(spark, sf_dir)))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "filings", lambda: view(spark, sf_dir, "filings", flow(spark, sf_dir)))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values filed last, dealt out by company: what looks at a company's facts finds them in one place, and no task grows."""
    found = facts(spark, sf_dir)
    return latest_filed(found.repartition(tasks_for(found, LATEST_A_TASK), "cik"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics with a number each, in order of company, period and name."""
    return once(spark, sf_dir, "metrics", lambda: compute_metrics(facts(spark, sf_dir), filings(spark, sf_dir)))


def metrics_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metrics`` for a query that goes through them once: read where the session has them, else computed on the way and not written.

    Formulas and inputs of all metrics take more disk than the facts that they come from.
    """
    key = (spark.sparkContext.applicationId, sf_dir, modified(spark, sf_dir), "metrics")
    return _KEPT[key] if key in _KEPT else compute_metrics(facts(spark, sf_dir), filings(spark, sf_dir))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all metrics with the filings of their periods, without formulas and inputs: rules need no more."""
    return once(spark, sf_dir, "values", lambda: compute_metrics(facts(spark, sf_dir), filings(spark, sf_dir), provenance=False, labels=LABELS))


def metrics_of(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Values of the metrics named, computed alone unless those of all are there."""
    key = (spark.sparkContext.applicationId, sf_dir, modified(spark, sf_dir), "values")
    if key in _KEPT:
        return _KEPT[key].filter(F.col("name").isin(names))
    return compute_metrics(facts(spark, sf_dir), filings(spark, sf_dir), names=names, provenance=False)


def rounded(value, digits: int = 6):
    return F.round(value, digits) + 0.0
