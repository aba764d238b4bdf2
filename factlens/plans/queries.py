"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from factlens.plans import briefs, checks, evidence, filings, ledgers, report, rules, runs, texts


def texted(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with dates as ISO text, so that engines show them alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.withColumns({f.name: out[f.name].cast("string") for f in out.schema if isinstance(f.dataType, T.DateType)})

    run.__doc__ = query.__doc__
    return run


def texted_sql(query: str, dates: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates.split())}) FROM ({query}) result" if dates else query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (filings, rules, texts, evidence, briefs, ledgers, runs, checks, report):
    QUERIES |= {name: texted(query) for name, query in _module.QUERIES.items()}
    ORACLE |= {name: texted_sql(query, _module.DATED.get(name, "")) for name, query in _module.ORACLE.items()}
