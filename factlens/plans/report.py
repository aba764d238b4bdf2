"""The report over all checks that SQL can repeat: a row a check with its number, severity and how many rows it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.plans import briefs, checks, evidence, filings, ledgers, rules, runs
from factlens.storage import materialize

#: Check number and severity by query, and which of its rows count if not all do.
CHECKS = {
    "range_violations": ("01", "hard"),
    "dupont": ("02", "hard"),
    "gross_profit_crosscheck": ("03", "hard"),
    "debt_reconciliation": ("04", "hard"),
    "period_mixing": ("05", "hard"),
    "alias_disagreement": ("06", "hard"),
    "concept_drift": ("07", "info"),
    "metric_coverage": ("09", "info"),
    "unresolved_concepts": ("10", "info"),
    "lease_assumptions": ("11", "info"),
    "filing_contribution": ("12", "info"),
    "dead_rules": ("13", "warning"),
    "observation_lookahead": ("14", "hard"),
    "determinism": ("15", "hard"),
    "observation_orphans": ("16", "hard"),
    "stale_prices": ("18", "warning"),
    "ledger_reconciliation": ("19", "hard", "NOT ok"),
    "budget_headroom": ("20", "info"),
    "orphan_findings": ("21", "hard"),
    "quote_check": ("22", "hard", "NOT quote_ok"),
    "discard_by_version": ("23", "info"),
    "support_by_version": ("24", "info"),
    "cost_recomputation": ("25", "hard"),
    "price_reviews": ("26", "warning"),
    "orphan_refs": ("27", "hard"),
    "cross_filing_refs": ("28", "hard"),
    "sentence_types": ("29", "hard"),
    "brief_reverification": ("30", "hard"),
    "empty_briefs": ("31", "warning"),
    "brief_rates": ("32", "info"),
}
MODULES = (filings, rules, evidence, briefs, ledgers, checks, runs)
FOUND = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLE.items()}


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a check, and one for all hard failures.

    Checks are counted one after the other: in one plan the driver would hold the broadcasts of all of them at once.
    """
    out = None
    for name, (number, severity, *where) in CHECKS.items():
        rows = FOUND[name](spark, sf_dir)
        rows = rows.filter(where[0]) if where else rows
        row = rows.agg(F.count("*").alias("n")).select(F.lit(number).alias("number"), F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n")
        row = materialize(row, f"check-{number}")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.filter("severity = 'hard'").agg(F.lit("all").alias("number"), F.lit("hard failures").alias("check"), F.lit("hard").alias("severity"), F.sum("n").alias("n")))


QUERIES = {"quality_report": quality_report}
REPORT = " UNION ALL ".join(f"""SELECT '{number}' AS number, '{name}' AS "check", '{severity}' AS severity, count(*) AS n FROM ({SQL[name]}) AS t{number}{' WHERE ' + where[0] if where else ''}""" for name, (number, severity, *where) in CHECKS.items())
ORACLE = {"quality_report": f"""WITH report AS MATERIALIZED ({REPORT}) SELECT * FROM report UNION ALL SELECT 'all', 'hard failures', 'hard', CAST(sum(n) AS BIGINT) FROM report WHERE severity = 'hard'"""}
DATED: dict[str, str] = {}
