"""Queries over the metric rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import rules as r
from factlens.operators.incremental import Kept
from factlens.plans import sql
from factlens.plans.common import facts, filings, once, rounded, values
from factlens.registry import METRICS, RULES
from factlens.storage import scratch_path, tasks_for


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.metric_rows(values(spark, sf_dir), filings(spark, sf_dir), tasks(spark, sf_dir))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that metric rows are dealt to."""
    return tasks_for(values(spark, sf_dir), r.ROWS_A_TASK)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "observations", lambda: r.metric_observations(values(spark, sf_dir), filings(spark, sf_dir), tasks=tasks(spark, sf_dir)))


def fired(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = r.METRIC_RULES[name](rows(spark, sf_dir))
        return found.select("cik", "accession_no", "period_end", "rule_name", "rule_version", "subject", "severity", F.size("refs").alias("n_refs"))

    return query


def rule_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.eligible_counts(rows(spark, sf_dir))


def dead_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 13: metric rules that never fired though they could, as if one's observations were lost."""
    could = r.eligible_counts(rows(spark, sf_dir)).groupBy("rule_name").agg(F.sum("eligible").alias("eligible"))
    fired_ = observations(spark, sf_dir).filter("rule_name <> 'metric_sigma_move'").select("rule_name").distinct()
    return could.join(fired_, "rule_name", "left_anti")


def severity_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric observations with those on tax rates and gross margins taken for boilerplate."""
    plain = spark.createDataFrame([("gross_margin",), ("roe",)], "subject string")
    found = r.override_severities(observations(spark, sf_dir), plain)
    return found.groupBy("rule_name", "subject", "severity").agg(F.count("*").alias("n"))


def observation_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 14, with references of one subject moved to later periods; without that there are none."""
    later = F.transform("refs", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), F.date_add(x["period_end"], 4000).alias("period_end")))
    rows_ = observations(spark, sf_dir).withColumn("refs", F.when(F.col("subject") == "roe", later).otherwise(F.col("refs")))
    return r.lookahead(rows_).select("cik", "rule_name", "subject")


def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("rule_name", "cik").agg(F.count("*").alias("n"))


def filing_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 12: mean and largest number of observations a filing, by rule."""
    per = observations(spark, sf_dir).filter(F.col("accession_no").isNotNull()).groupBy("rule_name", "accession_no").agg(F.count("*").alias("n"))
    return per.groupBy("rule_name").agg(rounded(F.avg("n")).alias("mean"), F.max("n").alias("most"), F.count("*").alias("filings"))


def dupont(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 2: margin times turnover times multiplier against return on equity, more than one percent apart; every second
    company's return is given five percent too high."""
    names = ["net_margin", "asset_turnover", "equity_multiplier", "roe"]
    wide = values(spark, sf_dir).filter(F.col("name").isin(names)).groupBy("cik", "period_start", "period_end").pivot("name", names).agg(F.first("value"))
    wide = wide.withColumn("roe", F.when(F.col("cik").cast("long") % 2 == 0, F.col("roe") * 1.05).otherwise(F.col("roe")))
    product = F.col("net_margin") * F.col("asset_turnover") * F.col("equity_multiplier")
    off = F.abs(product - F.col("roe")) / F.when(F.col("roe") != 0, F.abs("roe")).otherwise(1e-9)
    return wide.filter(off > 0.01).select("cik", "period_start", "period_end", rounded(product).alias("product"), rounded("roe").alias("roe"))


#: Periods of every tenth company from this day on are added to all others.
ADDED = "1998-06-30"


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and observations of standard deviations, kept up to date as the late periods of every tenth company are added."""

    def make() -> DataFrame:
        all_facts, reports = facts(spark, sf_dir), filings(spark, sf_dir)
        late = (F.col("cik").cast("long") % 10 == 3) & (F.col("period_end") >= F.lit(ADDED).cast("date"))
        kept = Kept(spark, scratch_path(spark, "kept"), all_facts.columns)
        kept.add(all_facts.filter(~late), reports)
        found = kept.add(all_facts.filter(late), reports).select(F.lit("sigma").alias("kind"), "cik", F.lit("quarterly").alias("cls"), F.lit(None).cast("date").alias("period_start"), "period_end", F.col("subject").alias("name"), F.lit(None).cast("double").alias("value"))
        return found.unionByName(kept.metrics.read().select(F.lit("metric").alias("kind"), "cik", "cls", "period_start", "period_end", "name", "value"))

    return once(spark, sf_dir, "grown", make)


def incremental_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics after facts were added: those of a full run."""
    return grown(spark, sf_dir).filter("kind = 'metric'").select("cik", "cls", "period_start", "period_end", "name", rounded("value").alias("value"))


def incremental_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that the added facts made, judged by the moments of the histories before."""
    return grown(spark, sf_dir).filter("kind = 'sigma'").select("cik", "name", "period_end")


NAMES = {
    "rule_extreme": "metric_multi_year_extreme",
    "rule_sigma": "metric_sigma_move",
    "rule_threshold": "metric_threshold_cross",
    "rule_divergence": "metric_divergence",
    "rule_stopped": "metric_stopped_computing",
}
QUERIES = {k: fired(v) for k, v in NAMES.items()} | {q.__name__: q for q in (rule_eligibility, dead_rules, severity_overrides, observation_lookahead, observation_counts, filing_contribution, dupont, incremental_metrics, incremental_sigma)}

M = f"""{sql.METRIC_ROWS},
registry AS (SELECT * FROM (VALUES {', '.join(f"('{m.name}', '{m.category}', {str(m.extreme).lower()}, {str(m.headline).lower()})" for m in METRICS)}) AS v(name, category, extreme, headline)),
mrows AS (SELECT m.*, g.category, g.extreme, g.headline, f.accession_no, f.fiscal_year, f.fiscal_period FROM metrics m JOIN registry g USING (name)
    LEFT JOIN filings f ON f.cik = m.cik AND f.period_end = m.period_end AND f.form_type = CASE m.cls WHEN 'annual' THEN '10-K' WHEN 'quarterly' THEN '10-Q' END),
labelled AS (SELECT a.*, b.value AS prior_value, b.cik IS NOT NULL AS has_prior FROM mrows a LEFT JOIN mrows b ON b.cik = a.cik AND b.name = a.name AND b.cls = a.cls AND b.fiscal_year = a.fiscal_year - 1 AND b.fiscal_period = a.fiscal_period),
lagged AS (SELECT *, lag(value) OVER w AS before FROM mrows WHERE value IS NOT NULL WINDOW w AS (PARTITION BY cik, name ORDER BY period_end, period_start)),
history AS (SELECT *, count(*) OVER e AS n, min(value) OVER e5 AS lo5, max(value) OVER e5 AS hi5, min(value) OVER e20 AS lo20, max(value) OVER e20 AS hi20, count(*) OVER e5 AS c5, count(*) OVER e20 AS c20,
        avg(value) OVER e AS mean, stddev_pop(value) OVER e AS sd FROM mrows WHERE value IS NOT NULL
    WINDOW e AS (PARTITION BY cik, name, cls ORDER BY period_end, period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           e5 AS (PARTITION BY cik, name, cls ORDER BY period_end, period_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), e20 AS (PARTITION BY cik, name, cls ORDER BY period_end, period_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
divergent AS (SELECT *, CASE name WHEN 'inventory_growth_less_revenue_growth' THEN value > 0.15 WHEN 'capex_to_depreciation' THEN value > 1.5 WHEN 'depreciation_rate' THEN value / nullif(prior_value, 0) - 1 < -0.15 END AS state
    FROM labelled WHERE value IS NOT NULL AND name IN ('inventory_growth_less_revenue_growth', 'capex_to_depreciation', 'depreciation_rate')),
diverged AS (SELECT *, lag(state) OVER (PARTITION BY cik, name ORDER BY period_end, period_start) AS was FROM divergent),
observed AS (
    SELECT cik, accession_no, period_end, 'metric_multi_year_extreme' AS rule_name, name AS subject, CASE WHEN category IN ('margins', 'returns', 'working_capital') THEN 'high' ELSE 'medium' END AS severity,
           1 + CASE cls WHEN 'annual' THEN c5 ELSE c20 END AS n_refs FROM history
    WHERE extreme AND headline AND CASE cls WHEN 'annual' THEN n >= 4 AND (value > hi5 OR value < lo5) ELSE n >= 8 AND (value > hi20 OR value < lo20) END
    UNION ALL SELECT cik, accession_no, period_end, 'metric_sigma_move', name, 'medium', 1 FROM history WHERE headline AND cls = 'quarterly' AND n >= 8 AND sd > 0 AND abs((value - mean) / sd) > 2
    UNION ALL SELECT cik, accession_no, period_end, 'metric_threshold_cross', name, 'high', 2 FROM lagged
    WHERE CASE name WHEN 'beneish_m_score' THEN value > -1.78 AND NOT before > -1.78 WHEN 'current_ratio' THEN value < 1 AND NOT before < 1 WHEN 'net_debt' THEN (value >= 0) <> (before >= 0)
        WHEN 'fcf_conversion' THEN value < 0.5 AND NOT before < 0.5 WHEN 'interest_coverage' THEN value < 3 AND NOT before < 3 ELSE false END
    UNION ALL SELECT cik, accession_no, period_end, 'metric_divergence', name, 'high', 2 FROM diverged WHERE state AND NOT was
    UNION ALL SELECT cik, accession_no, period_end, 'metric_stopped_computing', name, 'medium', 2 FROM labelled WHERE value IS NULL AND prior_value IS NOT NULL
)"""
ELIGIBLE = """
    SELECT cik, 'metric_multi_year_extreme' AS rule_name, count(*) FILTER (extreme AND headline AND n >= CASE cls WHEN 'annual' THEN 4 ELSE 8 END) AS eligible FROM history GROUP BY cik
    UNION ALL SELECT cik, 'metric_sigma_move', count(*) FILTER (headline AND cls = 'quarterly' AND n >= 8) FROM history GROUP BY cik
    UNION ALL SELECT cik, 'metric_threshold_cross', count(*) FILTER (name IN ('beneish_m_score', 'current_ratio', 'net_debt', 'fcf_conversion', 'interest_coverage') AND k > 1) FROM (SELECT *, row_number() OVER (PARTITION BY cik, name ORDER BY period_end, period_start) AS k FROM mrows WHERE value IS NOT NULL) GROUP BY cik
    UNION ALL SELECT cik, 'metric_divergence', count(*) FILTER (name IN ('inventory_growth_less_revenue_growth', 'capex_to_depreciation', 'depreciation_rate') AND k > 1) FROM (SELECT *, row_number() OVER (PARTITION BY cik, name ORDER BY period_end, period_start) AS k FROM mrows WHERE value IS NOT NULL) GROUP BY cik
    UNION ALL SELECT cik, 'metric_stopped_computing', count(*) FILTER (prior_value IS NOT NULL) FROM labelled GROUP BY cik"""
VERSIONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, (v, _) in RULES.items())
ORACLE = {
    "incremental_metrics": f"{sql.METRIC_ROWS} SELECT cik, cls, period_start, period_end, name, round(value, 6) + 0.0 AS value FROM metrics",
    "incremental_sigma": f"{M} SELECT cik, subject AS name, period_end FROM observed WHERE rule_name = 'metric_sigma_move' AND CAST(cik AS BIGINT) % 10 = 3 AND period_end >= DATE '{ADDED}'",
} | {k: f"{M} SELECT cik, accession_no, period_end, rule_name, CASE rule_name {VERSIONS} END AS rule_version, subject, severity, n_refs FROM observed WHERE rule_name = '{v}'" for k, v in NAMES.items()} | {
    "rule_eligibility": f"{M} {ELIGIBLE}",
    "dead_rules": f"{M}, e AS ({ELIGIBLE}) SELECT rule_name, sum(eligible) AS eligible FROM e WHERE rule_name NOT IN (SELECT rule_name FROM observed WHERE rule_name <> 'metric_sigma_move') GROUP BY 1",
    "severity_overrides": f"{M} SELECT rule_name, subject, CASE WHEN subject IN ('gross_margin', 'roe') THEN 'low' ELSE severity END AS severity, count(*) AS n FROM observed GROUP BY ALL",
    "observation_lookahead": f"{M} SELECT cik, rule_name, subject FROM observed WHERE subject = 'roe'",
    "observation_counts": f"{M} SELECT rule_name, cik, count(*) AS n FROM observed GROUP BY ALL",
    "filing_contribution": f"{M} SELECT rule_name, round(avg(n), 6) + 0.0 AS mean, max(n) AS most, count(*) AS filings FROM (SELECT rule_name, accession_no, count(*) AS n FROM observed WHERE accession_no IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "dupont": f"""{sql.METRIC_ROWS}, w AS (SELECT cik, period_start, period_end, max(value) FILTER (name = 'net_margin') AS a, max(value) FILTER (name = 'asset_turnover') AS b, max(value) FILTER (name = 'equity_multiplier') AS c, max(CASE WHEN CAST(cik AS BIGINT) % 2 = 0 THEN value * 1.05 ELSE value END) FILTER (name = 'roe') AS r FROM metrics GROUP BY ALL)
        SELECT cik, period_start, period_end, round(a * b * c, 6) + 0.0 AS product, round(r, 6) + 0.0 AS roe FROM w WHERE abs(a * b * c - r) / CASE WHEN r <> 0 THEN abs(r) ELSE 1e-9 END > 0.01""",
}
DATED = dict.fromkeys(NAMES, "period_end") | {"incremental_metrics": "period_start period_end", "incremental_sigma": "period_end"} | {"dupont": "period_start period_end"}
