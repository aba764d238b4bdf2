"""Queries of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.bindings import view, with_views
from factlens.operators import facts as f
from factlens.operators import quality as q
from factlens.operators import sections as s
from factlens.operators.stores import differing_rows
from factlens.plans import evidence, rules, sql, texts
from factlens.plans.common import facts, filings, latest, metrics, metrics_once, once, rounded, values
from factlens.sources import feeds
from factlens.storage import materialize


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "wide-facts", lambda: f.wide_periods(facts(spark, sf_dir), filings(spark, sf_dir)))


def gross_profit_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.gross_profit_differences(wide(spark, sf_dir)).withColumns({c: rounded(c) for c in ("tagged", "derived")})


def debt_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 4 with a register of known exceptions (here the first company)."""
    found = q.debt_differences(f.resolve(latest(spark, sf_dir)))
    register = spark.createDataFrame([("0000000001", "tag counts notes at face value")], "cik string, reason string")
    return q.with_register(found, register, ["cik"]).select("cik", "period_end", rounded("combined").alias("combined"), rounded("parts").alias("parts"), "hard")


def period_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 5, with the inputs of two metrics one too high; without that there are none."""
    off = F.col("name").isin("net_margin", "revenue_yoy")
    rows = metrics_once(spark, sf_dir).withColumn("inputs", F.when(off, F.transform_values("inputs", lambda k, v: v + 1)).otherwise(F.col("inputs")))
    return q.mixed_periods(rows, latest(spark, sf_dir)).select("cik", "cls", "name", "period_end", "key")


def unverified_yoy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.unverified_drift(metrics(spark, sf_dir), latest(spark, sf_dir)).select("cik", "name", "period_end", "tag_now", "tag_before")


def unresolved_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.unresolved_concepts(latest(spark, sf_dir))


def lease_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.assumed_leases(f.resolve(latest(spark, sf_dir)))


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 15: observations computed again, where the stored statements of one rule were changed; without that there is no difference."""
    again = materialize(rules.r.metric_observations(values(spark, sf_dir), filings(spark, sf_dir), tasks=rules.tasks(spark, sf_dir)), "again")
    keys = ["cik", "rule_name", "subject", "period_end", "accession_no"]
    stored = rules.observations(spark, sf_dir).filter("accession_no is not null")
    stored = stored.withColumn("statement", F.when(F.col("rule_name") == "metric_sigma_move", F.lower("rule_name")).otherwise(F.col("statement")))
    found = differing_rows(stored, again.filter("accession_no is not null"), [*keys, "statement"], ["cik"])
    return found.filter("stored > fresh").select("cik", "rule_name", "subject")


def observation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 16, against metrics of which one is gone; without that there are none."""
    return q.orphan_references(rules.observations(spark, sf_dir), values(spark, sf_dir).filter("name <> 'roe'")).select("cik", "rule_name", "subject")


def section_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 16 for sections: references of changes in length, against sections of which some are gone; without that there are none."""
    rows = texts.rows(spark, sf_dir)
    found = q.orphan_references(s.length_change(rows), sections=rows.filter("doc_id % 7 <> 0"))
    return found.select("cik", "subject", F.col("ref.id").alias("ref"))


def observation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of standard deviations and of metrics that stopped, as JSON."""
    rows = rules.observations(spark, sf_dir).filter("rule_name in ('metric_sigma_move', 'metric_stopped_computing')")
    return rows.select("cik", "rule_name", "subject", F.col("period_end").cast("string").alias("period_end"), rules.r.refs_json(F.col("refs")).alias("refs"))


def orphan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 21 against the sections of documents that aren't toxic."""
    sections = view(spark, sf_dir, "findings").filter("severity <> 'high'").select("section_id")
    return q.orphan_findings(view(spark, sf_dir, "findings"), sections).select("finding_id")


def budget_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 20."""
    spent = view(spark, sf_dir, "ledger").agg(F.sum("cost_usd").alias("spent"))
    return spent.select(rounded("spent", 4).alias("spent"), rounded(F.lit(8.5) - F.col("spent"), 4).alias("remaining"), (F.col("spent") > 8.5).alias("over"))


def empty_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 31, with briefs cut small so that some are empty."""
    v = evidence.verified(spark, sf_dir).withColumn("brief_id", F.concat_ws("-", "brief_id", (F.col("position") % 100).cast("string")))
    briefs = v.groupBy("brief_id").agg(F.count("*").alias("sentences"))
    return q.empty_briefs(briefs, v.filter("drop_reason is null"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and archived files of orders taken as filings, with normalised types."""
    feed = view(spark, sf_dir, "feed").filter("primary_doc <> ''")
    declared = feed.select("accession_no", F.col("primary_doc").alias("filename"))
    archived = feed.filter("form_type = '8-K'").select("accession_no", F.explode(F.array("primary_doc", F.lit("FilingSummary.xml"))).alias("filename"))
    types = feed.select("accession_no", F.col("primary_doc").alias("filename"), F.when(F.col("form_type") == "8-K", " ex-99..1 ").otherwise(F.col("form_type")).alias("type"), F.lit("d").alias("description")).filter("type <> 'DEF 14A'")
    return feeds.build_manifest(declared, archived, types)


def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: an exhibit is there, isn't, or nothing is known of the filing's documents."""
    feed = view(spark, sf_dir, "feed")
    types = feed.filter("form_type <> 'DEF 14A'").select("accession_no", F.when(F.col("form_type") == "8-K", " ex-99..1 ").otherwise(F.col("form_type")).alias("type"))
    return feeds.has_exhibit(feed, types)


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a check: severity and number of violations."""
    found = latest(spark, sf_dir)
    return q.summary(
        {
            "gross_profit": ("hard", q.gross_profit_differences(wide(spark, sf_dir))),
            "debt": ("hard", q.debt_differences(f.resolve(found))),
            "alias_agreement": ("hard", f.tag_disagreements(found)),
            "concept_drift": ("info", f.concept_drift(found)),
            "unresolved_concepts": ("info", q.unresolved_concepts(found)),
        }
    )


QUERIES = {
    x.__name__: x
    for x in (gross_profit_crosscheck, debt_reconciliation, period_mixing, unverified_yoy_drift, unresolved_concepts, lease_assumptions, determinism, observation_orphans, section_orphans, observation_refs, orphan_findings, budget_headroom, empty_briefs, manifests, exhibits, quality_summary)
}

GROSS = "SELECT cik, period_start, period_end, gross_profit AS tagged, revenue - cogs AS derived FROM base WHERE cls <> 'other' AND abs(gross_profit - (revenue - cogs)) / CASE WHEN gross_profit <> 0 THEN abs(gross_profit) ELSE 1e-9 END > 0.01"
DEBT = """SELECT cik, period_end, total_debt AS combined, debt_noncurrent + debt_current AS parts FROM instants WHERE abs(total_debt - (debt_noncurrent + debt_current)) / CASE WHEN total_debt <> 0 THEN abs(total_debt) ELSE 1e-9 END > 0.01"""
ORACLE = {
    "gross_profit_crosscheck": f"{sql.SPINE} SELECT * REPLACE (round(tagged, 6) + 0.0 AS tagged, round(derived, 6) + 0.0 AS derived) FROM ({GROSS})",
    "debt_reconciliation": f"{sql.SPINE} SELECT cik, period_end, round(combined, 6) + 0.0 AS combined, round(parts, 6) + 0.0 AS parts, cik <> '0000000001' AS hard FROM ({DEBT})",
    "period_mixing": f"""{sql.PAIRED}, p AS (SELECT t.cik AS cik, t.cls AS cls, t.period_start AS period_start, t.period_end AS period_end, y.period_start AS ys, y.period_end AS ye FROM paired WHERE t.cls IN ('annual', 'quarterly')),
        tag AS (SELECT cik, canonical, period_start, period_end, concept, value FROM resolved WHERE period_start IS NOT NULL),
        m AS (SELECT p.cik, p.cls, p.period_end, a.concept AS a, b.concept AS b FROM p JOIN tag a ON a.canonical = 'net_income' AND (a.cik, a.period_start, a.period_end) = (p.cik, p.period_start, p.period_end)
            JOIN tag b ON b.canonical = 'revenue' AND (b.cik, b.period_start, b.period_end) = (p.cik, p.period_start, p.period_end) WHERE b.value <> 0),
        r AS (SELECT p.cik, p.cls, p.period_end, a.concept AS a, b.concept AS b FROM p JOIN tag a ON a.canonical = 'revenue' AND (a.cik, a.period_start, a.period_end) = (p.cik, p.period_start, p.period_end)
            JOIN tag b ON b.canonical = 'revenue' AND (b.cik, b.period_start, b.period_end) = (p.cik, p.ys, p.ye) WHERE b.value <> 0)
        SELECT cik, cls, 'net_margin' AS name, CAST(period_end AS VARCHAR) AS period_end, unnest([a, b]) AS key FROM m
        UNION ALL SELECT cik, cls, 'revenue_yoy', CAST(period_end AS VARCHAR), unnest([a || '_t', b || '_t-1']) FROM r""",
    "unresolved_concepts": f"{sql.LATEST} SELECT DISTINCT canonical FROM aliases WHERE canonical NOT IN (SELECT canonical FROM tagged)",
    "lease_assumptions": f"""{sql.SPINE}, i AS (SELECT *, COALESCE(total_debt, debt_noncurrent + debt_current) IS NOT NULL AS b FROM instants WHERE total_debt IS NOT NULL OR debt_noncurrent IS NOT NULL OR debt_current IS NOT NULL OR finance_lease_liability_noncurrent IS NOT NULL OR finance_lease_liability_current IS NOT NULL)
        SELECT cik, count(*) FILTER (b AND (finance_lease_liability_noncurrent IS NULL OR finance_lease_liability_current IS NULL)) AS assumed, count(*) FILTER (b) AS periods FROM i GROUP BY cik""",
    "determinism": f"{rules.M} SELECT cik, rule_name, subject FROM observed WHERE rule_name = 'metric_sigma_move' AND accession_no IS NOT NULL",
    "observation_orphans": f"{rules.M} SELECT cik, rule_name, subject FROM (SELECT cik, rule_name, subject, unnest(range(n_refs)) AS k FROM observed WHERE subject = 'roe')",
    "section_orphans": f"""{texts.S} SELECT company AS cik, short_name AS subject, unnest([section_id, prior_section_id]) AS ref FROM pairs WHERE words > 0 AND prior_words > 0 AND abs(words / prior_words - 1) > 0.25 AND doc_id % 7 = 0""",
    "observation_refs": f"""{rules.M}, before AS (SELECT a.cik, a.name, a.cls, a.period_end, b.period_end AS prior_end FROM mrows a JOIN mrows b ON b.cik = a.cik AND b.name = a.name AND b.cls = a.cls AND b.fiscal_year = a.fiscal_year - 1 AND b.fiscal_period = a.fiscal_period AND a.value IS NULL AND b.value IS NOT NULL)
        SELECT cik, rule_name, subject, CAST(period_end AS VARCHAR) AS period_end, '[{{"table":"metrics","id":"' || cik || '|' || subject || '|quarterly|' || period_end || '"}}]' AS refs FROM observed WHERE rule_name = 'metric_sigma_move'
        UNION ALL SELECT cik, 'metric_stopped_computing', name, CAST(period_end AS VARCHAR), '[{{"table":"metrics","id":"' || cik || '|' || name || '|' || cls || '|' || period_end || '"}},{{"table":"metrics","id":"' || cik || '|' || name || '|' || cls || '|' || prior_end || '"}}]' FROM before""",
    "empty_briefs": f"""{evidence.VERIFIED} SELECT brief_id || '-' || (position % 100) AS brief_id, 'all dropped' AS reason FROM verified GROUP BY 1 HAVING count(*) FILTER (drop_reason IS NULL) = 0""",
    "orphan_findings": f"{with_views('findings')} SELECT finding_id FROM findings WHERE severity = 'high'",
    "budget_headroom": f"{with_views('ledger')} SELECT round(CAST(sum(cost_usd) AS DOUBLE), 4) + 0.0 AS spent, round(CAST(8.5 - sum(cost_usd) AS DOUBLE), 4) + 0.0 AS remaining, sum(cost_usd) > 8.5 AS over FROM ledger",
    "manifests": f"""{with_views('feed')}, a AS (SELECT accession_no, primary_doc AS filename, CASE form_type WHEN '8-K' THEN 'EX-99.1' WHEN 'DEF 14A' THEN '' ELSE form_type END AS type, CASE form_type WHEN 'DEF 14A' THEN '' ELSE 'd' END AS description, form_type = '8-K' AS archived FROM feed WHERE primary_doc <> '')
        SELECT * FROM a UNION ALL SELECT accession_no, 'FilingSummary.xml', '', '', true FROM a WHERE archived""",
    "exhibits": f"{with_views('feed')} SELECT accession_no, CASE form_type WHEN '8-K' THEN true WHEN 'DEF 14A' THEN NULL ELSE false END AS has_exhibit FROM feed",
    "quality_summary": f"""{sql.SPINE}, d AS (SELECT *, lag(priority) OVER (PARTITION BY cik, canonical ORDER BY period_start NULLS FIRST, period_end) AS before FROM resolved)
        SELECT 'gross_profit' AS "check", 'hard' AS severity, count(*) AS n FROM ({GROSS}) UNION ALL SELECT 'debt', 'hard', count(*) FROM ({DEBT})
        UNION ALL SELECT 'alias_agreement', 'hard', count(*) FROM tagged a JOIN tagged b ON a.cik = b.cik AND a.canonical = b.canonical AND a.period_end = b.period_end AND a.period_start IS NOT DISTINCT FROM b.period_start AND a.priority < b.priority WHERE abs(a.value - b.value) / CASE WHEN a.value <> 0 THEN abs(a.value) ELSE 1e-9 END > 0.01
        UNION ALL SELECT 'concept_drift', 'info', count(*) FROM d WHERE before <> priority
        UNION ALL SELECT 'unresolved_concepts', 'info', count(DISTINCT canonical) FROM aliases WHERE canonical NOT IN (SELECT canonical FROM tagged)""",
}
DATED = {"gross_profit_crosscheck": "period_start period_end", "debt_reconciliation": "period_end"}
