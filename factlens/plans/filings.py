"""Queries over filings, facts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.bindings import view, with_views
from factlens.operators import facts as f
from factlens.operators.metrics import inputs_json
from factlens.operators.periods import nearest_prior
from factlens.plans import sql
from factlens.plans.common import facts, filings, latest, metrics, metrics_of, rounded, values
from factlens.registry import METRICS, metric_table
from factlens.sources import feeds

CATEGORIES = {
    "metrics_growth": "growth",
    "metrics_margins": "margins",
    "metrics_returns": "returns",
    "metrics_capital_cash": "capital_cash",
    "metrics_working_capital": "working_capital",
    "metrics_solvency": "solvency",
    "metrics_beneish": "quality",
}


def category(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [m.name for m in METRICS if m.category == name]
        return metrics_of(spark, sf_dir, names).select("cik", "cls", "period_start", "period_end", "name", rounded("value").alias("value"))

    return query


def feed_new_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columnar feed read row by row, tracked forms with the required item, without what is known (even keys)."""
    rows = view(spark, sf_dir, "feed")
    packed = feeds.pack_feed(rows)
    known = rows.filter(F.col("accession_no").cast("long") % 2 == 0).select("accession_no")
    found = feeds.new_filings(feeds.unpack_feed(packed), known)
    return found.select("cik", "accession_no", "form_type", "filing_date", "report_date", "primary_doc", F.array_join("items", "|").alias("items"))


def facts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts packed to one JSON document a company and read again; filings that aren't tracked become null."""
    documents = feeds.pack_company_facts(facts(spark, sf_dir))
    known = filings(spark, sf_dir).select("accession_no")
    found = feeds.unpack_company_facts(documents, known)
    keys = ["cik", "concept", "unit", "period_start", "period_end", "filed_date"]
    empty = found.limit(0).select(*found.columns)
    return f.insert_absent(empty, found, keys, "value").select(*keys, "value", "accession_no")


def latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("cik", "concept", "unit", "period_start", "period_end", rounded("value").alias("value"))


def resolved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.resolve(latest(spark, sf_dir)).select("cik", "canonical", "period_start", "period_end", "priority", rounded("value").alias("value"))


def fact_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(spark, sf_dir)
    rows = f.wide(f.resolve(found), f.period_spine(found, filings(spark, sf_dir)))
    return rows.select("cik", "cls", "period_start", "period_end", *[rounded(f"{n}_v").alias(n) for n in sql.NAMES])


def concept_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.concept_drift(latest(spark, sf_dir))


def alias_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.tag_disagreements(latest(spark, sf_dir)).withColumns({c: rounded(c) for c in ("value_a", "value_b")})


def prior_period_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = f.period_spine(latest(spark, sf_dir), filings(spark, sf_dir))
    found = {n: nearest_prior(spine, ["cik", "cls"], "period_start", "period_end", o, t) for n, o, t in (("yoy", 365, 20), ("qoq", 91, 15))}
    return spine.select("cik", "cls", "period_start", "period_end", found["yoy"]["end"].alias("yoy_end"), found["qoq"]["end"].alias("qoq_end"))


def fiscal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.consistent_labels(facts(spark, sf_dir))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.ingest_report(facts(spark, sf_dir), view(spark, sf_dir, "companies"))


def null_reasons(rows: DataFrame) -> DataFrame:
    return rows.filter("null_reason is not null").groupBy("name", "null_reason").agg(F.count("*").alias("n"))


def metric_null_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null reasons of all metrics, counted."""
    return null_reasons(values(spark, sf_dir))


def null_reasons_of_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for metrics that need a prior period, a denominator or a component, as SQL says them."""
    names = ["revenue_yoy", "gross_margin", "roe", "net_debt", "fcf_conversion", "days_inventory", "beneish_dsri"]
    return null_reasons(metrics_of(spark, sf_dir, names))


def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).groupBy("cik", "name").agg(F.count("value").alias("computed"), F.count("*").alias("total"), rounded(F.count("value") / F.count("*")).alias("coverage"))


def metric_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula, inputs and null reason of every metric row, inputs as JSON with sorted keys."""
    return metrics(spark, sf_dir).select("cik", "cls", "period_start", "period_end", "name", "formula", inputs_json(F.col("inputs"), F.col("null_reason")).alias("inputs"))


def provenance_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and summed inputs of operating margins and yearly growth, as SQL says them."""
    found = metrics(spark, sf_dir).filter(F.col("name").isin("operating_margin", "revenue_yoy") & F.col("value").isNotNull())
    tags = F.array_join(F.array_sort(F.map_keys("inputs")), "+")
    return found.select("cik", "cls", "period_start", "period_end", "name", tags.alias("tags"), rounded(F.aggregate(F.map_values("inputs"), F.lit(0.0), lambda a, x: a + x), 6).alias("sum_inputs"))


def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 1: values outside their declared range, by metric and direction."""
    bounds = metric_table(spark).select("name", "cls", "low", "high")
    found = values(spark, sf_dir).join(F.broadcast(bounds), ["name", "cls"]).filter("value < low or value > high")
    side = F.when(F.col("value") < F.col("low"), "below").otherwise("above")
    return found.groupBy("name", side.alias("direction")).agg(F.count("*").alias("n"), rounded(F.min("value")).alias("least"), rounded(F.max("value")).alias("most"), F.array_join(F.array_sort(F.collect_set("cik")), ",").alias("ciks"))


QUERIES = {n: category(c) for n, c in CATEGORIES.items()} | {
    q.__name__: q
    for q in (feed_new_filings, facts_from_json, latest_facts, resolved_facts, fact_wide, concept_drift, alias_disagreement, prior_period_match, fiscal_labels, ingest_report, metric_null_reasons, null_reasons_of_seven, metric_coverage, metric_provenance, provenance_of_two, range_violations)
}

ORACLE = {n: sql.rows_of(c) for n, c in CATEGORIES.items()} | {
    "feed_new_filings": f"""{with_views('feed')}
        SELECT cik, accession_no, form_type, filing_date, CAST(nullif(report_date, '') AS DATE) AS report_date, nullif(primary_doc, '') AS primary_doc,
               array_to_string(list_transform(string_split(items, ','), lambda x: trim(x)), '|') AS items
        FROM feed WHERE form_type IN ('10-K', '10-Q', '8-K') AND list_contains(list_transform(string_split(items, ','), lambda x: trim(x)), '2.02') AND CAST(accession_no AS BIGINT) % 2 = 1""",
    "facts_from_json": f"""{with_views('facts', 'filings')}
        SELECT cik, concept, unit, period_start, period_end, filed_date, min(value) AS value,
               CASE WHEN min(accession_no) IN (SELECT accession_no FROM filings) THEN min(accession_no) END AS accession_no
        FROM facts GROUP BY ALL""",
    "latest_facts": f"{sql.LATEST} SELECT cik, concept, unit, period_start, period_end, round(value, 6) + 0.0 AS value FROM latest",
    "resolved_facts": f"{sql.LATEST} SELECT cik, canonical, period_start, period_end, priority, round(value, 6) + 0.0 AS value FROM resolved",
    "fact_wide": f"{sql.SPINE} SELECT cik, cls, period_start, period_end, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in sql.NAMES)} FROM base",
    "concept_drift": f"""{sql.LATEST}, d AS (SELECT *, lag(priority) OVER (PARTITION BY cik, canonical ORDER BY period_start NULLS FIRST, period_end) AS before FROM resolved)
        SELECT cik, canonical, period_start, period_end, before, priority FROM d WHERE before <> priority""",
    "alias_disagreement": f"""{sql.LATEST}
        SELECT a.cik, a.canonical, a.period_end, a.period_start, a.concept AS tag_a, b.concept AS tag_b, round(a.value, 6) + 0.0 AS value_a, round(b.value, 6) + 0.0 AS value_b
        FROM tagged a JOIN tagged b ON a.cik = b.cik AND a.canonical = b.canonical AND a.period_end = b.period_end AND a.period_start IS NOT DISTINCT FROM b.period_start AND a.priority < b.priority
        WHERE abs(a.value - b.value) / CASE WHEN a.value <> 0 THEN abs(a.value) ELSE 1e-9 END > 0.01""",
    "prior_period_match": f"""{sql.PAIRED}
        SELECT s.cik, s.cls, s.period_start, s.period_end, m.prior_end AS yoy_end, n.prior_end AS qoq_end FROM spine s
        LEFT JOIN yoy m USING (cik, cls, period_start, period_end) LEFT JOIN qoq n USING (cik, cls, period_start, period_end)""",
    "fiscal_labels": f"""{with_views('facts')}
        SELECT accession_no, count(DISTINCT (fiscal_year, fiscal_period)) AS labels, CASE WHEN count(DISTINCT (fiscal_year, fiscal_period)) = 1 THEN min(fiscal_year) END AS fiscal_year,
               CASE WHEN count(DISTINCT (fiscal_year, fiscal_period)) = 1 THEN min(fiscal_period) END AS fiscal_period
        FROM facts WHERE form_type IN ('10-K', '10-Q') AND accession_no IS NOT NULL GROUP BY accession_no""",
    "ingest_report": f"""{sql.LATEST}, companies AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier), counts AS (SELECT cik, canonical, count(*) AS n FROM facts JOIN aliases USING (concept, unit) GROUP BY ALL)
        SELECT c.cik, a.canonical, coalesce(n, 0) AS n FROM companies c CROSS JOIN (SELECT DISTINCT canonical FROM aliases) a LEFT JOIN counts USING (cik, canonical)""",
    "null_reasons_of_seven": f"""{sql.PAIRED}, r AS (
        SELECT 'revenue_yoy' AS name, CASE WHEN y.cik IS NULL THEN 'no earlier period to compare with' WHEN t.revenue IS NULL THEN 'revenue missing (this period)' WHEN y.revenue IS NULL THEN 'revenue missing (earlier period)' WHEN y.revenue = 0 THEN 'the earlier value is zero' END AS null_reason FROM paired WHERE t.cls IN ('annual', 'quarterly')
        UNION ALL SELECT 'gross_margin', CASE WHEN t.gross IS NULL THEN 'no gross_profit, and revenue less cogs cannot be taken' WHEN t.revenue IS NULL THEN 'revenue missing' WHEN t.revenue = 0 THEN 'revenue is zero' END FROM paired WHERE t.cls IN ('annual', 'quarterly')
        UNION ALL SELECT 'roe', CASE WHEN t.net_income IS NULL THEN 'net_income missing' WHEN t.equity IS NULL THEN 'equity missing' WHEN t.equity = 0 THEN 'equity is zero' WHEN t.equity < 0 THEN 'equity is negative' END FROM paired WHERE t.cls IN ('annual', 'quarterly')
        UNION ALL SELECT 'net_debt', CASE WHEN t.debt IS NULL THEN 'no total_debt, and its parts are not all there' WHEN t.cash IS NULL THEN 'cash missing' WHEN t.short_term_investments IS NULL THEN 'short_term_investments missing' END FROM paired WHERE t.cls IN ('annual', 'quarterly')
        UNION ALL SELECT 'fcf_conversion', CASE WHEN t.cfo IS NULL THEN 'free_cash_flow cannot be taken: cfo missing' WHEN t.capex IS NULL THEN 'free_cash_flow cannot be taken: capex missing' WHEN t.net_income IS NULL THEN 'net_income missing' WHEN t.net_income <= 0 THEN 'net_income is not positive' END FROM paired WHERE t.cls IN ('annual', 'quarterly')
        UNION ALL SELECT 'days_inventory', CASE WHEN t.inventory IS NULL THEN 'inventory missing' WHEN t.cogs IS NULL THEN 'cogs missing' WHEN t.cogs = 0 THEN 'cogs is zero' END FROM paired WHERE t.cls = 'annual'
        UNION ALL SELECT 'beneish_dsri', CASE WHEN y.cik IS NULL THEN 'no earlier period to compare with' WHEN t.receivables IS NULL OR t.revenue IS NULL OR y.receivables IS NULL OR y.revenue IS NULL THEN 'receivables or revenue missing in one of the periods'
            WHEN t.revenue = 0 OR y.revenue = 0 THEN 'revenue is zero in one of the periods' WHEN y.receivables = 0 THEN 'the earlier ratio is zero' END FROM paired WHERE t.cls = 'annual')
        SELECT name, null_reason, count(*) AS n FROM r WHERE null_reason IS NOT NULL GROUP BY ALL""",
    "metric_coverage": f"{sql.METRIC_ROWS} SELECT cik, name, count(value) AS computed, count(*) AS total, round(count(value) / count(*), 6) + 0.0 AS coverage FROM metrics GROUP BY ALL",
    "provenance_of_two": f"""{sql.PAIRED}, p AS (SELECT t.cik AS cik, t.cls AS cls, t.period_start AS period_start, t.period_end AS period_end, y.period_start AS ys, y.period_end AS ye FROM paired WHERE t.cls IN ('annual', 'quarterly')),
        tag AS (SELECT cik, canonical, period_start, period_end, concept, value FROM resolved)
        SELECT p.cik, p.cls, p.period_start, p.period_end, 'operating_margin' AS name, array_to_string(list_sort([a.concept, b.concept]), '+') AS tags, round(a.value + b.value, 6) + 0.0 AS sum_inputs
        FROM p JOIN tag a ON a.canonical = 'operating_income' AND (a.cik, a.period_start, a.period_end) = (p.cik, p.period_start, p.period_end)
               JOIN tag b ON b.canonical = 'revenue' AND (b.cik, b.period_start, b.period_end) = (p.cik, p.period_start, p.period_end)
        UNION ALL SELECT p.cik, p.cls, p.period_start, p.period_end, 'revenue_yoy', array_to_string(list_sort([a.concept || '_t', b.concept || '_t-1']), '+'), round(a.value + b.value, 6) + 0.0
        FROM p JOIN tag a ON a.canonical = 'revenue' AND (a.cik, a.period_start, a.period_end) = (p.cik, p.period_start, p.period_end)
               JOIN tag b ON b.canonical = 'revenue' AND (b.cik, b.period_start, b.period_end) = (p.cik, p.ys, p.ye)""",
    "range_violations": f"""{sql.METRIC_ROWS}, b AS (SELECT * FROM (VALUES {', '.join(f"('{m.name}', CAST({m.low} AS DOUBLE), CAST({m.high} AS DOUBLE))" for m in METRICS if m.low is not None)}) AS v(name, low, high))
        SELECT name, CASE WHEN value < low THEN 'below' ELSE 'above' END AS direction, count(*) AS n, round(min(value), 6) + 0.0 AS least, round(max(value), 6) + 0.0 AS most, array_to_string(list_sort(list(DISTINCT cik)), ',') AS ciks
        FROM metrics JOIN b USING (name) WHERE value < low OR value > high GROUP BY ALL""",
}

#: Date columns of results.
DATED = dict.fromkeys([*CATEGORIES, "latest_facts", "resolved_facts", "fact_wide", "concept_drift", "alias_disagreement", "provenance_of_two"], "period_start period_end") | {
    "feed_new_filings": "filing_date report_date",
    "facts_from_json": "period_start period_end filed_date",
    "prior_period_match": "period_start period_end yoy_end qoq_end",
}
