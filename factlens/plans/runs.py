"""Queries over runs: candidates, requests, admission, billing, ingestion, the rule engine and what came of it all."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.bindings import table, view, with_views
from factlens.functions import text as t
from factlens.operators import analysis as a
from factlens.operators import grounding as g
from factlens.operators import ledger as l
from factlens.operators import quality as q
from factlens.operators import rules as r
from factlens.operators import sections as s
from factlens.operators import sinks
from factlens.operators.facts import resolve, tag_disagreements
from factlens.plans import rules as plan_rules
from factlens.plans import sql, texts
from factlens.plans.common import latest, rounded, values
from factlens.registry import METRICS, metric_table
from factlens.sources import pages as p
from factlens.sources import tables
from factlens.storage import materialize, scratch_path

START = "2022-06-01"
MOST_TOKENS = 2_000


def candidate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes filed since the start that aren't boilerplate by what they are called now."""
    rows = view(spark, sf_dir, "sections").withColumn("filing_date", F.make_date(F.col("fiscal_year") + 1, F.lit(2), F.lit(15))).drop("text")
    plain, aliases = spark.createDataFrame([("Note 1",), ("Note 2",)], "short_name string"), spark.createDataFrame([("Note 14", "Note 2"), ("Note 2", "Note 15")], "alias string, canonical string")
    return a.candidate_sections(rows, START, plain, aliases).select("section_id", "accession_no", "short_name")


def candidate_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings since the start with their fiscal label (unknown for some)."""
    rows = view(spark, sf_dir, "filings")
    return a.candidate_filings(rows.withColumn("fiscal_period", F.when(F.col("status") != "failed", F.col("fiscal_period"))), "1996-01-01").select("accession_no", "label")


def plain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "filings")
    return rows.select("accession_no", a.plain_accession(F.col("accession_no")).alias("plain"), a.plain_company(F.col("cik")).alias("company"))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over documents: cached (even sources were asked before), too large, or new."""
    docs = table(spark, sf_dir, "documents")
    prompt = t.render("Note of %%COMPANY%%: %%NOTE%%", company=F.col("source"), note=F.col("text"))
    cache = docs.filter("doc_id % 4 = 0").select(F.sha2(prompt, 256).alias("input_hash"))
    return a.requests(docs.select("doc_id", "source", "text"), prompt, cache, MOST_TOKENS).select("doc_id", F.col("tokens").cast("long").alias("tokens"), "status")


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the ledger as requests of daily runs; runs of even days are scheduled ones."""
    day = F.to_date("created_at")
    calls = view(spark, sf_dir, "ledger").withColumns({"run": day.cast("string"), "cost": F.round(F.col("cost_usd") * 1e6).cast("long"), "scheduled": F.dayofmonth(day) % 2 == 0})
    return l.admit_all(calls.select("run", "created_at", "scheduled", "cost", "call_id"), 0, 3_000_000, 600_000, 60, 250_000, ("created_at", "call_id"))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).select("call_id", "run", "refusal")


def refusal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refusals add to the ledger, by run and note."""
    return l.refusal_rows(admitted(spark, sf_dir)).groupBy("run", "note", "status").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def billed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of an assistant as one to three attempts, the last of which is answered."""
    turns = view(spark, sf_dir, "responses").select("response_id", "conv_id", "n", F.explode(F.sequence(F.lit(1), F.pmod("turn", F.lit(3)) + 1)).alias("attempt"), (F.pmod("turn", F.lit(3)) + 1).alias("last"))
    rows = turns.select(F.col("response_id").alias("request_id"), "attempt", F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"), (F.col("n") * 3).alias("input_tokens"), F.col("n").alias("output_tokens"), (F.col("attempt") == F.col("last")).alias("answered"))
    prices = view(spark, sf_dir, "prices").filter("valid_from < date'2024-01-01'")
    return a.billed_attempts(rows, prices).select("request_id", "attempt", "status", rounded("cost_usd", 9).alias("cost_usd"))


def cache_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections asked again with a new version: documents by language as prompts."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null")
    wanted = docs.select(F.col("lang").alias("prompt_name"), F.col("doc_id").alias("section_id"))
    version = F.when(F.col("doc_id") % 7 < 2, "v3").when(F.col("doc_id") % 7 < 4, "v2").otherwise("v1")
    answered = docs.filter("doc_id % 3 > 0").select(F.col("lang").alias("prompt_name"), F.col("doc_id").alias("section_id"), version.alias("prompt_version"), (F.col("doc_id") % 100 * 0.25).alias("cost_usd"))
    return a.cache_impact(wanted, answered, "v3").withColumn("void_cost", rounded("void_cost"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "responses").withColumn("body", F.replace("body", F.lit('"quote": "q"'), F.concat(F.lit('"quote": "'), F.substring(F.regexp_replace("text", r'["\\\s]+', " "), 1, 45), F.lit('"'))))
    return a.ingested(g.parse_responses(rows), rows.select("response_id", F.col("text").alias("source_text")))


def finding_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of well-formed responses by category: returned, and kept as their quote stands in the turn."""
    return ingested(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("returned"), F.count_if("kept").alias("kept"))


def discard_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 23 by prompt version (by conversation, here): findings that stored responses returned, and those that were kept."""
    rows = g.parse_responses(view(spark, sf_dir, "responses")).filter("invalid_reason is null and stop_reason <> 'max_tokens'")
    analyses = rows.select(F.col("response_id").alias("id"), F.concat(F.lit("v"), (F.col("conv_id") % 3).cast("string")).alias("prompt_version"), F.col("body").alias("output_json"))
    kept = ingested(spark, sf_dir).filter("kept").select(F.col("response_id").alias("analysis_id"))
    return a.discard_rates(analyses, kept).withColumn("discard_rate", rounded("discard_rate"))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.run_statistics(view(spark, sf_dir, "ledger"), ["prompt_name", "model"])
    return found.select("prompt_name", "model", "calls", *[rounded(c).alias(c) for c in ("cost", "ok_rate", "refused_rate", "mean_cost")])


def support_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 24 with the first numbers that nothing supports, by severity."""
    f = view(spark, sf_dir, "findings")
    tiers = g.numeric_support(f).join(f.select("finding_id", "severity"), "finding_id")
    found = a.with_examples(tiers, ["severity"], F.col("tier") == "unsupported", F.concat_ws(":", F.lpad(F.col("finding_id").cast("string"), 9, "0"), "number"))
    return found.select("severity", "n", "bad", rounded("rate").alias("rate"), "examples")


def section_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.eligible_sections(texts.rows(spark, sf_dir), fluctuating=texts.FLUCTUATING)


#: Subjects taken for boilerplate.
PLAIN = [("gross_margin",), ("Note 7",)]


def stored_engine(spark: SparkSession, sf_dir: str, found: list[DataFrame]) -> DataFrame:
    """A run of the engine into a store that lacks high observations and has another statement for some.

    What the section rules found is written first: both the store and the run need it, and comparing texts costs most.
    """
    metric, *sections = [f.select(*r.COLUMNS) for f in found]
    found = [metric, materialize(functools.reduce(DataFrame.unionByName, sections), "fired")]
    plain, path = spark.createDataFrame(PLAIN, "subject string"), scratch_path(spark, "observations")
    store, new = r.store(spark, path), r.batch(found, plain)
    store.merge(new.filter("severity <> 'high'").withColumn("statement", F.when(F.col("subject") == "roe", "as it was").otherwise(F.col("statement"))))
    return r.run(found, plain, store)


def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric rules and the section rules on wording, length and readability in one run."""
    rows = texts.rows(spark, sf_dir)
    sections = [s.wording_changed(rows, texts.words(spark, sf_dir)), s.length_change(rows), s.readability_change(rows)]
    out = stored_engine(spark, sf_dir, [plan_rules.observations(spark, sf_dir), *sections])
    return out.groupBy("rule_name", "subject", "severity", F.col("_change").alias("change")).agg(F.count("*").alias("n"))


def rule_engine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven rules in one run: those of ``rule_engine`` and notes that were renamed, came or went."""
    rows, (changes, found) = texts.rows(spark, sf_dir), texts.found(spark, sf_dir)
    sections = [s.wording_changed(rows, texts.words(spark, sf_dir)), s.length_change(rows), s.readability_change(rows), s.renamed(found), s.appeared_or_gone(changes, found, "a"), s.appeared_or_gone(changes, found, "d")]
    out = stored_engine(spark, sf_dir, [plan_rules.observations(spark, sf_dir), *sections])
    return out.groupBy("rule_name", "subject", "severity", F.col("_change").alias("change")).agg(F.count("*").alias("n"))


def range_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks 1 and 1a: values out of range, hard unless registered for that metric, company and period (here those of annual roe)."""
    bounds = metric_table(spark).select("name", "cls", "low", "high")
    found = values(spark, sf_dir).join(F.broadcast(bounds), ["name", "cls"]).filter("value < low or value > high")
    keys = ["name", "cik", "period_start", "period_end"]
    register = found.filter("name = 'roe' and cls = 'annual'").select(*keys, F.lit("equity close to zero").alias("reason"))
    return q.with_register(found, register, keys).groupBy("name", "hard").agg(F.count("*").alias("n"))


def alias_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks 6 and 6a: tags of one concept that disagree, hard unless registered for that company and concept (here cost of revenue)."""
    found = tag_disagreements(latest(spark, sf_dir))
    register = found.filter("canonical = 'cogs'").select("cik", "canonical").distinct().withColumn("reason", F.lit("two definitions"))
    return q.with_register(found, register, ["cik", "canonical"]).groupBy("cik", "canonical", "hard").agg(F.count("*").alias("n"))


def debt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How companies report debt: periods by which of the three tags there are."""
    names = ["total_debt", "debt_noncurrent", "debt_current"]
    rows = resolve(latest(spark, sf_dir)).filter(F.col("canonical").isin(names)).groupBy("cik", "period_end").pivot("canonical", names).agg(F.first("value"))
    return rows.groupBy(*[F.col(n).isNotNull().alias(n) for n in names]).agg(F.count("*").alias("n"))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages made of filings' documents, with a second table that doesn't count and a row that is too short."""
    feed = view(spark, sf_dir, "feed").filter("primary_doc <> ''")
    head = '<html><body><table summary="Other"><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table><table class="t" summary="Document Format Files"><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr>'
    row = F.concat(F.lit("<tr><td>1</td><td>Report &amp; notes</td><td><a href='x'>"), "primary_doc", F.lit("</a> &nbsp;iXBRL</td><td>"), "form_type", F.lit("</td><td>9</td></tr><tr><td>short</td></tr>"))
    html = F.concat(F.lit(head), row, F.lit("<tr><td></td><td>Complete text</td><td>"), "accession_no", F.lit(".txt</td><td></td></tr></table></body></html>"))
    return feed.select("accession_no", html.alias("html"))


def doc_type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such pages, parsed again."""
    return p.with_document_types(index_pages(spark, sf_dir)).select("accession_no", "filename", "type", "description")


def doc_type_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of such pages by a table function, joined laterally in SQL."""
    tables.register(spark)
    index_pages(spark, sf_dir).createOrReplaceTempView("index_pages")
    return spark.sql("SELECT p.accession_no, d.filename, d.type, d.description FROM index_pages p, LATERAL document_rows(p.html) d")


def merge_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer list of companies merged into an older one: keys that are new, names that changed."""
    c = view(spark, sf_dir, "companies")
    old = c.filter(F.col("cik").cast("long") % 5 != 2).withColumn("name", F.when(F.col("cik").cast("long") % 3 == 0, F.lower("name")).otherwise(F.col("name")))
    found = sinks.upsert_changed(old, c, ["cik"], ["ticker", "name"])
    return found.select("cik", "name", F.col("_change").alias("change"))


QUERIES = {
    x.__name__: x
    for x in (candidate_sections, candidate_filings, plain_ids, request_table, admission, refusal_rows, billed_attempts, cache_impact, finding_ingestion, discard_by_version, run_statistics, support_examples, section_eligibility, rule_engine, rule_engine_all, range_exceptions, alias_exceptions, debt_parts, doc_type_table, doc_type_sql, merge_companies)
}

from factlens.plans.evidence import SUPPORT  # noqa: E402
from factlens.plans.rules import M  # noqa: E402
from factlens.plans.texts import FOG, FOG_BEFORE, PREFIX_RATIO, S  # noqa: E402

ADMITTED = f"""{with_views('ledger')}, q AS (SELECT call_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS run, CAST(round(cost_usd * 1e6) AS BIGINT) AS cost, day(CAST(created_at AS DATE)) % 2 = 0 AS scheduled, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, call_id) AS nth FROM ledger),
    u AS (SELECT *, sum(cost) OVER (PARTITION BY run ORDER BY nth) AS running FROM q), st AS (SELECT *, CASE WHEN nth > 60 THEN 'calls' WHEN running > CASE WHEN scheduled THEN 250000 ELSE 600000 END THEN 'run cost' END AS stop FROM u),
    en AS (SELECT *, min(nth) FILTER (stop IS NOT NULL) OVER (PARTITION BY run) AS ended FROM st), tot AS (SELECT run, sum(cost) AS total FROM en WHERE ended IS NULL OR nth < ended GROUP BY run),
    bef AS (SELECT run, coalesce(sum(total) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tot),
    admitted AS (SELECT call_id, run, CASE WHEN nth >= ended THEN coalesce(stop, 'run ended') WHEN before + running > 3000000 THEN 'lifetime budget' END AS refusal FROM en LEFT JOIN bef USING (run))"""
ENGINE = f"""{M}, sec AS ({S}, f AS (SELECT company AS cik, accession_no, make_date(fiscal_year, 12, 31) AS period_end, 'section_length_change' AS rule_name, short_name AS subject, 'medium' AS severity FROM pairs WHERE words > 0 AND prior_words > 0 AND abs(words / prior_words - 1) > 0.25
        UNION ALL SELECT company, accession_no, make_date(fiscal_year, 12, 31), 'section_wording_changed', short_name, 'high' FROM pairs WHERE wording_hash <> prior_hash AND {PREFIX_RATIO} < 0.60
        UNION ALL SELECT company, accession_no, make_date(fiscal_year, 12, 31), 'readability_change', short_name, 'low' FROM pairs WHERE words >= 50 AND prior_words >= 50 AND {FOG_BEFORE} > 0 AND abs(({FOG}) / ({FOG_BEFORE}) - 1) > 0.15) SELECT * FROM f),
    allof AS (SELECT cik, accession_no, period_end, rule_name, subject, severity, false AS peer FROM observed UNION ALL
        SELECT cik, accession_no, period_end, rule_name, subject, severity, EXISTS (SELECT 1 FROM sec o WHERE o.rule_name = sec.rule_name AND o.subject = sec.subject AND o.cik <> sec.cik AND abs(o.period_end - sec.period_end) <= 365) FROM sec),
    final AS (SELECT *, CASE WHEN subject IN ('gross_margin', 'Note 7') OR peer THEN 'low' ELSE severity END AS level FROM allof)"""
ORACLE = {
    "candidate_sections": f"""{with_views('sections')} SELECT section_id, accession_no, short_name FROM sections WHERE category = 'Notes' AND make_date(fiscal_year + 1, 2, 15) >= DATE '{START}'
        AND CASE short_name WHEN 'Note 14' THEN 'Note 2' WHEN 'Note 2' THEN 'Note 15' ELSE short_name END NOT IN ('Note 1', 'Note 2')""",
    "candidate_filings": f"""{with_views('filings')} SELECT accession_no, CASE WHEN status = 'failed' THEN 'unknown fiscal period' WHEN fiscal_period = 'FY' THEN 'FY' || fiscal_year ELSE fiscal_period || ' FY' || fiscal_year END AS label
        FROM filings WHERE form_type IN ('10-K', '10-Q') AND filing_date >= DATE '1996-01-01'""",
    "plain_ids": f"{with_views('filings')} SELECT accession_no, replace(accession_no, '-', '') AS plain, ltrim(cik, '0') AS company FROM filings",
    "request_table": f"""WITH p AS (SELECT doc_id, 'Note of ' || coalesce(source, '') || ': ' || coalesce(text, '') AS prompt FROM documents), k AS (SELECT *, greatest(1, CAST(round_even(length(prompt) / 4, 0) AS BIGINT)) AS tokens FROM p)
        SELECT doc_id, tokens, CASE WHEN prompt IN (SELECT prompt FROM p WHERE doc_id % 4 = 0) THEN 'cached' WHEN tokens > {MOST_TOKENS} THEN 'oversize' ELSE 'new' END AS status FROM k""",
    "admission": f"{ADMITTED} SELECT call_id, run, refusal FROM admitted",
    "refusal_rows": f"{ADMITTED} SELECT run, refusal AS note, 'refused' AS status, count(*) AS n, CAST(0 AS BIGINT) AS cost FROM admitted WHERE refusal IS NOT NULL GROUP BY ALL",
    "billed_attempts": f"""{with_views('responses', 'prices')}, x AS (SELECT response_id, conv_id, n, turn % 3 + 1 AS last, unnest(range(1, turn % 3 + 2)) AS attempt FROM responses)
        SELECT response_id AS request_id, attempt, CASE WHEN attempt = last THEN 'ok' ELSE 'error' END AS status, round(CAST(n * 3 / 1e6 * input_price + n / 1e6 * output_price AS DOUBLE), 9) + 0.0 AS cost_usd
        FROM x LEFT JOIN (SELECT * FROM prices WHERE valid_from < DATE '2024-01-01') p ON p.model = 'model-' || (conv_id % 3)""",
    "cache_impact": """WITH d AS (SELECT lang AS prompt_name, doc_id, CASE WHEN doc_id % 7 < 2 THEN 'v3' WHEN doc_id % 7 < 4 THEN 'v2' ELSE 'v1' END AS v, doc_id % 3 > 0 AS answered, doc_id % 100 * 0.25 AS cost FROM documents WHERE lang IS NOT NULL)
        SELECT prompt_name, count(*) FILTER (answered AND v = 'v3') AS hits, count(*) FILTER (NOT (answered AND v = 'v3')) AS new_calls, count(*) FILTER (answered AND v <> 'v3') AS invalidated, round(CAST(coalesce(sum(cost) FILTER (answered AND v <> 'v3'), 0) AS DOUBLE), 6) + 0.0 AS void_cost,
               coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (answered AND v <> 'v3'), '') AS versions FROM d GROUP BY 1""",
    "finding_ingestion": f"""{with_views('responses')}, g AS (SELECT response_id, text, substr(regexp_replace(text, '["\\\\\\s]+', ' ', 'g'), 1, 45) AS q, body FROM responses WHERE stop_reason <> 'max_tokens' AND body LIKE '%"litigation"%'),
        f AS (SELECT 'liquidity' AS category, 'low' AS severity, q, text FROM g UNION ALL SELECT 'litigation', 'medium', 'q2', text FROM g)
        SELECT category, severity, count(*) AS returned, count(*) FILTER (length(trim(q)) >= 40 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(q, '\\s+', ' ', 'g')))) AS kept FROM f GROUP BY ALL""",
    "discard_by_version": f"""{with_views('responses')}, g AS (SELECT conv_id, text, substr(regexp_replace(text, '["\\\\\\s]+', ' ', 'g'), 1, 45) AS q FROM responses WHERE stop_reason <> 'max_tokens' AND body LIKE '%"litigation"%'),
        v AS (SELECT 'v' || (conv_id % 3) AS prompt_version, length(trim(q)) >= 40 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS kept FROM g)
        SELECT prompt_version, 2 * count(*) AS returned, count(*) FILTER (kept) AS kept, 2 * count(*) - count(*) FILTER (kept) AS discarded, round((2 * count(*) - count(*) FILTER (kept)) / (2 * count(*)), 6) + 0.0 AS discard_rate FROM v GROUP BY 1""",
    "run_statistics": f"""{with_views('ledger')} SELECT prompt_name, model, count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 6) + 0.0 AS cost, round(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (status IN ('ok', 'error')), 0), 6) + 0.0 AS ok_rate,
        round(count(*) FILTER (status = 'refused') / count(*), 6) + 0.0 AS refused_rate, round(CAST(sum(cost_usd) FILTER (status IN ('ok', 'error')) AS DOUBLE) / nullif(count(*) FILTER (status IN ('ok', 'error')), 0), 6) + 0.0 AS mean_cost FROM ledger GROUP BY ALL""",
    "support_examples": f"""{SUPPORT}, x AS (SELECT severity, lpad(CAST(finding_id AS VARCHAR), 9, '0') || ':' || number AS example FROM support WHERE tier = 'unsupported' QUALIFY row_number() OVER (PARTITION BY severity ORDER BY lpad(CAST(finding_id AS VARCHAR), 9, '0') || ':' || number) <= 5)
        SELECT s.severity, count(*) AS n, count(*) FILTER (tier = 'unsupported') AS bad, round(count(*) FILTER (tier = 'unsupported') / count(*), 6) + 0.0 AS rate, (SELECT string_agg(example, ' | ' ORDER BY example) FROM x WHERE x.severity = s.severity) AS examples FROM support s GROUP BY s.severity""",
    "section_eligibility": f"""{S}, n AS (SELECT DISTINCT company, fiscal_year, short_name FROM notes), y AS (SELECT DISTINCT company, fiscal_year FROM n), b AS (SELECT company, fiscal_year FROM y WHERE (company, fiscal_year - 1) IN (SELECT (company, fiscal_year) FROM y)),
        w AS (SELECT company, fiscal_year, short_name FROM n UNION SELECT company, fiscal_year + 1, short_name FROM n), k AS (SELECT w.company, count(*) AS n FROM w JOIN b USING (company, fiscal_year) GROUP BY 1),
        c AS (SELECT company, count(*) AS a, count(*) FILTER (words > 0 AND prior_words > 0) AS b, count(*) FILTER (words >= 50 AND prior_words >= 50) AS c FROM pairs GROUP BY 1),
        z AS (SELECT coalesce(c.company, k.company) AS cik, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(n, 0) AS n FROM c FULL JOIN k ON c.company = k.company)
        SELECT cik, 'section_wording_changed' AS rule_name, a AS eligible FROM z UNION ALL SELECT cik, 'section_length_change', b FROM z UNION ALL SELECT cik, 'readability_change', c FROM z UNION ALL SELECT cik, 'section_appeared', n FROM z UNION ALL SELECT cik, 'section_disappeared', n FROM z""",
    "rule_engine": f"""{ENGINE} SELECT rule_name, subject, level AS severity, CASE WHEN level = 'high' THEN 'insert' WHEN subject = 'roe' THEN 'update' ELSE 'same' END AS change, count(*) AS n FROM final GROUP BY ALL""",
    "range_exceptions": f"""{sql.METRIC_ROWS}, b AS (SELECT * FROM (VALUES {', '.join(f"('{m.name}', CAST({m.low} AS DOUBLE), CAST({m.high} AS DOUBLE))" for m in METRICS if m.low is not None)}) AS v(name, low, high))
        SELECT name, NOT (name = 'roe' AND cls = 'annual') AS hard, count(*) AS n FROM metrics JOIN b USING (name) WHERE value < low OR value > high GROUP BY ALL""",
    "alias_exceptions": f"""{sql.LATEST} SELECT a.cik, a.canonical, a.canonical <> 'cogs' AS hard, count(*) AS n
        FROM tagged a JOIN tagged b ON a.cik = b.cik AND a.canonical = b.canonical AND a.period_end = b.period_end AND a.period_start IS NOT DISTINCT FROM b.period_start AND a.priority < b.priority
        WHERE abs(a.value - b.value) / CASE WHEN a.value <> 0 THEN abs(a.value) ELSE 1e-9 END > 0.01 GROUP BY ALL""",
    "debt_parts": f"""{sql.SPINE} SELECT total_debt IS NOT NULL AS total_debt, debt_noncurrent IS NOT NULL AS debt_noncurrent, debt_current IS NOT NULL AS debt_current, count(*) AS n FROM instants
        WHERE total_debt IS NOT NULL OR debt_noncurrent IS NOT NULL OR debt_current IS NOT NULL GROUP BY ALL""",
    "doc_type_table": f"""{with_views('feed')} SELECT accession_no, primary_doc AS filename, form_type AS type, 'Report & notes' AS description FROM feed WHERE primary_doc <> ''
        UNION ALL SELECT accession_no, accession_no || '.txt', '', 'Complete text' FROM feed WHERE primary_doc <> ''""",
    "merge_companies": f"{with_views('companies')} SELECT cik, name, CASE WHEN CAST(cik AS BIGINT) % 5 = 2 THEN 'insert' WHEN CAST(cik AS BIGINT) % 3 = 0 AND lower(name) <> name THEN 'update' ELSE 'same' END AS change FROM companies",
}
ORACLE["doc_type_sql"] = ORACLE["doc_type_table"]
DATED: dict[str, str] = {}
