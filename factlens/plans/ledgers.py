"""Queries over the ledger of calls, streams and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.bindings import table, view, with_views
from factlens.operators import ledger as l
from factlens.operators.facts import latest_filed
from factlens.operators.sinks import pending
from factlens.plans.common import facts, once, rounded
from factlens.sources import feeds
from factlens.streaming import discovery

CAP, MOST_CALLS = 0.25, 40


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.priced(view(spark, sf_dir, "ledger"), view(spark, sf_dir, "prices"))


def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("call_id", "call_date", "valid_from", rounded("input_price").alias("input_price"))


def ledger_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.expected_cost(priced(spark, sf_dir)).select("call_id", rounded("expected", 9).alias("expected"))


def cost_recomputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 25."""
    return l.cost_differences(priced(spark, sf_dir)).select("call_id", rounded("expected", 6).alias("expected"), rounded("cost_usd", 6).alias("cost_usd"))


def stale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 18."""
    return l.on_stale_prices(priced(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n"))


def price_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 26."""
    return l.past_review(priced(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n"))


def spend_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.spend_breakdown(view(spark, sf_dir, "ledger")).select("prompt_name", "model", "status", "calls", rounded("cost", 4).alias("cost"))


def ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 19."""
    return l.reconcile(view(spark, sf_dir, "ledger")).select(rounded("direct", 4).alias("total"), "ok")


def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each day admitted while they stay within a day's budget and number; costs in whole micro units, so that sums are exact."""
    calls = view(spark, sf_dir, "ledger").withColumns({"run": F.to_date("created_at").cast("string"), "micro": F.round(F.col("cost_usd") * 1e6).cast("long")})
    return l.admit(calls, "run", ["created_at", "call_id"], "micro", CAP * 1e6, MOST_CALLS).select("call_id", "run", "admitted")


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by whether their input was answered before (turns of even conversations were)."""
    turns = table(spark, sf_dir, "conversations").withColumn("input_hash", F.sha2(F.concat_ws("|", F.lit("model-a"), F.lit("v1"), "text"), 256))
    found = l.split_cached(turns, turns.filter("conv_id % 2 = 0"))
    return found.groupBy("role", "hit").agg(F.count("*").alias("n"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "filings").groupBy("cik", "form_type", "status").agg(F.count("*").alias("n"))


def pending_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(view(spark, sf_dir, "filings"), ["discovered", "failed"]).select("accession_no", "status", "filing_date")


def next_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 filings to be worked on."""
    return pending(view(spark, sf_dir, "filings"), ["discovered", "failed"], 25).select("accession_no", "status", "filing_date")


def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the feed's filings; where it has none, those that a page names."""
    rows = view(spark, sf_dir, "feed").withColumn("page", F.when(F.col("accession_no").cast("long") % 2 == 0, F.concat(F.lit("<p>Item 9.01 Exhibits Item  2.02 of "), "filing_date", F.lit(" Item 9.01</p>"))))
    return rows.select("accession_no", F.array_join(feeds.item_list(F.col("items"), F.col("page")), "|").alias("items"))


def archived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a filing are kept, of its document, its summary and its full text."""
    names = F.explode(F.array("primary_doc", F.lit("FilingSummary.xml"), F.concat("accession_no", F.lit(".txt"))))
    rows = view(spark, sf_dir, "feed").select("accession_no", "form_type", "primary_doc", names.alias("filename"))
    return feeds.to_archive(rows.filter("filename <> ''")).select("accession_no", "filename")


def stream_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream with replayed rows: each filing comes once."""
    return discovery.discover_once(spark, view(spark, sf_dir, "feed")).select("accession_no", "form_type", "filing_date")


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "restated", lambda: discovery.restate_once(spark, facts(spark, sf_dir)))


def stream_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed versions arriving as streams, the second with all of the first again: each is appended once, and the latest wins at read."""
    return latest_filed(restated(spark, sf_dir)).select("cik", "concept", "unit", "period_start", "period_end", rounded("value").alias("value"))


def restatement_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of these streams did to the value known when it came, by concept."""
    return restated(spark, sf_dir).groupBy("concept", "effect").agg(F.count("*").alias("n"))


#: Points in time at which the stream of parts is stopped and started again.
RESTARTS = ["2024-01-08 00:00:00", "2024-01-20 00:00:00"]


def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a day as the parts of a filing, of which it has one to three; errors are parts that failed."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("accession_no"), "event_id", "event_type", "user_id", F.timestamp_millis(F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("at"), "ts")
    place = F.row_number().over(Window.partitionBy("accession_no").orderBy("ts", "event_id"))
    rows = e.select("accession_no", place.alias("part"), (F.col("user_id") % 3 + 1).cast("int").alias("parts"), (F.col("event_type") != "error").alias("ok"), "at")
    return rows.unionByName(rows.filter("part = 1").withColumns({"part": F.lit(0), "ok": F.lit(True)}))


def filing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "outcomes", lambda: discovery.status_once(spark, once(spark, sf_dir, "parts", lambda: part_events(spark, sf_dir)), RESTARTS))


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings whose parts arrive as a stream: done, or to be tried again as a part failed or didn't come in time."""
    return filing_outcomes(spark, sf_dir).select("accession_no", "status", "reason", F.unix_millis("at").alias("at_ms"))


QUERIES = {
    q.__name__: q
    for q in (price_as_of, ledger_cost, cost_recomputation, stale_prices, price_reviews, spend_breakdown, ledger_reconciliation, budget_admission, cache_split, status_counts, pending_filings, next_filings, item_lists, archived_files, stream_discovery, stream_restatements, restatement_effects, stream_status)
}

from factlens.plans import sql  # noqa: E402

L = f"""{with_views('ledger', 'prices')}, p AS (SELECT *, lead(valid_from) OVER (PARTITION BY model ORDER BY valid_from) AS valid_to FROM prices),
c AS (SELECT l.*, CAST(created_at AS DATE) AS call_date, p.input_price, p.output_price, p.valid_from, p.review_date FROM ledger l LEFT JOIN p ON p.model = l.model AND CAST(created_at AS DATE) >= p.valid_from AND (p.valid_to IS NULL OR CAST(created_at AS DATE) < p.valid_to)),
e AS (SELECT *, input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price AS expected FROM c)"""
ORACLE = {
    "price_as_of": f"{L} SELECT call_id, call_date, valid_from, round(CAST(input_price AS DOUBLE), 6) + 0.0 AS input_price FROM c",
    "ledger_cost": f"{L} SELECT call_id, round(CAST(expected AS DOUBLE), 9) + 0.0 AS expected FROM e",
    "cost_recomputation": f"{L} SELECT call_id, round(CAST(expected AS DOUBLE), 6) + 0.0 AS expected, round(CAST(cost_usd AS DOUBLE), 6) + 0.0 AS cost_usd FROM e WHERE status IN ('ok', 'error') AND abs(expected - cost_usd) > 1e-6",
    "stale_prices": f"{L} SELECT model, count(*) AS n FROM c WHERE call_date - valid_from > 60 GROUP BY 1",
    "price_reviews": f"{L} SELECT model, count(*) AS n FROM c WHERE call_date >= review_date AND valid_from < review_date GROUP BY 1",
    "spend_breakdown": f"{with_views('ledger')} SELECT prompt_name, model, status, count(*) AS calls, round(CAST(sum(cost_usd) AS DOUBLE), 4) + 0.0 AS cost FROM ledger GROUP BY ALL",
    "ledger_reconciliation": f"{with_views('ledger')} SELECT round(CAST(sum(cost_usd) AS DOUBLE), 4) + 0.0 AS total, true AS ok FROM ledger",
    "budget_admission": f"""{with_views('ledger')}, r AS (SELECT call_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS run, row_number() OVER w AS place, sum(CAST(round(cost_usd * 1e6) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM ledger WINDOW w AS (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, call_id)),
        f AS (SELECT run, min(place) AS first FROM r WHERE running > {CAP * 1e6} OR place > {MOST_CALLS} GROUP BY run)
        SELECT call_id, run, coalesce(place < first, true) AS admitted FROM r LEFT JOIN f USING (run)""",
    "cache_split": "SELECT role, text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS hit, count(*) AS n FROM conversations GROUP BY ALL",
    "status_counts": f"{with_views('filings')} SELECT cik, form_type, status, count(*) AS n FROM filings GROUP BY ALL",
    "pending_filings": f"{with_views('filings')} SELECT accession_no, status, filing_date FROM filings WHERE status IN ('discovered', 'failed')",
    "next_filings": f"{with_views('filings')} SELECT accession_no, status, filing_date FROM filings WHERE status IN ('discovered', 'failed') ORDER BY filing_date, accession_no LIMIT 25",
    "item_lists": f"""{with_views('feed')} SELECT accession_no, CASE WHEN trim(items) <> '' THEN array_to_string(list_transform(string_split(trim(items), ','), lambda x: trim(x)), '|') WHEN CAST(accession_no AS BIGINT) % 2 = 0 THEN '9.01|2.02' END AS items FROM feed""",
    "archived_files": f"""{with_views('feed')}, f AS (SELECT accession_no, form_type, primary_doc, unnest([primary_doc, 'FilingSummary.xml', accession_no || '.txt']) AS filename FROM feed)
        SELECT accession_no, filename FROM f WHERE filename <> '' AND (form_type = '8-K' OR filename = primary_doc OR filename = 'FilingSummary.xml')""",
    "stream_discovery": f"{with_views('feed')} SELECT DISTINCT accession_no, form_type, filing_date FROM feed WHERE form_type IN ('10-K', '10-Q', '8-K')",
    "restatement_effects": f"""{with_views('facts')}, x AS (SELECT *, count(*) OVER (PARTITION BY cik, concept, unit, period_start, period_end) AS n FROM facts)
        SELECT concept, CASE WHEN n = 1 OR version = CASE WHEN CAST(cik AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END THEN 'first' WHEN version = 0 THEN 'late' ELSE 'restates' END AS effect, count(*) AS n FROM x GROUP BY ALL""",
    "stream_status": """WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS accession_no, user_id % 3 + 1 AS parts, event_type <> 'error' AS ok, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS part FROM events),
        s AS (SELECT accession_no, parts, ms AS started FROM e WHERE part = 1), c AS (SELECT accession_no, count(*) AS n, bool_and(ok) AS well, max(ms) AS last FROM e JOIN s USING (accession_no, parts) WHERE part <= parts AND ms <= started + 14400000 GROUP BY 1)
        SELECT accession_no, CASE WHEN n = parts AND well THEN 'done' ELSE 'retry' END AS status, CASE WHEN n < parts THEN 'timed out' WHEN well THEN 'complete' ELSE 'failed part' END AS reason, CASE WHEN n = parts THEN last ELSE started + 14400000 END AS at_ms FROM s JOIN c USING (accession_no)""",
    "stream_restatements": f"{sql.LATEST} SELECT cik, concept, unit, period_start, period_end, round(value, 6) + 0.0 AS value FROM latest",
}
DATED = {"price_as_of": "call_date valid_from", "pending_filings": "filing_date", "next_filings": "filing_date", "stream_discovery": "filing_date", "stream_restatements": "period_start period_end"}
