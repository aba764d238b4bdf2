"""Views over the given tables that play the part of filings, facts, sections and ledgers.

Each view is plain SQL that means the same in Spark and in DuckDB; the operators' queries read them as DataFrames, and the
checking SQL reads them as common table expressions. They cover whole tables.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Concepts of a quarter or year: tag, unit, condition on the company's number nk and the period's number pk, value.
DURATION_FACTS = (
    ("Revenues", "USD", "nk % 2 = 0", "revenue"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "nk % 2 = 1 OR nk % 6 = 0", "revenue * (CASE WHEN nk % 12 = 0 THEN 1.02 ELSE 1.0 END)"),
    ("CostOfRevenue", "USD", "(nk + pk) % 11 <> 0", "cogs"),
    ("CostOfGoodsSold", "USD", "nk % 7 = 0", "cogs"),
    ("GrossProfit", "USD", "nk % 3 = 0", "revenue - cogs"),
    ("SellingGeneralAndAdministrativeExpense", "USD", "pk % 9 <> 0", "sga"),
    ("ResearchAndDevelopmentExpense", "USD", "nk % 5 <> 4", "revenue * 0.03 + sga * ((nk + pk) % 3)"),
    ("OperatingIncomeLoss", "USD", "(nk + pk) % 13 <> 0", "revenue - cogs - sga * 12 - tax * (pk % 4)"),
    ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "USD", "nk % 10 <> 9", "(revenue - cogs - sga * 12 - tax * (pk % 4)) * 0.98"),
    ("IncomeTaxExpenseBenefit", "USD", "1 = 1", "tax * 0.2"),
    ("NetIncomeLoss", "USD", "pk % 17 <> 3", "(revenue - cogs - sga * 12 - tax * (pk % 4)) * 0.98 - tax * 0.2"),
    ("EarningsPerShareDiluted", "USD/shares", "nk % 4 <> 3", "((revenue - cogs - sga * 12 - tax * (pk % 4)) * 0.98 - tax * 0.2) / 100000"),
    ("DepreciationDepletionAndAmortization", "USD", "1 = 1", "dep"),
    ("Depreciation", "USD", "nk % 4 = 0", "dep * 0.8"),
    ("ShareBasedCompensation", "USD", "nk % 8 <> 5", "sga * 0.1"),
    ("NetCashProvidedByUsedInOperatingActivities", "USD", "1 = 1", "dep + revenue * 0.04 * ((nk * 7 + pk) % 5 - 1)"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "USD", "pk % 14 <> 5", "dep * (0.8 + ((nk + pk) % 4) * 0.5)"),
    ("InterestExpense", "USD", "nk % 6 <> 2", "revenue * 0.01 * ((nk + pk) % 3)"),
)
#: Concepts at a period's end.
INSTANT_FACTS = (
    ("Assets", "1 = 1", "total * 3"),
    ("AssetsCurrent", "1 = 1", "total * 1.2"),
    ("LiabilitiesCurrent", "(nk + pk) % 15 <> 0", "total * (0.8 + ((nk + pk) % 5) * 0.15)"),
    ("StockholdersEquity", "1 = 1", "total * (((nk * 3 + pk) % 7) - 1) * 0.4"),
    ("CashAndCashEquivalentsAtCarryingValue", "1 = 1", "paid * 0.5"),
    ("ShortTermInvestments", "nk % 3 <> 1", "paid * 0.3"),
    ("InventoryNet", "nk % 9 <> 4", "pending * 0.4"),
    ("AccountsReceivableNetCurrent", "1 = 1", "owed * 0.5"),
    ("AccountsPayableCurrent", "nk % 8 <> 6", "pending * 0.2"),
    ("PropertyPlantAndEquipmentNet", "nk % 5 <> 1", "total * 0.9"),
    ("PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization", "nk % 5 = 1 AND nk % 2 = 1", "total * 0.95"),
    ("PropertyPlantAndEquipmentGross", "nk % 5 = 0", "total * 1.5"),
    ("LongTermDebtNoncurrent", "1 = 1", "total * (0.2 + ((nk + pk) % 6) * 0.05)"),
    ("LongTermDebtCurrent", "nk % 6 <> 0", "total * 0.1"),
    ("LongTermDebt", "nk % 4 = 1", "total * (0.3 + ((nk + pk) % 6) * 0.05) * (CASE WHEN nk % 8 = 1 THEN 1.03 ELSE 1.0 END)"),
    ("FinanceLeaseLiabilityNoncurrent", "nk % 2 = 0", "total * 0.02"),
    ("FinanceLeaseLiabilityCurrent", "nk % 3 = 0", "total * 0.01"),
)


def _facts(source: str, facts: list[tuple[str, str, str, str]], start: str) -> str:
    """One pass over ``source``: each row meets the concepts, and those that apply give a value."""
    names = ", ".join(f"('{tag}', '{unit}')" for tag, unit, _, _ in facts)
    value = " ".join(f"WHEN concept = '{tag}' AND ({where}) THEN {expression}" for tag, _, where, expression in facts)
    return f"""SELECT * FROM (SELECT nk, concept, unit, {start} AS period_start, period_end, pk, form_type, ROUND(CASE {value} END, 6) AS v
        FROM {source} CROSS JOIN (VALUES {names}) AS c(concept, unit)) x WHERE v IS NOT NULL"""


CIK = "lpad(CAST({} AS STRING), 10, '0')"
VIEWS: dict[str, str] = {
    "companies": f"SELECT {CIK.format('s_suppkey')} AS cik, s_name AS ticker, s_name AS name FROM supplier",
    "sales": """
        SELECT s_suppkey AS nk, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start,
               ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, ROUND(SUM(l_extendedprice) * 0.6, 4) AS cogs,
               ROUND(SUM(l_extendedprice * l_tax), 4) AS tax, ROUND(SUM(l_quantity) * 10, 4) AS sga, ROUND(SUM(p_retailprice) * 0.5, 4) AS dep
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "flow": """
        SELECT nk, period_start, CAST(period_start + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS period_end,
               year(period_start) * 4 + quarter(period_start) AS pk, CASE WHEN quarter(period_start) = 4 THEN 'none' ELSE '10-Q' END AS form_type,
               revenue, cogs, tax, sga, dep FROM sales
        UNION ALL
        SELECT nk, MIN(period_start) AS period_start, CAST(MAX(period_start) + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS period_end,
               year(period_start) * 4 + 4 AS pk, '10-K' AS form_type, ROUND(SUM(revenue), 4), ROUND(SUM(cogs), 4), ROUND(SUM(tax), 4), ROUND(SUM(sga), 4), ROUND(SUM(dep), 4)
        FROM sales GROUP BY nk, year(period_start) HAVING COUNT(*) = 4""",
    "stock": """
        SELECT nk, CAST(q + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS period_end, year(q) * 4 + quarter(q) AS pk,
               CASE WHEN quarter(q) = 4 THEN '10-K' ELSE '10-Q' END AS form_type, total, paid, pending, owed
        FROM (SELECT CAST(FLOOR(c_custkey / 15) AS BIGINT) AS nk, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, ROUND(SUM(o_totalprice), 4) AS total,
                     ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END), 4) AS paid,
                     ROUND(SUM(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0 END), 4) AS pending,
                     ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END), 4) AS owed
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) x""",
    "fact_values": _facts("flow", list(DURATION_FACTS), "period_start") + " UNION ALL " + _facts("stock", [(t, "USD", w, v) for t, w, v in INSTANT_FACTS], "CAST(NULL AS DATE)"),
    "facts": f"""
        SELECT {CIK.format('nk')} AS cik, concept, unit, period_start, period_end, v.version, CASE WHEN v.version = 0 THEN v * 0.97 ELSE v END AS value,
               CASE WHEN form_type = 'none' THEN NULL ELSE concat({CIK.format('nk')}, '-', CAST(pk AS STRING), '-', form_type) END AS accession_no, form_type,
               CASE WHEN form_type = '10-K' THEN 'FY' ELSE concat('Q', CAST((pk - 1) % 4 + 1 AS STRING)) END AS fiscal_period,
               CAST(FLOOR((pk - 1) / 4) AS INT) + (CASE WHEN (nk * 31 + pk) % 37 = 0 AND concept = 'Revenues' THEN 1 ELSE 0 END) AS fiscal_year,
               CAST(period_end + (CASE WHEN v.version = 0 THEN INTERVAL '30' DAY ELSE INTERVAL '60' DAY END) AS DATE) AS filed_date
        FROM fact_values CROSS JOIN (SELECT 0 AS version UNION ALL SELECT 1 AS version) v WHERE v.version = 1 OR (nk + pk) % 3 = 0""",
    "filings": f"""
        SELECT concat({CIK.format('nk')}, '-', CAST(pk AS STRING), '-', form_type) AS accession_no, {CIK.format('nk')} AS cik, form_type, period_end,
               CAST(period_end + INTERVAL '40' DAY AS DATE) AS filing_date, CAST(FLOOR((pk - 1) / 4) AS INT) AS fiscal_year,
               CASE WHEN form_type = '10-K' THEN 'FY' ELSE concat('Q', CAST((pk - 1) % 4 + 1 AS STRING)) END AS fiscal_period,
               CASE WHEN (nk + pk) % 5 = 0 THEN 'failed' WHEN (nk + pk) % 5 = 1 THEN 'discovered' ELSE 'sectioned' END AS status
        FROM flow WHERE form_type <> 'none'""",
    "feed": """
        SELECT CAST(o_orderkey AS STRING) AS accession_no, CAST(CAST(FLOOR(c_custkey / 15) AS BIGINT) AS STRING) AS cik,
               CASE WHEN o_orderstatus = 'F' THEN '10-K' WHEN o_orderstatus = 'O' THEN '8-K' WHEN o_orderkey % 2 = 0 THEN '10-Q' ELSE 'DEF 14A' END AS form_type,
               CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS report_date,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '2.02,9.01' WHEN o_orderpriority = '2-HIGH' THEN '9.01, 2.02' WHEN o_orderpriority = '3-MEDIUM' THEN '5.02' ELSE '  ' END AS items,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('doc', CAST(o_orderkey AS STRING), '.htm') END AS primary_doc
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "sections": """
        SELECT concat(CAST(doc_id AS STRING), '-', CAST(fiscal_year AS STRING)) AS section_id, concat(source, '-', CAST(CAST(FLOOR(doc_id / 500) AS BIGINT) AS STRING)) AS company, '10-K' AS form_type, 'FY' AS fiscal_period, fiscal_year,
               concat(source, '-', CAST(CAST(FLOOR(doc_id / 500) AS BIGINT) AS STRING), '-', CAST(fiscal_year AS STRING)) AS accession_no, CASE WHEN doc_id % 5 = 0 THEN 'Policies' ELSE 'Notes' END AS category,
               concat(CASE WHEN doc_id % 13 = 0 AND fiscal_year >= 2022 THEN 'Renamed ' ELSE 'Note ' END, CAST(doc_id % 500 AS STRING)) AS short_name, doc_id,
               CASE (doc_id + fiscal_year) % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, ' In all 1,234.5 units.') ELSE substr(text, 1, CAST(FLOOR(length(text) / 2) AS INT)) END AS text
        FROM documents CROSS JOIN (SELECT 2020 AS fiscal_year UNION ALL SELECT 2021 AS fiscal_year UNION ALL SELECT 2022 AS fiscal_year UNION ALL SELECT 2023 AS fiscal_year) y
        WHERE (doc_id + fiscal_year) % 4 <> 3""",
    "findings": """
        SELECT d.doc_id AS finding_id, d.doc_id AS section_id, concat(d.source, '-', CAST(CAST(FLOOR(d.doc_id / 500) AS BIGINT) AS STRING)) AS accession_no, concat('c', CAST(d.doc_id % 6 AS STRING)) AS category,
               CASE WHEN l.toxic = 1 THEN 'high' WHEN l.quality = 0 THEN 'medium' ELSE 'low' END AS severity, concat('Case ', CAST(d.doc_id % 50 AS STRING)) AS headline,
               concat('It had ', CAST(d.doc_id AS STRING), ' units, of them ', CAST(d.doc_id % 7 AS STRING), ', and 57 in all.') AS detail,
               CASE WHEN d.doc_id % 5 = 0 THEN reverse(substr(d.text, 101, 60)) WHEN d.doc_id % 7 = 0 THEN substr(d.text, 101, 30)
                    WHEN d.doc_id % 3 = 0 THEN concat('units of 27 and 18 and 12 for the third time ', CAST(d.doc_id AS STRING)) ELSE substr(d.text, 101, 60) END AS quote,
               concat(d.text, ' units of 27 and 18 and 12 for the third time ', CAST(d.doc_id AS STRING), '.') AS source_text
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "sentences": """
        SELECT accession_no, accession_no AS brief_id, finding_id AS position,
               CASE finding_id % 6 WHEN 0 THEN 'restatement' WHEN 1 THEN 'juxtaposition' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'grouping' WHEN 4 THEN 'sourced_causal' ELSE 'opinion' END AS sentence_type,
               CASE WHEN finding_id % 23 = 0 THEN ' ' WHEN finding_id % 11 = 0 THEN 'Units will rise.' WHEN finding_id % 7 = 0 THEN 'Units rose due to 57 orders.' WHEN finding_id % 5 = 0 THEN concat('Units were ', CAST(finding_id AS STRING), ' and 45.')
                    ELSE concat('Units were ', CAST(finding_id AS STRING), '.') END AS text,
               CASE WHEN finding_id % 13 = 0 THEN 'finding:99999999,note:1' WHEN finding_id % 2 = 0 AND finding_id % 6 <> 0 THEN concat('finding:', CAST(finding_id AS STRING), ',finding:', CAST(finding_id AS STRING))
                    WHEN finding_id % 3 = 0 AND finding_id % 6 <> 0 THEN concat('finding:', CAST(finding_id AS STRING), ',finding:', CAST(finding_id + 20 AS STRING)) ELSE concat('finding:', CAST(finding_id AS STRING)) END AS refs
        FROM findings""",
    "ledger": """
        SELECT event_id AS call_id, ts AS created_at, concat('model-', CAST(user_id % 3 AS STRING)) AS model, CASE WHEN user_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('p', CAST(user_id % 4 AS STRING)) END AS prompt_name,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'refused' ELSE 'ok' END AS status,
               user_id * 37 + 500 AS input_tokens, user_id * 11 + 100 AS output_tokens,
               CASE WHEN event_type = 'signup' THEN 0.0 ELSE ROUND((user_id * 37 + 500) / 1000000.0 * (1 + user_id % 3) + (user_id * 11 + 100) / 1000000.0 * 5 * (1 + user_id % 3), 9) + (CASE WHEN event_id % 97 = 0 THEN 0.01 ELSE 0.0 END) END AS cost_usd
        FROM events""",
    "prices": """
        SELECT concat('model-', CAST(r_regionkey % 3 AS STRING)) AS model, 1.0 + r_regionkey % 3 AS input_price, 5.0 * (1 + r_regionkey % 3) AS output_price,
               CASE WHEN r_regionkey < 3 THEN CAST('2023-10-20' AS DATE) ELSE CAST('2024-01-15' AS DATE) END AS valid_from, CAST('2024-01-20' AS DATE) AS review_date FROM region""",
    "responses": """
        SELECT conv_id, turn, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS response_id,
               CASE WHEN turn % 5 = 0 THEN 'not json' WHEN turn % 7 = 3 THEN '{"material": "yes", "findings": []}' WHEN conv_id % 6 = 0 THEN '{"material": true}'
                    WHEN conv_id % 5 = 0 THEN '{"material": true, "findings": [{"category": "gossip", "severity": "high", "headline": "h", "detail": "d", "quote": "q"}]}'
                    WHEN conv_id % 4 = 0 THEN '{"material": true, "findings": [{"category": "liquidity", "severity": "high", "headline": "h", "detail": "d", "quote": " "}]}'
                    WHEN conv_id % 3 = 0 THEN '{"material": true, "findings": [{"category": "liquidity", "severity": "huge", "headline": "h", "detail": "d", "quote": "q"}]}'
                    WHEN conv_id % 7 = 0 THEN '{"material": true, "findings": [{"category": "liquidity", "severity": "low", "headline": "h"}]}'
                    ELSE '{"material": true, "findings": [{"category": "liquidity", "severity": "low", "headline": "h", "detail": "d", "quote": "q"}, {"category": "litigation", "severity": "medium", "headline": "h2", "detail": "d2", "quote": "q2"}]}' END AS body,
               CASE WHEN turn % 11 = 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason, length(text) AS n, text
        FROM conversations WHERE role = 'assistant'""",
    "generated": """
        SELECT conv_id, turn, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS response_id,
               CASE WHEN turn % 5 = 0 THEN 'nope' WHEN conv_id % 7 = 3 THEN '[1]' WHEN conv_id % 6 = 0 THEN '{"material": 1, "sentences": []}' WHEN conv_id % 5 = 0 THEN '{"material": false}'
                    WHEN conv_id % 4 = 0 THEN '{"material": true, "sentences": [{"type": "grouping", "text": "t"}]}' WHEN conv_id % 3 = 0 THEN '{"material": true, "sentences": ["x"]}'
                    ELSE '{"material": true, "sentences": [{"type": "grouping", "text": "t", "refs": ["finding:1"]}, {"type": "opinion", "text": null, "refs": []}]}' END AS body,
               CASE WHEN turn % 5 = 1 THEN 'nope' WHEN conv_id % 7 = 2 THEN '"x"' WHEN conv_id % 6 = 1 THEN '{"verifications": {}}' WHEN conv_id % 5 = 1 THEN '{"verifications": [{"position": "0", "verdict": "supported"}]}'
                    WHEN conv_id % 4 = 1 THEN '{"verifications": [{"position": 1}]}' WHEN conv_id % 3 = 1 THEN '{"verifications": [3]}' ELSE '{"verifications": [{"position": 0, "verdict": "supported"}, {"position": 2, "verdict": null}]}' END AS verification
        FROM conversations WHERE role = 'assistant'""",
    "verifications": """
        SELECT accession_no AS brief_id, CASE WHEN ascii(substr(accession_no, length(accession_no), 1)) % 4 = 0 THEN 'none'
            ELSE '{"verifications": [{"position": 0, "verdict": "supported"}, {"position": 1, "verdict": "supported"}, {"position": 2, "verdict": "unsupported"}, {"position": 4, "verdict": "supported"}]}' END AS body
        FROM (SELECT DISTINCT concat(source, '-', CAST(CAST(FLOOR(doc_id / 500) AS BIGINT) AS STRING)) AS accession_no FROM documents WHERE source IS NOT NULL) x""",
}

#: Views that a view is made of.
NEEDS = {
    "flow": ("sales",),
    "fact_values": ("sales", "flow", "stock"),
    "facts": ("sales", "flow", "stock", "fact_values"),
    "filings": ("sales", "flow"),
    "sentences": ("findings",),
}


def with_views(*names: str, given: Collection[str] = ()) -> str:
    """The WITH clause that defines the views and what they are made of, without those that are given as tables."""
    order = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order if n not in given)


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view over the tables in ``sf_dir``; views that it is made of may be ``given``."""
    given = given or {}
    if name == "facts":
        return filed_facts(spark, sf_dir, given)
    text = f"{with_views(name, given=given)} SELECT * FROM {name}"
    for table in TABLES:
        if table in text:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for part, rows in given.items():
        rows.createOrReplaceTempView(part)
    return spark.sql(text)


#: What all facts of a row share.
SHARED = {
    "cik": CIK.format("nk"),
    "accession_no": f"CASE WHEN form_type = 'none' THEN NULL ELSE concat({CIK.format('nk')}, '-', CAST(pk AS STRING), '-', form_type) END",
    "fiscal_period": "CASE WHEN form_type = '10-K' THEN 'FY' ELSE concat('Q', CAST((pk - 1) % 4 + 1 AS STRING)) END",
    "year": "CAST(FLOOR((pk - 1) / 4) AS INT)",
    "ahead": "CASE WHEN (nk * 31 + pk) % 37 = 0 THEN 1 ELSE 0 END",
    "twice": "(nk + pk) % 3 = 0",
    "first_filed": "CAST(period_end + INTERVAL '30' DAY AS DATE)",
    "last_filed": "CAST(period_end + INTERVAL '60' DAY AS DATE)",
}


def filed_facts(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view ``facts``, with an expression for each concept: a row is met once, and not once for every concept by all of them.

    What the facts of a row share (company, filing, dates of versions) is made once a row, before concepts and versions unfold.
    """
    names = ["cik", "period_start", "period_end", "form_type", "accession_no", "fiscal_period", "year", "ahead", "twice", "first_filed", "last_filed"]
    versions = "inline(array(named_struct('version', 0, 'value', v * 0.97, 'filed_date', first_filed), named_struct('version', 1, 'value', v, 'filed_date', last_filed)))"

    def values(source: str, facts: list[tuple[str, str, str, str]], start: str) -> DataFrame:
        each = ", ".join(f"named_struct('concept', '{tag}', 'unit', '{unit}', 'v', ROUND(CASE WHEN {where} THEN {value} END, 6))" for tag, unit, where, value in facts)
        rows = view(spark, sf_dir, source, given)
        rows = rows.selectExpr(*[c for c in rows.columns if c != "period_start"], f"{start} AS period_start", *[f"{e} AS {n}" for n, e in SHARED.items()])
        return rows.selectExpr(*names, f"inline(array({each}))").filter("v IS NOT NULL")

    every = values("flow", list(DURATION_FACTS), "period_start").unionByName(values("stock", [(t, "USD", w, v) for t, w, v in INSTANT_FACTS], "CAST(NULL AS DATE)"))
    filed = every.selectExpr(*names, "concept", "unit", versions).filter("version = 1 OR twice")
    year = "year + (CASE WHEN concept = 'Revenues' THEN ahead ELSE 0 END) AS fiscal_year"
    return filed.selectExpr("cik", "concept", "unit", "period_start", "period_end", "version", "value", "accession_no", "form_type", "fiscal_period", year, "filed_date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
