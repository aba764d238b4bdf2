"""Queries over findings, sentences, selections and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.bindings import table, view, with_views
from factlens.functions.text import numbers_with_units as with_units
from factlens.functions.text import parse_ref
from factlens.operators import analysis, briefs, ledger, selection
from factlens.operators import grounding as g
from factlens.plans import rules as plan_rules
from factlens.plans.common import once, rounded
from factlens.plans.rules import M
from factlens.registry import METRICS, ORDINALS
from factlens.sources import tables


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with ids: a rank within the filing by rule, subject and period."""
    order = Window.partitionBy("accession_no").orderBy("rule_name", "subject", "period_end", "cik")
    return plan_rules.observations(spark, sf_dir).filter("accession_no is not null").withColumn("id", F.row_number().over(order))


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.check_quotes(view(spark, sf_dir, "findings")).select("finding_id", "quote_ok")


def numeric_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.numeric_support(view(spark, sf_dir, "findings"))


def numeric_support_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 24: numbers found in the quote or the note, by severity; sums and others are one group here."""
    f = view(spark, sf_dir, "findings")
    tiers = g.numeric_support(f).join(f.select("finding_id", "severity"), "finding_id")
    return tiers.groupBy("severity").agg(F.count("*").alias("numbers"), F.count_if(F.col("tier") == "in_quote").alias("in_quote"), F.count_if(F.col("tier") == "in_note_only").alias("in_note"), F.count_if(F.col("tier").isin("derived_verified", "unsupported")).alias("others"))


def support_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 24 by prompt version: that of a finding goes by its number, here."""
    f = view(spark, sf_dir, "findings")
    found = analysis.support_rates(g.numeric_support(f), f.select("finding_id", F.concat(F.lit("v"), (F.col("finding_id") % 3).cast("string")).alias("prompt_version")))
    return found.withColumn("support_rate", rounded("support_rate"))


def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all sentences with the finding that each names; some findings are gone, and observations have no such number here."""
    findings = view(spark, sf_dir, "findings").filter("finding_id % 17 <> 3").select("finding_id", "headline", "severity")
    observations = spark.createDataFrame([(-1, "none")], "id long, statement string")
    rows = briefs.resolved_references(view(spark, sf_dir, "sentences"), findings, observations)
    return rows.select("brief_id", "position", F.col("k").cast("int").alias("k"), "ref", "kind", F.col("finding.headline").alias("headline"), F.col("finding.severity").alias("severity"))


def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each filing as a block of text; filings of which none is severe have none."""
    f = view(spark, sf_dir, "findings")
    rows = f.filter("severity <> 'low'").select("accession_no", F.col("finding_id").alias("id"), "severity", F.col("headline").alias("statement"))
    return selection.evidence_block(rows, "accession_no", "finding", f)


def sampled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty findings drawn by a seed."""
    return selection.sample(view(spark, sf_dir, "findings").select("finding_id", "severity"), "finding_id", 40, 7)


def numbers_with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "findings").select("finding_id", F.concat(F.lit("$"), "detail", F.lit(" and 5%")).alias("t"))
    return rows.select("finding_id", F.posexplode(with_units(F.col("t"))).alias("k", "x")).select("finding_id", "k", rounded("x.value").alias("value"), "x.unit")


def number_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of each number of a text that starts with signs in all places: apart, on both sides, before and after."""
    t = F.concat(F.lit("$5% $ 5 of €1,234.50 or 7 % and 8%. "), "text")
    units = F.transform(with_units(t), lambda x: F.when(x["unit"] == "", "-").otherwise(x["unit"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(units, "").alias("units"))


def number_units_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function, joined laterally in SQL."""
    tables.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("""
        SELECT d.doc_id, concat_ws('', transform(array_sort(collect_list(struct(n.place, n.unit))), x -> CASE WHEN x.unit = '' THEN '-' ELSE x.unit END)) AS units
        FROM documents d LEFT JOIN LATERAL numbers_with_units('$5% $ 5 of €1,234.50 or 7 % and 8%. ' || d.text) n GROUP BY d.doc_id""")


def select_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_observations(numbered(spark, sf_dir)).select("accession_no", "id", "rule_name", "subject", "severity")


def select_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_findings(view(spark, sf_dir, "findings")).select("accession_no", "finding_id", "category", "severity")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        evidence = view(spark, sf_dir, "findings").select("accession_no", F.concat(F.lit("finding:"), F.col("finding_id").cast("string")).alias("ref"), g.source_text("finding").alias("source"))
        return g.verify_sentences(g.resolve_refs(view(spark, sf_dir, "sentences"), evidence))

    return once(spark, sf_dir, "verified", make)


def verify_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("accession_no", "position", "sentence_type", "drop_reason")


def sentence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that don't depend on sums of numbers, counted by type."""
    found = verified(spark, sf_dir).withColumn("reason", F.when(F.col("sentence_type") == "aggregation", F.when(F.col("drop_reason") != "number does not verify", F.col("drop_reason"))).otherwise(F.col("drop_reason")))
    return found.groupBy("sentence_type", "reason").agg(F.count("*").alias("n"))


def brief_drop_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.drop_rates(verified(spark, sf_dir)).select("brief_id", "sentences", "dropped", rounded("rate").alias("rate"))


def brief_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept sentences, renumbered."""
    return g.assemble(verified(spark, sf_dir)).select("brief_id", "position", "place")


def orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 27: references that are malformed or that no finding answers."""
    refs = view(spark, sf_dir, "sentences").select("brief_id", "position", F.explode(F.split("refs", ",")).alias("ref"))
    known = view(spark, sf_dir, "findings").select(F.col("finding_id").alias("id")).withColumn("known", F.lit(True))
    rows = refs.withColumn("id", parse_ref(F.col("ref"))["id"]).join(known, "id", "left")
    return rows.filter("known is null").select("brief_id", "position", "ref", F.when(F.col("id").isNull(), "malformed").otherwise("unresolved").alias("problem"))


def cross_filing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 28: references to a finding of another filing."""
    refs = view(spark, sf_dir, "sentences").select("accession_no", "position", F.explode(F.split("refs", ",")).alias("ref")).withColumn("finding_id", parse_ref(F.col("ref"))["id"] + 1)
    owners = view(spark, sf_dir, "findings").select("finding_id", F.col("accession_no").alias("owner"))
    return refs.join(owners, "finding_id").filter("owner <> accession_no").select("accession_no", "position", "ref", "owner")


def sentence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 29: sentences of an unknown type."""
    return view(spark, sf_dir, "sentences").filter(~F.col("sentence_type").isin("restatement", "juxtaposition", "aggregation", "grouping", "sourced_causal")).select("brief_id", "position", "sentence_type")


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = g.parse_responses(view(spark, sf_dir, "responses")).withColumn("attempt", F.col("turn") % 3)
    return parsed.select("response_id", "invalid_reason", g.outcome(parsed).alias("outcome"), F.when(F.col("invalid_reason").isNull(), F.size("parsed.findings")).alias("findings"))


def discard_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check 23: findings returned and kept (their quote holds), by severity."""
    f = g.check_quotes(view(spark, sf_dir, "findings"))
    return f.groupBy("severity").agg(F.count("*").alias("returned"), F.count_if("quote_ok").alias("kept"), rounded(1 - F.count_if("quote_ok") / F.count("*")).alias("discarded"))


QUERIES = {
    q.__name__: q
    for q in (quote_check, numeric_support, numeric_support_by_severity, support_by_version, evidence_view, evidence_blocks, sampled_findings, numbers_with_units, number_units, number_units_sql, select_observations, select_findings, verify_sentences, sentence_reasons, brief_drop_rates, brief_assembly, orphan_refs, cross_filing_refs, sentence_types, parse_responses, discard_rate)
}

F_ = with_views("findings")
FS = with_views("sentences")
COLLAPSE = "trim(regexp_replace({}, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}\\x0b]+', ' ', 'g'))"
QUOTE_OK = f"coalesce(length(trim(quote)) >= 40 AND contains({COLLAPSE.format('source_text')}, {COLLAPSE.format('quote')}), false)"
CATEGORY = " ".join(f"WHEN '{m.name}' THEN '{m.category}'" for m in METRICS)
RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
CAUSE = "(?i)\\b(?:because|due to|driven by|as a result of|caused by|owing to|reflecting|attributable to|stemming from)\\b"
NUMBERS = "list_transform(regexp_extract_all({}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda v: CAST(replace(v, ',', '') AS DOUBLE))"


def adds_up_sql(target: str, values: str) -> str:
    """Whether two or more of at most 20 values add up to the target: all sums, and of how many values each is, side by side."""
    sums = f"list_reduce(list_prepend([0.0::DOUBLE], list_transform({values}, lambda p: [p::DOUBLE])), lambda a1, b1: list_concat(a1, list_transform(a1, lambda c1: c1 + b1[1])))"
    sizes = f"list_reduce(list_prepend([0.0::DOUBLE], list_transform({values}, lambda p: [1.0::DOUBLE])), lambda a2, b2: list_concat(a2, list_transform(a2, lambda c2: c2 + b2[1])))"
    return f"(len({values}) BETWEEN 2 AND 20 AND len(list_filter(list_zip({sums}, {sizes}), lambda z: z[2] >= 2 AND abs(z[1] - ({target})) <= 1e-6)) > 0)"


UNIT = "CASE WHEN substr(x, 1, 1) IN ('$', '€', '£') THEN substr(x, 1, 1) WHEN x LIKE '%\\%' ESCAPE '\\' THEN '%' ELSE '' END"
VERIFIED = f"""{FS}, e AS (SELECT accession_no, 'finding:' || finding_id AS ref, headline || ' ' || detail || ' ' || coalesce(quote, '') AS source FROM findings),
    r AS (SELECT accession_no, position, unnest(string_split(refs, ',')) AS ref FROM sentences), n AS (SELECT r.accession_no, r.position, count(*) AS n, bool_or(regexp_matches(source, '{CAUSE}')) AS why, list(source) AS sources FROM r JOIN e USING (accession_no, ref) GROUP BY ALL),
    v AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(why, false) AS why, regexp_matches(text, '{CAUSE}') AS cause, coalesce(array_to_string(sources, ' | '), '') AS given,
          list_distinct(list_filter({NUMBERS.format('text')}, lambda q: NOT list_contains({NUMBERS.format("coalesce(array_to_string(sources, ' | '), '')")}, q))) AS missing FROM sentences s LEFT JOIN n USING (accession_no, position)),
    todo AS (SELECT accession_no, position, given, unnest(missing) AS target FROM v WHERE sentence_type = 'aggregation'),
    addend AS (SELECT accession_no, position, target, {UNIT} AS unit, CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE) AS value FROM (SELECT accession_no, position, target, unnest(regexp_extract_all(given, '[$€£]?\\d[\\d,]*(?:\\.\\d+)?%?')) AS x FROM todo)),
    sums AS (SELECT accession_no, position, target, {adds_up_sql('target', 'list(value)')} AS ok FROM addend GROUP BY accession_no, position, target, unit),
    proven AS (SELECT accession_no, position, target, bool_or(ok) AS ok FROM sums GROUP BY ALL),
    unproven AS (SELECT t.accession_no, t.position, count(*) FILTER (NOT coalesce(ok, false)) AS bad FROM todo t LEFT JOIN proven p USING (accession_no, position, target) GROUP BY ALL),
    verified AS (SELECT v.accession_no, v.brief_id, v.position, sentence_type, text, refs, CASE WHEN sentence_type NOT IN ('restatement', 'juxtaposition', 'aggregation', 'grouping', 'sourced_causal') THEN 'unrecognised type' WHEN trim(text) = '' THEN 'missing or empty text' WHEN n = 0 THEN 'zero resolving references'
        WHEN regexp_matches(text, '(?i)\\b(?:will|expects|likely|suggests|indicates|points to|implies)\\b') THEN 'predictive language' WHEN sentence_type = 'restatement' AND n <> 1 THEN 'not exactly one reference'
        WHEN sentence_type IN ('juxtaposition', 'grouping') AND n < 2 THEN 'fewer than two references' WHEN sentence_type IN ('restatement', 'juxtaposition', 'grouping') AND cause THEN 'states a cause'
        WHEN sentence_type = 'aggregation' AND coalesce(bad, 0) > 0 THEN 'number does not verify' WHEN sentence_type = 'grouping' AND len(missing) > 0 THEN 'number not in sources' WHEN sentence_type = 'sourced_causal' AND NOT why THEN 'no source states a cause' END AS drop_reason
        FROM v LEFT JOIN unproven USING (accession_no, position))"""
ORDINAL = "replace({}, ',', '')"
for _k, _word in enumerate(ORDINALS, 1):
    ORDINAL = f"regexp_replace({ORDINAL}, '(?i)\\b{_word}\\b', '{_k}', 'g')"


def _stands(number: str, text: str) -> str:
    return f"regexp_matches({text}, '(^|[^0-9.,])' || replace({number}, '.', '\\.') || '($|[^0-9,.]|\\.($|[^0-9]))')"


def _found(text: str) -> str:
    return f"({_stands('number', text)} OR {_stands('short', text)})"


SUPPORT = f"""{F_}, t AS (SELECT finding_id, severity, {ORDINAL.format("coalesce(quote, '')")} AS q, {ORDINAL.format('source_text')} AS s, quote, unnest(list_distinct(list_transform(regexp_extract_all(headline || ' ' || detail, '\\d[\\d,]*(?:\\.\\d+)?'), lambda v: replace(v, ',', '')))) AS number FROM findings),
    u AS (SELECT *, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.?0+$', '') ELSE number END AS short FROM t),
    support AS (SELECT finding_id, severity, number, CASE WHEN {_found('q')} THEN 'in_quote' WHEN {_found('s')} THEN 'in_note_only' WHEN {adds_up_sql('CAST(number AS DOUBLE)', NUMBERS.format("coalesce(quote, '')"))} THEN 'derived_verified' ELSE 'unsupported' END AS tier FROM u)"""
ORACLE = {
    "quote_check": f"{F_} SELECT finding_id, {QUOTE_OK} AS quote_ok FROM findings",
    "numbers_with_units": f"""{F_}, t AS (SELECT finding_id, '$' || detail || ' and 5%' AS t FROM findings), p AS (SELECT finding_id, t, regexp_extract_all(t, '[0-9][0-9,]*(?:\\.[0-9]+)?') AS x, string_split_regex(t, '[0-9][0-9,]*(?:\\.[0-9]+)?') AS around FROM t),
        u AS (SELECT finding_id, unnest(range(len(x))) AS k, x, around FROM p)
        SELECT finding_id, k, CAST(replace(x[k + 1], ',', '') AS DOUBLE) AS value, CASE WHEN right(around[k + 1], 1) IN ('$', '€', '£') THEN right(around[k + 1], 1) WHEN left(around[k + 2], 1) = '%' THEN '%' ELSE '' END AS unit FROM u""",
    "select_observations": f"""{M}, o AS (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY rule_name, subject, period_end, cik) AS id, CASE subject {CATEGORY} END AS slot FROM observed WHERE accession_no IS NOT NULL),
        a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY accession_no, rule_name, slot ORDER BY {RANK}, id) <= 2), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY accession_no, rule_name ORDER BY {RANK}, id) <= 4)
        SELECT accession_no, id, rule_name, subject, severity FROM b QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY {RANK}, id) <= 8""",
    "select_findings": f"""{F_}, a AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY accession_no, category ORDER BY {RANK}, finding_id) <= 2)
        SELECT accession_no, finding_id, category, severity FROM a QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY {RANK}, finding_id) <= 8""",
    "sentence_reasons": f"""{VERIFIED} SELECT sentence_type, CASE WHEN drop_reason <> 'number does not verify' THEN drop_reason END AS reason, count(*) AS n FROM verified GROUP BY ALL""",
    "verify_sentences": f"{VERIFIED} SELECT accession_no, position, sentence_type, drop_reason FROM verified",
    "brief_drop_rates": f"{VERIFIED} SELECT brief_id, count(*) AS sentences, count(drop_reason) AS dropped, round(count(drop_reason) / count(*), 6) + 0.0 AS rate FROM verified GROUP BY 1",
    "brief_assembly": f"{VERIFIED} SELECT brief_id, position, row_number() OVER (PARTITION BY brief_id ORDER BY position) - 1 AS place FROM verified WHERE drop_reason IS NULL",
    "numeric_support": f"{SUPPORT} SELECT finding_id, number, tier FROM support",
    "numeric_support_by_severity": f"""{SUPPORT} SELECT severity, count(*) AS numbers, count(*) FILTER (tier = 'in_quote') AS in_quote, count(*) FILTER (tier = 'in_note_only') AS in_note, count(*) FILTER (tier IN ('derived_verified', 'unsupported')) AS others
        FROM support GROUP BY 1""",
    "evidence_blocks": f"""{F_} SELECT accession_no, coalesce(string_agg('- finding:' || finding_id || ' [' || severity || '] ' || headline, chr(10) ORDER BY finding_id) FILTER (severity <> 'low'), '(none)') AS block FROM findings GROUP BY 1""",
    "sampled_findings": f"{F_} SELECT finding_id, severity FROM findings ORDER BY sha256(CAST(finding_id AS VARCHAR) || '|7'), finding_id LIMIT 40",
    "support_by_version": f"""{SUPPORT} SELECT 'v' || (finding_id % 3) AS prompt_version, count(*) AS checked, count(*) FILTER (tier = 'in_quote') AS in_quote, count(*) FILTER (tier = 'in_note_only') AS in_note_only, count(*) FILTER (tier = 'derived_verified') AS derived_verified,
        count(DISTINCT finding_id) FILTER (tier = 'unsupported') AS findings_with_unsupported, round(count(*) FILTER (tier IN ('in_quote', 'in_note_only')) / count(*), 6) + 0.0 AS support_rate FROM support GROUP BY 1""",
    "evidence_view": f"""{FS}, r AS (SELECT brief_id, position, string_split(refs, ',') AS refs FROM sentences), x AS (SELECT brief_id, position, CAST(k AS INT) AS k, refs[k + 1] AS ref FROM (SELECT *, unnest(range(len(refs))) AS k FROM r))
        SELECT brief_id, position, k, ref, CASE WHEN regexp_matches(ref, '^finding:[0-9]+$') THEN 'finding' END AS kind, headline, severity FROM x LEFT JOIN (SELECT * FROM findings WHERE finding_id % 17 <> 3) f ON ref = 'finding:' || f.finding_id""",
    "number_units": r"""SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(t, '([$€£]?)[0-9][0-9,]*(\.[0-9]+)?(%?)'), lambda x: CASE WHEN substr(x, 1, 1) IN ('$', '€', '£') THEN substr(x, 1, 1) WHEN right(x, 1) = '%' THEN '%' ELSE '-' END), ''), '') AS units
        FROM (SELECT doc_id, '$5% $ 5 of €1,234.50 or 7 % and 8%. ' || text AS t FROM documents)""",
    "orphan_refs": f"""{FS}, r AS (SELECT brief_id, position, unnest(string_split(refs, ',')) AS ref FROM sentences)
        SELECT brief_id, position, ref, CASE WHEN regexp_matches(ref, '^(obs|finding):\\d+$') THEN 'unresolved' ELSE 'malformed' END AS problem FROM r WHERE ref NOT IN (SELECT 'finding:' || finding_id FROM findings)""",
    "cross_filing_refs": f"""{FS}, r AS (SELECT accession_no, position, unnest(string_split(refs, ',')) AS ref FROM sentences)
        SELECT r.accession_no, position, ref, f.accession_no AS owner FROM r JOIN findings f ON 'finding:' || (f.finding_id - 1) = r.ref WHERE f.accession_no <> r.accession_no""",
    "sentence_types": f"{FS} SELECT brief_id, position, sentence_type FROM sentences WHERE sentence_type = 'opinion'",
    "parse_responses": f"""{with_views('responses')}, j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS b FROM responses), k AS (SELECT *, json_type(b, '$.material') AS mt, json_type(b, '$.findings') AS ft, json_extract_string(b, '$.findings[*].category') AS c, json_extract_string(b, '$.findings[*].severity') AS s,
            json_extract_string(b, '$.findings[*].quote') AS q, json_array_length(b, '$.findings') AS nf FROM j),
        r AS (SELECT *, CASE WHEN b IS NULL THEN 'not an object' WHEN mt IS DISTINCT FROM 'BOOLEAN' THEN 'material is not boolean' WHEN ft IS DISTINCT FROM 'ARRAY' THEN 'findings is not a list' WHEN len(q) < nf THEN 'missing keys'
            WHEN len(list_filter(c, lambda x: x NOT IN ('red_flag', 'accounting_change', 'litigation', 'concentration', 'liquidity', 'note_item'))) > 0 THEN 'unknown category' WHEN len(list_filter(s, lambda x: x NOT IN ('high', 'medium', 'low'))) > 0 THEN 'unknown severity'
            WHEN len(list_filter(q, lambda x: trim(x) = '')) > 0 THEN 'empty quote' END AS invalid_reason FROM k)
        SELECT response_id, invalid_reason, CASE WHEN stop_reason = 'max_tokens' THEN 'truncated' WHEN invalid_reason IS NULL THEN 'ok' WHEN turn % 3 < 2 THEN 'retry' ELSE 'error' END AS outcome, CASE WHEN invalid_reason IS NULL THEN nf END AS findings FROM r""",
    "discard_rate": f"{F_} SELECT severity, count(*) AS returned, count(*) FILTER ({QUOTE_OK}) AS kept, round(1 - count(*) FILTER ({QUOTE_OK}) / count(*), 6) + 0.0 AS discarded FROM findings GROUP BY 1",
}
ORACLE["number_units_sql"] = ORACLE["number_units"]
DATED: dict[str, str] = {}
