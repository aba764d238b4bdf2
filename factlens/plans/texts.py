"""Queries over texts and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.bindings import table, view, with_views
from factlens.functions import text as t
from factlens.operators import sections as s
from factlens.operators import sinks
from factlens.operators.stores import ContentStore
from factlens.plans.common import once, rounded
from factlens.sources import pages as p
from factlens.storage import scratch_path, tasks_for


#: Names that notes went by since, and names of notes taken for such as come and go.
ALIASES = {f"Renamed {k}": f"Note {k}" for k in (8, 13, 52, 65, 99)}
FLUCTUATING = ("Note 91", "Renamed 91", "Note 104", "Renamed 104")


#: Documents that a task is dealt.
DOCUMENTS_A_TASK = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt out by id: a scan gives a task a whole row group, and what is done with a text takes longer than moving it."""
    docs = table(spark, sf_dir, "documents")
    return docs.repartition(tasks_for(docs, DOCUMENTS_A_TASK), "doc_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sections", {"documents": documents(spark, sf_dir)})


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(list(ALIASES.items()), "alias string, canonical string")
    return once(spark, sf_dir, "sections", lambda: s.measured(sections(spark, sf_dir), aliases))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.worded(sections(spark, sf_dir))


#: Note names taken for boilerplate, which are never renamed.
BOILERPLATE = ("Note 26", "Renamed 26", "Note 39", "Renamed 39")


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", t.word_count(text).cast("long").alias("words"), t.sentence_count(text).cast("long").alias("sentences"), t.complex_word_count(text).cast("long").alias("hard"))


def fog(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text_counts(spark, sf_dir)
    return counts.select("doc_id", rounded(t.fog_index(F.col("words"), F.col("sentences"), F.col("hard"))).alias("fog"))


def wording_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.content_hash(F.col("text")).alias("text_hash"), t.wording_hash(F.col("text")).alias("wording_hash"))


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.numeric_tokens(F.col("text")), "|").alias("numbers"))


def lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents and turns hold words that state a cause or predict, by table."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text").unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.concat("text", F.lit(" It will fall due to rain.")).alias("text")))
    return d.groupBy("source").agg(F.count_if(t.has_cause(F.col("text"))).alias("causes"), F.count_if(t.has_prediction(F.col("text"))).alias("predictions"), F.count("*").alias("n"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    prompt = t.render("Company %%COMPANY%%: %%NOTE%%", company=F.col("source"), note=F.col("text"))
    return d.select("doc_id", t.estimate_tokens(F.col("text")).cast("long").alias("tokens"), t.input_hash(F.lit("model-a"), F.lit("v1"), prompt).alias("input_hash"))


def section_rule(rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rule(rows(spark, sf_dir))
        return found.select("cik", "accession_no", "period_end", "rule_name", "subject", "severity")

    return query


def rule_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.wording_changed(rows(spark, sf_dir), words(spark, sf_dir)).select("cik", "accession_no", "period_end", "rule_name", "subject", "severity")


def rule_wording_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.changed_pairs(rows(spark, sf_dir)).select("section_id", "prior_section_id")


def rule_appeared_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that came or went, before renames are taken out."""
    return s.presence_changes(rows(spark, sf_dir), fluctuating=FLUCTUATING).select("company", "fiscal_year", "short_name", "kind")


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    changes = once(spark, sf_dir, "changes", lambda: s.presence_changes(rows(spark, sf_dir), fluctuating=FLUCTUATING))
    return changes, once(spark, sf_dir, "renames", lambda: s.renames(changes, words(spark, sf_dir), BOILERPLATE))


def rule_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.renamed(found(spark, sf_dir)[1]).select("cik", "accession_no", "period_end", "rule_name", "subject", "severity")


def rule_appeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.appeared_or_gone(*found(spark, sf_dir), "a").select("cik", "accession_no", "period_end", "rule_name", "subject", "severity")


def rule_disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.appeared_or_gone(*found(spark, sf_dir), "d").select("cik", "accession_no", "period_end", "rule_name", "subject", "severity")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.with_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored copy of each text, with how many documents share it."""
    return sinks.content_copies(table(spark, sf_dir, "documents"), "doc_id").select("text_hash", "first_id", "copies")


def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents loaded into a content store, half of them before: each text once, with how many documents refer to it."""
    docs, store = table(spark, sf_dir, "documents").select("doc_id", "text"), ContentStore(spark, scratch_path(spark, "contents"))
    store.add(docs.filter("doc_id % 2 = 0"))
    refs = store.add(docs).filter("text_hash is not null").groupBy("text_hash").agg(F.count("*").alias("copies"))
    return store.read().select("text_hash", F.length("text").cast("long").alias("n_chars")).join(refs, "text_hash")


def hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored hash (here wrong or missing for some) isn't that of their text."""
    d = table(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 50 == 7, F.sha2(F.reverse("text"), 256)).when(F.col("doc_id") % 50 == 9, F.lit(None)).otherwise(F.sha2("text", 256))
    return sinks.hash_mismatches(d.withColumn("text_hash", stored)).select("doc_id", "problem")


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer snapshot of customers against the older one: what is inserted, updated and the same."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = c.filter("c_custkey % 7 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    found = sinks.upsert_changed(old, c, ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])
    return found.select("c_custkey", rounded("c_acctbal", 2).alias("c_acctbal"), F.col("_change").alias("change"))


QUERIES = {"rule_length": section_rule(s.length_change), "rule_readability": section_rule(s.readability_change)} | {
    q.__name__: q
    for q in (text_counts, fog, wording_hash, numeric_tokens, lexicons, token_estimates, rule_wording, rule_wording_pairs, rule_appeared_all, rule_renamed, rule_appeared, rule_disappeared, html_text, dedup_content, content_store, hash_integrity, upsert_changes)
}

WORD = "[A-Za-z]+(?:[''-][A-Za-z]+)*"
COUNTS = f"""len(regexp_extract_all(text, '{WORD}')) AS words,
    CASE WHEN len(regexp_extract_all(text, '{WORD}')) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(text, '(\\s)', '\\1\\1', 'g'), '(?:^|[^0-9])[.!?]+(?:\\s|$)'))) END AS sentences,
    len(list_filter(list_transform(regexp_extract_all(lower(text), '{WORD.replace('A-Z', '')}'), lambda x: regexp_replace(x, '[^a-z]', '', 'g')), lambda w:
        len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END >= 3)) AS hard"""
MASK = "regexp_replace(regexp_replace(text, '\\Av\\d+(?:\\.\\d+)+[ \\t]*\\n?', ''), '\\d[\\d,]*\\.?\\d*', '<NUM>', 'g')"
NAMED = f"""{with_views('sections')}, named AS (SELECT * REPLACE (CASE short_name {' '.join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items())} ELSE short_name END AS short_name) FROM sections),
notes AS (SELECT * FROM named WHERE category = 'Notes' AND short_name NOT IN {FLUCTUATING})"""
S = f"""{NAMED}, m AS (SELECT *, {COUNTS}, {MASK} AS wording, sha256({MASK}) AS wording_hash FROM named),
pairs AS (SELECT a.*, b.section_id AS prior_section_id, b.wording AS prior_wording, b.words AS prior_words, b.sentences AS prior_sentences, b.hard AS prior_hard, b.wording_hash AS prior_hash FROM m a
    JOIN m b ON a.company = b.company AND a.category = b.category AND a.short_name = b.short_name AND a.fiscal_year = b.fiscal_year + 1)"""


def _fired(rule: str, severity: str, where: str) -> str:
    return f"{S} SELECT company AS cik, accession_no, CAST(make_date(fiscal_year, 12, 31) AS VARCHAR) AS period_end, '{rule}' AS rule_name, short_name AS subject, '{severity}' AS severity FROM pairs WHERE {where}"


FOG, FOG_BEFORE = "0.4 * (words / nullif(sentences, 0) + 100 * hard / nullif(words, 0))", "0.4 * (prior_words / nullif(prior_sentences, 0) + 100 * prior_hard / nullif(prior_words, 0))"
#: The ratio of wordings of which one begins with the other, as all pairs of the view do.
PREFIX_RATIO = "2.0 * least(length(wording), length(prior_wording)) / (length(wording) + length(prior_wording))"
ORACLE = {
    "text_counts": f"SELECT doc_id, {COUNTS} FROM documents",
    "fog": f"SELECT doc_id, CASE WHEN words > 0 AND sentences > 0 THEN round({FOG}, 6) + 0.0 END AS fog FROM (SELECT doc_id, {COUNTS} FROM documents)",
    "wording_hash": f"SELECT doc_id, sha256(text) AS text_hash, sha256({MASK}) AS wording_hash FROM documents",
    "numeric_tokens": r"""SELECT doc_id, coalesce(n, '') AS numbers FROM (SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]), '|') AS n
        FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda v: replace(v, ',', '')) AS x FROM documents))""",
    "lexicons": r"""WITH d AS (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'benchmark', text || ' It will fall due to rain.' FROM benchmark)
        SELECT source, count(*) FILTER (regexp_matches(text, '(?i)\b(?:because|due to|driven by|as a result of|caused by|owing to|reflecting|attributable to|stemming from)\b')) AS causes,
               count(*) FILTER (regexp_matches(text, '(?i)\b(?:will|expects|likely|suggests|indicates|points to|implies)\b')) AS predictions, count(*) AS n FROM d GROUP BY 1""",
    "token_estimates": "SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4, 0) AS BIGINT)) AS tokens, sha256('model-a|v1|Company ' || source || ': ' || text) AS input_hash FROM documents",
    "rule_length": _fired("section_length_change", "medium", "words > 0 AND prior_words > 0 AND abs(words / prior_words - 1) > 0.25"),
    "rule_readability": _fired("readability_change", "low", f"words >= 50 AND prior_words >= 50 AND {FOG_BEFORE} > 0 AND abs(({FOG}) / ({FOG_BEFORE}) - 1) > 0.15"),
    "rule_wording": _fired("section_wording_changed", "high", f"wording_hash <> prior_hash AND {PREFIX_RATIO} < 0.60"),
    "rule_wording_pairs": f"{S} SELECT section_id, prior_section_id FROM pairs WHERE wording_hash <> prior_hash",
    "rule_appeared_all": f"""{NAMED}, n AS (SELECT company, fiscal_year, short_name FROM notes), y AS (SELECT DISTINCT company, fiscal_year FROM n)
        SELECT company, fiscal_year, short_name, 'a' AS kind FROM n WHERE (company, fiscal_year - 1) IN (SELECT (company, fiscal_year) FROM y) AND (company, fiscal_year - 1, short_name) NOT IN (SELECT (company, fiscal_year, short_name) FROM n)
        UNION ALL SELECT company, fiscal_year + 1, short_name, 'd' FROM n WHERE (company, fiscal_year + 1) IN (SELECT (company, fiscal_year) FROM y) AND (company, fiscal_year + 1, short_name) NOT IN (SELECT (company, fiscal_year, short_name) FROM n)""",
    "dedup_content": "SELECT sha256(text) AS text_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "content_store": "SELECT sha256(text) AS text_hash, length(text) AS n_chars, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "hash_integrity": "SELECT doc_id, CASE WHEN doc_id % 50 = 9 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 50 = 9 OR (doc_id % 50 = 7 AND text <> reverse(text))",
    "upsert_changes": """SELECT c_custkey, round(c_acctbal, 2) + 0.0 AS c_acctbal, CASE WHEN c_custkey % 7 = 3 THEN 'insert' WHEN c_custkey % 5 = 0 THEN 'update' ELSE 'same' END AS change FROM customer""",
}
DATED: dict[str, str] = {}
