"""Checks of extracted findings and narrative sentences against the texts that they cite, and of responses' shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.text import NUMBER, bounded_numbers, has_cause, has_prediction, number_among, numbers_with_units, numeric_tokens, ordinals_as_digits, quote_holds
from factlens.registry import FINDING_CATEGORIES, SENTENCE_TYPES, SEVERITIES

MOST_ADDENDS = 20
RESPONSE = "struct<material:string,findings:array<struct<category:string,severity:string,headline:string,detail:string,quote:string>>>"


def adds_up(target: float, values: list[float], tolerance: float = 1e-6) -> bool:
    """Whether two or more of at most MOST_ADDENDS values add up to the target; sums of one half meet those of the other."""
    if not 2 <= len(values) <= MOST_ADDENDS:
        return False
    halves = []
    for part in (values[::2], values[1::2]):
        sums, counts = np.zeros(1), np.zeros(1, int)
        for v in part:
            sums, counts = np.r_[sums, sums + v], np.r_[counts, counts + 1]
        halves.append((sums, np.minimum(counts, 2)))
    (left, taken), (right, given) = halves
    for n in range(3):
        own, other = target - left[taken == n], np.sort(right[given >= 2 - n])
        if (np.searchsorted(other, own + tolerance, "right") > np.searchsorted(other, own - tolerance, "left")).any():
            return True
    return False


@F.pandas_udf(T.BooleanType())
def is_sum(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for targets, values in parts:
        yield pd.Series([t is not None and v is not None and adds_up(t, [float(x) for x in v if x is not None]) for t, v in zip(targets, values, strict=True)], dtype=bool)


def check_quotes(findings: DataFrame) -> DataFrame:
    return findings.withColumn("quote_ok", quote_holds(F.col("quote"), F.col("source_text")))


def numeric_support(findings: DataFrame) -> DataFrame:
    """A row a number of each finding's headline and detail, with where it is found: in the quote, in the note, as a sum, nowhere.

    The numbers that stand on their own are taken out of quote and note once, before the finding's numbers meet them.
    """
    sets = {f"in_{k}": bounded_numbers(ordinals_as_digits(F.coalesce(c, F.lit("")))) for k, c in (("quote", F.col("quote")), ("note", F.col("source_text")))}
    quoted = F.transform(F.regexp_extract_all("quote", F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    scanned = findings.select("finding_id", "headline", "detail", F.coalesce("quote", F.lit("")).alias("quote"), "source_text").withColumns(sets | {"quoted": quoted})
    rows = scanned.select("finding_id", "in_quote", "in_note", "quoted", F.explode(numeric_tokens(F.concat_ws(" ", "headline", "detail"))).alias("number"))
    found = rows.withColumns({c: number_among(F.col("number"), F.col(c)) for c in sets})
    open_ = ~F.col("in_quote") & ~F.col("in_note")
    derived = F.when(open_, is_sum(F.when(open_, F.col("number").cast("double")), F.when(open_, F.col("quoted"))))
    tier = F.when(F.col("in_quote"), "in_quote").when(F.col("in_note"), "in_note_only").when(derived, "derived_verified").otherwise("unsupported")
    return found.select("finding_id", "number", tier.alias("tier"))


def source_text(kind: str) -> Column:
    """What a reference's sentence may rest on."""
    return F.col("statement") if kind == "obs" else F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("headline", "detail", "quote")])


def resolve_refs(sentences: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sentences with the texts of the references that were supplied for their filing (accession_no, ref, source); repeats count."""
    refs = sentences.select("accession_no", "position", F.posexplode(F.split("refs", ",")).alias("k", "ref"))
    found = refs.join(evidence.select("accession_no", "ref", "source"), ["accession_no", "ref"])
    texts = found.groupBy("accession_no", "position").agg(F.array_sort(F.collect_list(F.struct("k", "source"))).alias("found"))
    return sentences.join(texts, ["accession_no", "position"], "left").withColumn("sources", F.coalesce(F.col("found.source"), F.array().cast("array<string>"))).drop("found")


def verify_sentences(resolved: DataFrame) -> DataFrame:
    """The first reason to drop a sentence, or null: type, text, references, prediction, then what its type asks for."""
    text, n = F.col("text"), F.size("sources")
    cause = has_cause(text)
    numbers = F.transform(F.array_distinct(numbers_with_units(text)), lambda x: x["value"])
    given = F.flatten(F.transform("sources", numbers_with_units))
    rows = resolved.withColumns({"numbers": numbers, "given": given})
    missing = F.filter("numbers", lambda v: ~F.exists(F.col("given"), lambda g: F.abs(g["value"] - v) < 1e-6))
    rows = rows.withColumn("missing", missing)
    keys = ["accession_no", "position"]
    todo = rows.filter((F.col("sentence_type") == "aggregation") & (F.size("missing") > 0)).select(*keys, "given", F.explode("missing").alias("target"))
    by_unit = todo.select(*keys, "target", F.inline("given")).groupBy(*keys, "target", "unit").agg(F.collect_list("value").alias("values"))
    sums = by_unit.withColumn("ok", is_sum("target", "values")).groupBy(*keys, "target").agg(F.bool_or("ok").alias("ok"))
    unproven = sums.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("unproven"))
    rows = rows.join(unproven, keys, "left").withColumn("unproven", F.coalesce("unproven", F.when(F.col("sentence_type") == "aggregation", F.size("missing")).otherwise(0)))
    kind = F.col("sentence_type")

    def when(type_: str, bad: Column, reason: str) -> Column:
        return F.when((kind == type_) & bad, reason)

    reason = F.coalesce(
        F.when(~F.coalesce(kind.isin(*SENTENCE_TYPES), F.lit(False)), "unrecognised type"),
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "missing or empty text"),
        F.when(n == 0, "zero resolving references"),
        F.when(has_prediction(text), "predictive language"),
        when("restatement", n != 1, "not exactly one reference"),
        when("juxtaposition", n < 2, "fewer than two references"),
        when("grouping", n < 2, "fewer than two references"),
        F.when(kind.isin("restatement", "juxtaposition", "grouping") & cause, "states a cause"),
        when("aggregation", F.col("unproven") > 0, "number does not verify"),
        when("grouping", F.size("missing") > 0, "number not in sources"),
        when("sourced_causal", ~F.exists("sources", has_cause), "no source states a cause"),
    )
    return rows.select(*keys, "brief_id", "sentence_type", "text", reason.alias("drop_reason"))


def assemble(verified: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Kept sentences of each brief, renumbered from 0; with ``verdicts`` (brief_id, position, verdict) only supported ones."""
    kept = verified.filter("drop_reason is null")
    if verdicts is not None:
        kept = kept.join(verdicts.select("brief_id", "position", "verdict"), ["brief_id", "position"], "left").filter(F.coalesce("verdict", F.lit("unsupported")) == "supported")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("brief_id").orderBy("position")) - 1)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with their findings and the first violation of the expected shape, or null."""
    body = F.from_json("body", RESPONSE)
    rows = responses.withColumn("parsed", body)
    whole = F.schema_of_variant(F.try_parse_json("body"))
    material = F.try_variant_get(F.try_parse_json("body"), "$.material", "boolean")
    is_boolean = F.coalesce(F.regexp_like("body", F.lit(r'"material"\s*:\s*(true|false)')), F.lit(False)) & material.isNotNull()
    findings = F.col("parsed.findings")

    def bad(test) -> Column:
        return F.coalesce(F.exists(findings, test), F.lit(False))

    reason = F.coalesce(
        F.when(F.try_parse_json("body").isNull() | ~F.coalesce(whole.startswith("OBJECT"), F.lit(False)), "not an object"),
        F.when(~is_boolean, "material is not boolean"),
        F.when(findings.isNull(), "findings is not a list"),
        F.when(bad(lambda f: f["category"].isNull() | f["severity"].isNull() | f["headline"].isNull() | f["detail"].isNull() | f["quote"].isNull()), "missing keys"),
        F.when(bad(lambda f: ~f["category"].isin(*FINDING_CATEGORIES)), "unknown category"),
        F.when(bad(lambda f: ~f["severity"].isin(*SEVERITIES)), "unknown severity"),
        F.when(bad(lambda f: F.length(F.trim(f["quote"])) == 0), "empty quote"),
    )
    return rows.withColumn("invalid_reason", reason)


def outcome(parsed: DataFrame, most_attempts: int = 2) -> Column:
    """ok; truncated by its stop reason, whatever it parses to; retry while attempts are left; else error."""
    return F.when(F.col("stop_reason") == "max_tokens", "truncated").when(F.col("invalid_reason").isNull(), "ok").when(F.col("attempt") < most_attempts, "retry").otherwise("error")
