"""Runs over sections and filings: candidates, requests, attempts, ingestion of findings, and what a run came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.text import estimate_tokens, quote_holds
from factlens.operators.sections import canonical_names


def fiscal_label(year: Column, period: Column) -> Column:
    """FY2025, or Q2 FY2026; words where either part is unknown."""
    whole = F.concat(F.lit("FY"), year.cast("string"))
    return F.when(year.isNull() | period.isNull(), "unknown fiscal period").when(period == "FY", whole).otherwise(F.concat(period, F.lit(" "), whole))


def plain_accession(accession: Column) -> Column:
    """An accession number without its dashes."""
    return F.replace(accession, F.lit("-"), F.lit(""))


def plain_company(cik: Column) -> Column:
    """A company number without leading zeros."""
    return F.ltrim(cik, F.lit("0"))


def candidate_sections(sections: DataFrame, start: str, boilerplate: DataFrame, aliases: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q"), category: str = "Notes") -> DataFrame:
    """Notes of annual and quarterly filings from ``start`` on whose canonical name isn't boilerplate (short_name); names are
    judged by what they are called now, and come back as they are."""
    rows = sections.filter(F.col("form_type").isin(*forms) & (F.col("category") == category) & (F.col("filing_date") >= F.lit(start).cast("date")))
    named = canonical_names(rows.withColumn("own_name", F.col("short_name")), aliases)
    kept = named.join(F.broadcast(boilerplate.select("short_name").distinct()), "short_name", "left_anti")  # a row a registered name
    return kept.withColumn("short_name", F.col("own_name")).drop("own_name")


def candidate_filings(filings: DataFrame, start: str, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """Annual and quarterly filings from ``start`` on, with the text of their fiscal label."""
    rows = filings.filter(F.col("form_type").isin(*forms) & (F.col("filing_date") >= F.lit(start).cast("date")))
    return rows.withColumn("label", fiscal_label(F.col("fiscal_year"), F.col("fiscal_period")))


def requests(rows: DataFrame, prompt: Column, cache: DataFrame, most_tokens: int) -> DataFrame:
    """Each row's request: input hash of the prompt, estimated tokens, and status: cached, oversize (skipped, never cut) or new."""
    out = rows.withColumns({"input_hash": F.sha2(prompt, 256), "tokens": estimate_tokens(prompt)})
    known = cache.select("input_hash").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "cached").when(F.col("tokens") > most_tokens, "oversize").otherwise("new")
    return out.join(known, "input_hash", "left").withColumn("status", status).drop("known")


def cache_impact(wanted: DataFrame, answered: DataFrame, version: str) -> DataFrame:
    """For each prompt: requests that are answered in this version, new ones, those of the new that an earlier version had
    answered (a bump made them void), what those had cost, and the earlier versions.

    ``wanted`` has prompt_name and section_id, ``answered`` these, prompt_version and cost_usd.
    """
    keys = ["prompt_name", "section_id"]
    past = answered.groupBy(*keys).agg(F.bool_or(F.col("prompt_version") == version).alias("hit"), F.sum(F.when(F.col("prompt_version") != version, F.col("cost_usd"))).alias("void_cost"), F.array_sort(F.collect_set(F.when(F.col("prompt_version") != version, F.col("prompt_version")))).alias("before"))
    rows = wanted.select(*keys).distinct().join(past, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    void = ~F.col("hit") & (F.coalesce(F.size("before"), F.lit(0)) > 0)
    return rows.groupBy("prompt_name").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("new_calls"),
        F.count_if(void).alias("invalidated"),
        F.coalesce(F.sum(F.when(void, F.col("void_cost"))), F.lit(0.0)).alias("void_cost"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(void, F.col("before")))))), ",").alias("versions"),
    )


def billed_attempts(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """One ledger row an attempt that was answered: ok or error, with the cost of its real tokens at the model's price.

    ``attempts`` has request_id, attempt, model, input_tokens, output_tokens and answered; ``prices`` (model, input_price,
    output_price) a row a model.
    """
    rows = attempts.join(F.broadcast(prices.select("model", "input_price", "output_price")), "model", "left")  # a row a model
    cost = F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price")
    return rows.select("request_id", "attempt", "model", F.when(F.col("answered"), "ok").otherwise("error").alias("status"), "input_tokens", "output_tokens", cost.alias("cost_usd"))


def ingested(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings of well-formed responses whose quote stands in the source text.

    ``parsed`` is what ``parse_responses`` gives, ``sources`` has response_id and source_text. Returns response_id, the
    finding's place and fields, and whether it is kept.
    """
    fresh = parsed.filter("invalid_reason is null and stop_reason <> 'max_tokens'").select("response_id", F.posexplode("parsed.findings").alias("place", "f"))
    rows = fresh.join(sources, "response_id")
    return rows.select("response_id", "place", "f.category", "f.severity", "f.headline", quote_holds(F.col("f.quote"), F.col("source_text")).alias("kept"))


def discard_rates(analyses: DataFrame, kept: DataFrame) -> DataFrame:
    """By prompt version, findings that responses returned and that were kept, and the share discarded (zero where none came).

    ``analyses`` has id, prompt_version and output_json, of which the list of findings is counted, whether or not they hold;
    ``kept`` has the analysis_id of every stored finding.
    """
    stored = kept.groupBy(F.col("analysis_id").alias("id")).agg(F.count("*").alias("kept"))
    returned = F.coalesce(F.json_array_length(F.get_json_object("output_json", "$.findings")), F.lit(0)).cast("long")
    rows = analyses.select("id", "prompt_version", returned.alias("returned")).join(stored, "id", "left").na.fill(0, ["kept"])
    totals = rows.groupBy("prompt_version").agg(F.sum("returned").alias("returned"), F.sum("kept").alias("kept"))
    gone = F.col("returned") - F.col("kept")
    return totals.withColumns({"discarded": gone, "discard_rate": F.coalesce(F.try_divide(gone, "returned"), F.lit(0.0))})


def support_rates(tiers: DataFrame, versions: DataFrame) -> DataFrame:
    """By prompt version, numbers of findings by where they are found, and how many findings have one that nothing supports.

    ``tiers`` is what ``numeric_support`` gives, ``versions`` has finding_id and prompt_version.
    """
    n = {t: F.count_if(F.col("tier") == t) for t in ("in_quote", "in_note_only", "derived_verified")}
    rows = tiers.join(versions, "finding_id").groupBy("prompt_version").agg(
        F.count("*").alias("checked"), *[c.alias(t) for t, c in n.items()], F.count_distinct(F.when(F.col("tier") == "unsupported", F.col("finding_id"))).alias("findings_with_unsupported")
    )
    return rows.withColumn("support_rate", F.try_divide(F.col("in_quote") + F.col("in_note_only"), "checked"))


def run_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, cost, shares of those that went well and were refused, and the mean cost of the billed ones; null where there are none."""
    n, billed = F.count("*"), F.count_if(F.col("status").isin("ok", "error"))
    return rows.groupBy(*keys).agg(
        n.alias("calls"),
        F.sum("cost_usd").alias("cost"),
        F.try_divide(F.count_if(F.col("status") == "ok"), billed).alias("ok_rate"),
        F.try_divide(F.count_if(F.col("status") == "refused"), n).alias("refused_rate"),
        F.try_divide(F.sum(F.when(F.col("status").isin("ok", "error"), F.col("cost_usd"))), billed).alias("mean_cost"),
    )


def with_examples(rows: DataFrame, keys: list[str], bad: Column, example: Column, most: int = 5) -> DataFrame:
    """By ``keys``: rows, bad ones, their share, and the first ``most`` examples in order.

    Only the first examples of each group are gathered: their rank is taken among the bad rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_example"))
    first = rows.filter(bad).select(*keys, example.alias("_example")).withColumn("_place", place).filter(F.col("_place") <= most)
    shown = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_example")), " | ").alias("examples"))
    return counts.join(shown, keys, "left").withColumn("rate", F.try_divide("bad", "n"))
