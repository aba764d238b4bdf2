"""Rules over text sections: what was reworded, renamed, added, dropped, lengthened or made harder to read in a year.

A section is (section_id, company, form_type, fiscal_period, fiscal_year, accession_no, category, short_name, text).
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.text import complex_word_count, fog_index, sentence_count, word_count, wording
from factlens.operators.rules import COLUMNS
from factlens.registry import FLUCTUATING_NOTES, LENGTH_CHANGE, READABILITY_CHANGE, READABILITY_LEAST_WORDS, RENAME_SIMILARITY, RULES, WORDING_SIMILARITY
from factlens.storage import materialize

IDENTITY = ["company", "category", "short_name", "form_type", "fiscal_period"]
FILING = ["company", "form_type", "fiscal_period", "fiscal_year"]


def similarity(a: str, b: str, beyond: float = 0.0) -> float:
    """The matching-blocks ratio of two texts, order kept; zero as soon as an upper bound shows that it stays at ``beyond``."""
    matcher = difflib.SequenceMatcher(None, a, b)
    if matcher.real_quick_ratio() <= beyond or matcher.quick_ratio() <= beyond:
        return 0.0
    return matcher.ratio()


@F.pandas_udf(T.DoubleType())
def aligned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else similarity(x, y, -1.0) for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(now: Column, before: Column) -> Column:
    """The matching-blocks ratio of two columns of texts.

    Where one text begins with the other, the shorter is one matching block: of the longest runs that matching starts from,
    the first lies at the same place in both, and is extended over all of it. So only other pairs are aligned.
    """
    n, m = F.length(now), F.length(before)
    known = F.when(now.startswith(before) | before.startswith(now), F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / (n + m)))
    return F.coalesce(known, aligned(F.when(known.isNull(), now), F.when(known.isNull(), before)))


def similarity_beyond(threshold: float):
    """The similarity of two columns of texts; zero where it stays at the threshold."""

    @F.pandas_udf(T.DoubleType())
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([None if x is None or y is None else similarity(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def measured(sections: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Sections under their canonical names, with wording hash and counts, of one identity and year the last id.

    Texts end here: only counts and hashes are shuffled. Rules that compare wordings get them by id, from ``worded``.
    """
    text = F.coalesce("text", F.lit(""))
    sections = sections if aliases is None else canonical_names(sections, aliases)
    out = sections.withColumns({"wording_hash": F.sha2(wording(text), 256), "words": word_count(text), "sentences": sentence_count(text), "hard": complex_word_count(text)})
    out = out.withColumn("period_end", F.make_date("fiscal_year", F.lit(12), F.lit(31))).drop("text")
    last = Window.partitionBy(*IDENTITY, "fiscal_year").orderBy(F.desc("section_id"))
    return out.withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")


def worded(sections: DataFrame) -> DataFrame:
    """(section_id, wording) of sections with their texts."""
    return sections.select("section_id", wording(F.coalesce("text", F.lit(""))).alias("wording"))


def canonical_names(sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names replaced by what ``aliases(alias, canonical)`` calls them."""
    known = F.broadcast(aliases.select(F.col("alias").alias("short_name"), "canonical"))
    return sections.join(known, "short_name", "left").withColumn("short_name", F.coalesce("canonical", "short_name")).drop("canonical")


def with_year_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of a section and the same section a fiscal year before."""
    before = rows.select(*IDENTITY, (F.col("fiscal_year") + 1).alias("fiscal_year"), *[F.col(c).alias(f"prior_{c}") for c in columns])
    return rows.join(before, [*IDENTITY, "fiscal_year"])


def _observation(rule: str, statement: Column, refs: list[Column], subject: Column | str = "short_name") -> list[Column]:
    version, severity = RULES[rule]
    subject = F.col(subject) if isinstance(subject, str) else subject
    fixed = {"cik": F.col("company"), "rule_name": F.lit(rule), "rule_version": F.lit(version), "subject": subject, "severity": F.lit(severity), "statement": statement, "refs": F.array(*refs)}
    return [fixed[c].alias(c) if c in fixed else F.col(c) for c in COLUMNS]


def _refs() -> list[Column]:
    before = F.make_date(F.col("fiscal_year") - 1, F.lit(12), F.lit(31))
    return [F.struct(F.lit("sections").alias("kind"), F.col(c).alias("id"), day.alias("period_end")) for c, day in (("section_id", F.col("period_end")), ("prior_section_id", before))]


def length_change(rows: DataFrame) -> DataFrame:
    pairs = with_year_before(rows, ["section_id", "words"]).filter((F.col("words") > 0) & (F.col("prior_words") > 0))
    change = F.col("words") / F.col("prior_words") - 1
    statement = F.concat(F.lit("The "), F.col("short_name"), F.lit(" note changed in length by "), F.round(change * 100).cast("int").cast("string"), F.lit(" percent."))
    return pairs.filter(F.abs(change) > LENGTH_CHANGE).select(*_observation("section_length_change", statement, _refs()))


def readability_change(rows: DataFrame) -> DataFrame:
    pairs = with_year_before(rows, ["section_id", "words", "sentences", "hard"]).filter((F.col("words") >= READABILITY_LEAST_WORDS) & (F.col("prior_words") >= READABILITY_LEAST_WORDS))
    now, before = (fog_index(*[F.col(f"{p}{c}") for c in ("words", "sentences", "hard")]) for p in ("", "prior_"))
    statement = F.concat(F.lit("The fog index of the "), F.col("short_name"), F.lit(" note went from "), F.round(before, 1).cast("string"), F.lit(" to "), F.round(now, 1).cast("string"), F.lit("."))
    return pairs.filter((before > 0) & (F.abs(now / F.nullif(before, F.lit(0.0)) - 1) > READABILITY_CHANGE)).select(*_observation("readability_change", statement, _refs()))


def changed_pairs(rows: DataFrame) -> DataFrame:
    """Pairs a year apart whose wording hashes differ: what similarity is computed for."""
    return with_year_before(rows, ["section_id", "wording_hash"]).filter("wording_hash <> prior_wording_hash")


def with_wordings(pairs: DataFrame, words: DataFrame, now: str = "section_id", before: str = "prior_section_id") -> DataFrame:
    """Pairs with both wordings, by shuffles on the ids; only the texts of pairs move."""
    a, b = words.select(F.col("section_id").alias(now), "wording"), words.select(F.col("section_id").alias(before), F.col("wording").alias("prior_wording"))
    return pairs.join(a, now).join(b, before)


def wording_changed(rows: DataFrame, words: DataFrame, threshold: float = WORDING_SIMILARITY) -> DataFrame:
    pairs = with_wordings(changed_pairs(rows), words).withColumn("ratio", text_similarity(F.col("wording"), F.col("prior_wording"))).filter(F.col("ratio") < threshold)
    statement = F.concat(F.lit("The "), F.col("short_name"), F.lit(" note was reworded ("), F.round(F.col("ratio") * 100).cast("int").cast("string"), F.lit(" percent alike)."))
    return pairs.select(*_observation("section_wording_changed", statement, _refs()))


def presence_changes(rows: DataFrame, category: str = "Notes", fluctuating: tuple[str, ...] = FLUCTUATING_NOTES) -> DataFrame:
    """Names that appeared (kind a) or disappeared (kind d) against the year before, where both years have any.

    Names of notes that come and go by their nature are left out.
    """
    notes = rows.filter((F.col("category") == category) & ~F.col("short_name").isin(*fluctuating)).select(*FILING, "short_name", "section_id", "accession_no", "period_end")
    years = notes.select(*FILING).distinct()
    shifted = notes.withColumn("fiscal_year", F.col("fiscal_year") + 1)
    appeared = notes.join(years.withColumn("fiscal_year", F.col("fiscal_year") + 1), FILING, "left_semi").join(shifted.select(*FILING, "short_name"), [*FILING, "short_name"], "left_anti")
    current = notes.groupBy(*FILING).agg(F.min("accession_no").alias("accession_no"), F.min("period_end").alias("period_end"))
    gone = shifted.join(notes.select(*FILING, "short_name"), [*FILING, "short_name"], "left_anti").drop("accession_no", "period_end").join(current, FILING)
    return appeared.withColumn("kind", F.lit("a")).unionByName(gone.withColumn("kind", F.lit("d")))


def scored_renames(changes: DataFrame, words: DataFrame, boilerplate: tuple[str, ...] = (), threshold: float = RENAME_SIMILARITY) -> DataFrame:
    """Disappeared and appeared notes of the same filing whose texts are alike beyond the threshold, with their ratio.

    The ratio stays below the threshold where the lengths are too far apart, so only notes of the same or a neighbouring
    band of lengths meet; pairs are scored as rows, in whichever task they are.
    """
    step = math.log(2 / threshold - 1)  # of the longest over the shortest length that can reach the threshold
    rows = with_texts(changes.filter(~F.col("short_name").isin(*boilerplate)), words)
    rows = rows.withColumns({"n": F.length("wording"), "band": F.floor(F.log(F.length("wording") + 1.0) / step).cast("int")})
    new = rows.filter("kind = 'a'").select(*FILING, "accession_no", "period_end", "section_id", F.col("short_name").alias("new_name"), "wording", "n", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    old = rows.filter("kind = 'd'").select(*FILING, "band", F.col("section_id").alias("prior_section_id"), F.col("short_name").alias("old_name"), F.col("wording").alias("prior_wording"), F.col("n").alias("prior_n"))
    close = F.least("n", "prior_n") * 2 > threshold * (F.col("n") + F.col("prior_n"))
    pairs = new.join(old, [*FILING, "band"]).filter(close)
    ratio = similarity_beyond(threshold)(F.col("prior_wording"), F.col("wording"))
    return pairs.withColumn("ratio", ratio).filter(F.col("ratio") > threshold).select(*FILING, "accession_no", "period_end", "old_name", "new_name", "section_id", "prior_section_id", "ratio")


def with_texts(changes: DataFrame, words: DataFrame) -> DataFrame:
    return changes.join(words, "section_id")


def renames(changes: DataFrame, words: DataFrame, boilerplate: tuple[str, ...] = (), threshold: float = RENAME_SIMILARITY) -> DataFrame:
    """Disappeared names paired greedily, in order of name, with the most similar appeared one beyond the threshold."""
    return matched(scored_renames(changes, words, boilerplate, threshold))


def matched(scored: DataFrame) -> DataFrame:
    """The pairs that a walk over old names in order takes, each with the best new one left (of equal ones the first by name).

    In rounds over all filings at once: an old name takes its best new one if no old name before it can still come to
    that. The first old name that is left in a filing always can, so rounds end; a round takes what doesn't hang on others.
    """
    left, taken = materialize(scored, "scored"), None
    while True:
        best = F.min(F.struct((-F.col("ratio")).alias("less"), "new_name"))
        wish = left.groupBy(*FILING, "old_name").agg(best.alias("best")).select(*FILING, "old_name", F.col("best.new_name").alias("new_name"))
        first = left.groupBy(*FILING, "new_name").agg(F.min("old_name").alias("old_name"))
        sure = materialize(wish.join(first, [*FILING, "new_name", "old_name"]), "sure")
        rows = left.join(sure, [*FILING, "old_name", "new_name"], "left_semi")
        taken = rows if taken is None else taken.unionByName(rows)
        rest = left.join(sure.select(*FILING, "old_name"), [*FILING, "old_name"], "left_anti").join(sure.select(*FILING, "new_name"), [*FILING, "new_name"], "left_anti")
        left = materialize(rest, "left")
        if not left.limit(1).count():
            return taken.select(scored.columns)


def eligible_sections(rows: DataFrame, category: str = "Notes", fluctuating: tuple[str, ...] = FLUCTUATING_NOTES) -> DataFrame:
    """How often each section rule could have fired, by company: pairs a year apart with what the rule needs, and for notes that
    came or went every name of either year where both years have any."""
    pairs = with_year_before(rows, ["words"])
    long_enough = (F.col("words") >= READABILITY_LEAST_WORDS) & (F.col("prior_words") >= READABILITY_LEAST_WORDS)
    counts = pairs.groupBy("company").agg(
        F.count("*").alias("section_wording_changed"),
        F.count_if((F.col("words") > 0) & (F.col("prior_words") > 0)).alias("section_length_change"),
        F.count_if(long_enough).alias("readability_change"),
    )
    notes = rows.filter((F.col("category") == category) & ~F.col("short_name").isin(*fluctuating)).select(*FILING, "short_name").distinct()
    shifted = notes.withColumn("fiscal_year", F.col("fiscal_year") + 1)
    both = notes.select(*FILING).distinct().join(shifted.select(*FILING).distinct(), FILING, "left_semi")
    names = notes.unionByName(shifted).distinct().join(both, FILING, "left_semi").groupBy("company").agg(F.count("*").alias("section_appeared"))
    out = counts.join(names, "company", "full_outer").withColumn("section_disappeared", F.col("section_appeared"))
    rules = ["section_wording_changed", "section_length_change", "readability_change", "section_appeared", "section_disappeared"]
    return out.withColumnRenamed("company", "cik").na.fill(0, rules).unpivot("cik", rules, "rule_name", "eligible")


def renamed(found: DataFrame) -> DataFrame:
    statement = F.concat(F.lit("The "), F.col("old_name"), F.lit(" note seems to be "), F.col("new_name"), F.lit(" now."))
    return found.select(*_observation("section_renamed", statement, _refs(), F.concat_ws(" -> ", "old_name", "new_name")))


def appeared_or_gone(changes: DataFrame, found: DataFrame | None, kind: str) -> DataFrame:
    """Appeared (a) or disappeared (d) notes that weren't renamed."""
    rule, words = ("section_appeared", " note is new this year.") if kind == "a" else ("section_disappeared", " note is gone this year.")
    own = changes.filter(F.col("kind") == kind)
    if found is not None:
        own = own.join(found.select(*FILING, F.col("new_name" if kind == "a" else "old_name").alias("short_name")), [*FILING, "short_name"], "left_anti")
    refs = [F.struct(F.lit("sections").alias("kind"), F.col("section_id").alias("id"), F.col("period_end").alias("period_end"))]
    return own.select(*_observation(rule, F.concat(F.lit("The "), F.col("short_name"), F.lit(words)), refs))
