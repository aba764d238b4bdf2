"""Text functions as column expressions: counts, readability, hashes, numbers and lexicons. No Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.registry import CAUSAL, ORDINALS, PREDICTIVE, QUOTE_LEAST

WORD = r"[A-Za-z]+(?:['-][A-Za-z]+)*"
SENTENCE_END = r"(?<!\d)[.!?]+(?=\s|$)"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
VERSION_LINE = r"\Av\d+(?:\.\d+)+[ \t]*\n?"
# Typographic characters and what they become (quotes, dashes, spaces).
TYPOGRAPHIC = ("‘’“”–—   ", "''\"\"--   ")
ZERO_WIDTH = "[​‌‍﻿]"


def normalize_inline(text: Column) -> Column:
    """Plain quotes, dashes and spaces, no zero-width characters, runs of white space as one space."""
    plain = F.regexp_replace(F.translate(text, *TYPOGRAPHIC), ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentence_count(text: Column) -> Column:
    """Sentence ends; at least one if there is any word, none without."""
    return F.when(word_count(text) > 0, F.greatest(F.regexp_count(text, F.lit(SENTENCE_END)), F.lit(1))).otherwise(0)


def syllable_count(word: Column) -> Column:
    """Vowel groups of the letters, less a final e, plus one for a final consonant and le; at least one."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = letters.endswith("e") & (groups > 1)
    return F.greatest(groups - silent.cast("int") + letters.rlike("[^aeiouy]le$").cast("int"), F.lit(1))


def complex_word_count(text: Column) -> Column:
    """Words of three syllables or more, by one pattern over the whole text.

    Four vowel groups always give three syllables; three do unless the last letter is an e that isn't after a consonant and l.
    """
    letters = F.regexp_replace(F.lower(text), "(?<=[a-z])['’-](?=[a-z])" if "’" in WORD else "(?<=[a-z])['-](?=[a-z])", "")
    consonant, vowels = "[b-df-hj-np-tv-xz]", "[aeiouy]++"
    group = f"{consonant}*+{vowels}"
    return F.regexp_count(letters, F.lit(f"(?<![a-z])(?:(?:{group}){{4}}[a-z]*+|(?:{group}){{3}}{consonant}*+(?:(?<!e)|(?<={consonant}le)))"))


def fog_index(words: Column, sentences: Column, hard: Column) -> Column:
    return F.when((words > 0) & (sentences > 0), 0.4 * (words / F.nullif(sentences, F.lit(0)) + 100 * hard / F.nullif(words, F.lit(0))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def wording(text: Column) -> Column:
    """The text without a leading version line, every number masked."""
    return F.regexp_replace(F.regexp_replace(text, VERSION_LINE, ""), r"\d[\d,]*\.?\d*", "<NUM>")


def wording_hash(text: Column) -> Column:
    return F.sha2(wording(text), 256)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quote_holds(quote: Column, source: Column, least: int = QUOTE_LEAST) -> Column:
    """A quote of enough characters that the source contains, white space aside."""
    return F.coalesce((F.length(F.trim(quote)) >= least) & F.contains(collapse(source), collapse(quote)), F.lit(False))


def numeric_tokens(text: Column) -> Column:
    """Distinct numbers in order, without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def ordinals_as_digits(text: Column) -> Column:
    """Words for ordinals as digits; texts without any stay as they are."""
    out = text
    for k, word in enumerate(ORDINALS, 1):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", str(k))
    return F.when(F.rlike(text, F.lit(rf"(?i)\b(?:{'|'.join(ORDINALS)})\b")), out).otherwise(text)


def bounded_numbers(text: Column) -> Column:
    """The distinct numbers that stand on their own in a text, without thousands separators.

    Of a run of digits and points that starts with a digit that is at most one: what it starts with, unless more digits
    follow after a second point.
    """
    return F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(?<![\d.])\d++(?:\.\d++)?+(?!\.\d)"), F.lit(0)))


def number_among(number: Column, numbers: Column) -> Column:
    """Whether ``bounded_numbers`` have a number, also without zeros that end its decimal part."""
    short = F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
    return F.array_contains(numbers, number) | F.array_contains(numbers, short)


def number_in(number: Column, source: Column) -> Column:
    """Whether a number stands in the source on its own, also without zeros that end its decimal part."""
    return number_among(number, bounded_numbers(source))


def numbers_with_units(text: Column) -> Column:
    """Values with the currency sign right before them, else the percent sign right after them, else no unit."""
    found = F.regexp_extract_all(text, F.lit(rf"[$€£]?{NUMBER}%?"), F.lit(0))

    def one(x: Column) -> Column:
        unit = F.when(x.rlike("^[$€£]"), F.left(x, F.lit(1))).when(x.rlike("%$"), "%").otherwise("")
        return F.struct(F.regexp_replace(x, r"[^\d.]", "").cast("double").alias("value"), unit.alias("unit"))

    return F.transform(found, one)


def _lexicon(words: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def has_cause(text: Column) -> Column:
    return F.coalesce(text.rlike(_lexicon(CAUSAL)), F.lit(False))


def has_prediction(text: Column) -> Column:
    return F.coalesce(text.rlike(_lexicon(PREDICTIVE)), F.lit(False))


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def parse_ref(ref: Column) -> Column:
    """(kind, id) of obs:N or finding:N, else null."""
    good = ref.rlike(r"^(obs|finding):\d+$")
    return F.when(good, F.struct(F.regexp_extract(ref, r"^(\w+):", 1).alias("kind"), F.regexp_extract(ref, r":(\d+)$", 1).cast("long").alias("id")))


def four_digits(value: Column) -> Column:
    """A number to four significant digits."""
    digits = 3 - F.floor(F.log10(F.nullif(F.abs(value), F.lit(0.0))))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(value == 0, "0").otherwise((F.round(value * scale) / scale).cast("string"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, halves to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def render(template: Column | str, **values: Column) -> Column:
    """A template with each %%NAME%% replaced literally, in order."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"%%{name.upper()}%%"), F.coalesce(value, F.lit("")))
    return out
