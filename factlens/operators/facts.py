"""Facts: latest filed value, tag resolution period by period, period spine, wide rows, and tag agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.registry import CONCEPTS, DURATION_CLASSES, INSTANT, OTHER, RELATIVE_TOLERANCE, alias_table
from factlens.storage import tasks_for

PERIOD = ["cik", "period_start", "period_end"]
#: Days since 1970 that stand for no date: below every date there is.
NO_DATE = -1_000_000_000
#: Facts that a task is dealt.
FACTS_A_TASK = 600_000


def duration_class(start: Column, end: Column) -> Column:
    """The class of a period by its days; instant without a start."""
    days = F.datediff(end, start)
    out = F.when(start.isNull(), INSTANT)
    for name, low, high in DURATION_CLASSES:
        out = out.when(days.between(low, high), name)
    return out.otherwise(OTHER)


def filing_rank(order: str = "version") -> Column:
    """Date of filing and ``order`` in one long."""
    return F.coalesce(F.unix_date("filed_date"), F.lit(NO_DATE)).cast("long") * (1 << 32) + F.coalesce(F.col(order), F.lit(0)).cast("long")


def latest_filed(facts: DataFrame, order: str = "version") -> DataFrame:
    """Of all filed versions of a fact the one filed last; no date counts lowest, then the larger ``order`` wins.

    One long carries date and order, so that the aggregation keeps a fixed-width buffer and stays a hash aggregation.
    """
    return facts.groupBy("cik", "concept", "unit", "period_start", "period_end").agg(F.max_by("value", filing_rank(order)).alias("value"))


def with_canonical(latest: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Facts of registered tags and units, with their concept and priority; instants have no start, durations one."""
    aliases = alias_table(latest.sparkSession) if aliases is None else aliases
    found = latest.join(F.broadcast(aliases), ["concept", "unit"])  # a row a registered tag
    return found.filter(F.col("instant") == F.col("period_start").isNull())


def resolve(latest: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """For each concept and exact period the value of the tag with the first priority."""
    found = with_canonical(latest, aliases)
    return found.groupBy("cik", "canonical", "period_start", "period_end").agg(F.min("priority").alias("priority"), F.min_by("value", "priority").alias("value"))


def period_spine(latest: DataFrame, filings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Periods of duration facts: annual and quarterly ones only where a filing of that form ends, others as they are."""
    found = with_canonical(latest, aliases).filter(~F.col("instant")).select(*PERIOD).distinct()
    found = found.withColumn("cls", duration_class(F.col("period_start"), F.col("period_end")))
    cls = F.when(F.col("form_type") == "10-K", "annual").when(F.col("form_type") == "10-Q", "quarterly")
    ends = filings.filter(F.col("period_end").isNotNull()).select("cik", "period_end", cls.alias("cls")).filter("cls is not null").distinct()
    bound = F.col("cls").isin("annual", "quarterly")
    return found.filter(bound).join(ends, ["cik", "period_end", "cls"], "left_semi").unionByName(found.filter(~bound))


def wide(resolved: DataFrame, spine: DataFrame) -> DataFrame:
    """A row a period: value (name_v) and priority (name_p) of each concept; instants are those at the period's end."""

    def pivot(rows: DataFrame, keys: list[str], instant: bool) -> DataFrame:
        names = [c.name for c in CONCEPTS if c.instant == instant]
        return rows.groupBy(*keys).pivot("canonical", names).agg(F.first("value").alias("v"), F.first("priority").alias("p"))

    durations = pivot(resolved.filter(F.col("period_start").isNotNull()), PERIOD, False)
    instants = pivot(resolved.filter(F.col("period_start").isNull()), ["cik", "period_end"], True)
    return spine.join(durations, PERIOD, "left").join(instants, ["cik", "period_end"], "left")


def by_period(facts: DataFrame, tasks: int) -> DataFrame:
    """Value (name_v) and priority (name_p) of each concept, as ``resolve`` of ``latest_filed`` gives them, by company and exact period.

    Registered tags are numbered before facts are dealt out by company to ``tasks``, and one aggregation keeps the value filed
    last of each number, in fixed-width buffers, with a bit for each tag that was filed at all. Instants and durations are
    numbered apart, as a period has only one kind: so there are few enough buffers for generated code.
    """
    tags, out = {True: [], False: []}, []
    for c in CONCEPTS:
        value, priority, own = F.lit(None).cast("double"), F.lit(None).cast("int"), tags[c.instant]
        first, kind = len(own), F.col("period_start").isNull() == c.instant
        own += [(t, c.unit, c.instant, first + k) for k, t in enumerate(c.tags)]
        for *_, k in reversed(own[first:]):  # the first priority is asked first
            there = kind & (F.col(f"_bits{k // 62}").bitwiseAND(F.lit(1 << (k % 62)).cast("long")) != 0)
            value, priority = F.when(there, F.col(f"_v{k}")).otherwise(value), F.when(there, F.lit(k - first)).otherwise(priority)
        out += [value.alias(f"{c.name}_v"), priority.alias(f"{c.name}_p")]
    most = max(map(len, tags.values()))
    numbers = facts.sparkSession.createDataFrame(tags[True] + tags[False], "concept string, unit string, instant boolean, _tag int")
    found = facts.join(F.broadcast(numbers), ["concept", "unit"]).filter(F.col("instant") == F.col("period_start").isNull())  # a row a registered tag
    found = found.select(*PERIOD, "_tag", "value", filing_rank().alias("_rank")).repartition(tasks, "cik")
    last = [F.expr(f"max_by(value, _rank) FILTER (WHERE _tag = {k})").alias(f"_v{k}") for k in range(most)]
    bits = [F.expr(f"bit_or(shiftleft(1L, _tag % 62)) FILTER (WHERE _tag DIV 62 = {k})").alias(f"_bits{k}") for k in range(-(-most // 62))]
    return found.groupBy(*PERIOD).agg(*last, *bits).select(*PERIOD, *out)


def wide_periods(facts: DataFrame, filings: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """``wide`` of all facts of companies, by one shuffle: dealt out by company, all the rest happens where a company's facts lie.

    Also filed: the filings of that form that end with an annual or quarterly period, as an array of structs of the ``labels``.
    Facts without a company or a period's end give no rows.
    """
    tasks = tasks_for(facts, FACTS_A_TASK)
    known = F.col("cik").isNotNull() & F.col("period_end").isNotNull()
    durations, instants = ([c.name for c in CONCEPTS if c.instant == instant] for instant in (False, True))
    every = by_period(facts.filter(known), tasks)
    held = [f"{n}_{x}" for n in instants for x in ("v", "p")]
    every = every.withColumn("_end", F.when(F.col("period_start").isNull(), F.struct(*held)))
    form = F.when(F.col("form_type") == "10-K", "annual").when(F.col("form_type") == "10-Q", "quarterly").alias("cls")
    ends = filings.filter(known).select("cik", "period_end", form, *labels).filter("cls is not null").repartition(tasks, "cik")
    ends = ends.groupBy("cik", "period_end").agg(F.collect_list(F.struct("cls", *labels)).alias("_filed"))
    place = Window.partitionBy("cik", "period_end")
    rows = every.unionByName(ends, allowMissingColumns=True)
    rows = rows.withColumns({c: F.first(c, ignorenulls=True).over(place) for c in ("_end", "_filed")}).filter("period_start is not null")
    rows = rows.withColumn("cls", duration_class(F.col("period_start"), F.col("period_end")))
    filed = F.filter(F.coalesce("_filed", F.array().cast(dict(rows.dtypes)["_filed"])), lambda x: x["cls"] == F.col("cls"))
    rows = rows.withColumn("filed", filed).filter(~F.col("cls").isin("annual", "quarterly") | (F.size("filed") > 0))
    shown = F.transform("filed", lambda x: F.struct(*[x[c].alias(c) for c in labels])).alias("filed")
    return rows.select(*PERIOD, "cls", *[f"{n}_{x}" for n in durations for x in ("v", "p")], *[F.col(f"_end.{c}").alias(c) for c in held], *([shown] if labels else []))


def concept_drift(latest: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Where a concept's resolved tag differs from the one resolved for the company's period before."""
    w = Window.partitionBy("cik", "canonical").orderBy(F.col("period_start").asc_nulls_first(), "period_end")
    found = resolve(latest, aliases).withColumn("before", F.last("priority", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return found.filter("before <> priority").select("cik", "canonical", "period_start", "period_end", "before", "priority")


def tag_disagreements(latest: DataFrame, aliases: DataFrame | None = None, tolerance: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Pairs of tags of one concept, given for the same period, that differ by more than the tolerance.

    The tags before one are met in a window, so that facts dealt out by company stay where they are.
    """
    found = with_canonical(latest, aliases).filter(F.col("cik").isNotNull() & F.col("period_end").isNotNull())
    before = Window.partitionBy("cik", "canonical", "period_end", "period_start").orderBy("priority").rangeBetween(Window.unboundedPreceding, -1)
    pairs = found.withColumn("_before", F.collect_list(F.struct("concept", "value")).over(before)).withColumn("a", F.explode("_before"))
    keys = ["cik", "canonical", "period_end", "period_start"]
    rows = pairs.select(*keys, F.col("a.concept").alias("tag_a"), F.col("concept").alias("tag_b"), F.col("a.value").alias("value_a"), F.col("value").alias("value_b"))
    return rows.filter(relative_difference(F.col("value_a"), F.col("value_b")) > tolerance)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.when(a != 0, F.abs(a)).otherwise(1e-9)


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key ``target`` doesn't have (null equals null); of equal keys the first by ``order``."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
    a, b = first.alias("a"), target.select(*keys).distinct().alias("b")
    absent = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti")
    return absent.select(*new.columns)


def consistent_labels(facts: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """One (fiscal_year, fiscal_period) for each filing over all its facts; null where they conflict."""
    label = F.struct("fiscal_year", "fiscal_period")
    found = facts.filter(F.col("form_type").isin(*forms) & F.col("accession_no").isNotNull()).groupBy("accession_no").agg(F.count_distinct(label).alias("labels"), F.min("fiscal_year").alias("y"), F.min("fiscal_period").alias("p"))
    one = F.col("labels") == 1
    return found.select("accession_no", "labels", F.when(one, F.col("y")).alias("fiscal_year"), F.when(one, F.col("p")).alias("fiscal_period"))


def ingest_report(facts: DataFrame, companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows by company and concept; companies without any fact of a concept have zero."""
    aliases = alias_table(facts.sparkSession) if aliases is None else aliases
    counts = facts.join(F.broadcast(aliases), ["concept", "unit"]).groupBy("cik", "canonical").agg(F.count("*").alias("n"))
    every = companies.select("cik").crossJoin(F.broadcast(aliases.select("canonical").distinct()))  # a registered concept each
    return every.join(counts, ["cik", "canonical"], "left").select("cik", "canonical", F.coalesce("n", F.lit(0)).alias("n"))
