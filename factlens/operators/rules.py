"""Rules that flag what changed, over metrics and over sections, for all companies in one plan each.

An observation is (cik, accession_no, period_end, rule_name, rule_version, subject, severity, statement, refs); refs are
structs of kind, id and period_end.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.functions.text import four_digits
from factlens.operators.periods import with_peer
from factlens.operators.sinks import upsert_changed
from factlens.operators.stores import Snapshot
from factlens.registry import (
    DIVERGENCES,
    EXTREME_LEAST,
    EXTREME_WINDOW,
    HIGH_CATEGORIES,
    PEER_DAYS,
    RULES,
    SECTION_RULES,
    SIGMA_LEAST,
    SIGMA_LIMIT,
    THRESHOLDS,
    metric_table,
)
from factlens.storage import materialize

#: What observations need of the filing of a period.
LABELS = ("accession_no", "fiscal_year", "fiscal_period")
#: Metric rows that a task is dealt.
ROWS_A_TASK = 400_000
COLUMNS = ("cik", "accession_no", "period_end", "rule_name", "rule_version", "subject", "severity", "statement", "refs")


def metric_id(period_end: Column | str = "period_end") -> Column:
    return F.concat_ws("|", "cik", "name", "cls", (F.col(period_end) if isinstance(period_end, str) else period_end).cast("string"))


def metric_rows(metrics: DataFrame, filings: DataFrame, tasks: int | None = None) -> DataFrame:
    """Metrics with their registry entry and with the filing and fiscal label of their period.

    Where metrics bring these along, as filed, they are not joined. What a rule needs of rows is dealt out by company to so
    many ``tasks``, which serves all windows of the rules, if that is given.
    """
    cls = F.when(F.col("form_type") == "10-K", "annual").when(F.col("form_type") == "10-Q", "quarterly")
    found = filings.select("cik", "period_end", cls.alias("cls"), "accession_no", "fiscal_year", "fiscal_period").filter("cls is not null")
    registry = metric_table(metrics.sparkSession).select("name", "cls", "category", "extreme", "headline")
    carried = "filed" in metrics.columns
    rows = metrics.select("cik", "cls", "period_start", "period_end", "name", "value", *([F.inline_outer("filed")] if carried else []))
    rows = rows.join(F.broadcast(registry), ["name", "cls"])
    rows = rows if carried else rows.join(found, ["cik", "period_end", "cls"], "left")
    return (rows if tasks is None else rows.repartition(tasks, "cik")).withColumn("id", metric_id())


def observation(rule: str, severity: Column, statement: Column, refs: list[Column] | Column, subject: str = "name") -> list[Column]:
    refs = F.array(*refs) if isinstance(refs, list) else refs
    version, base = RULES[rule]
    return [F.col("cik"), F.col("accession_no"), F.col("period_end"), F.lit(rule).alias("rule_name"), F.lit(version).alias("rule_version"), F.col(subject).alias("subject"), F.coalesce(severity, F.lit(base)).alias("severity"), statement.alias("statement"), refs.alias("refs")]


def ref(kind: str, id_: Column, period_end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), period_end.alias("period_end"))


def refs_json(refs: Column) -> Column:
    """References as JSON, in order: a list of objects with the table and the id that each names."""
    return F.to_json(F.transform(refs, lambda r: F.struct(r["kind"].alias("table"), r["id"].alias("id"))))


def multi_year_extreme(rows: DataFrame) -> DataFrame:
    """A value beyond all of the trailing window's, once there is enough history."""
    w = Window.partitionBy("cik", "name", "cls").orderBy("period_end", "period_start")
    out = None
    for cls, least in EXTREME_LEAST.items():
        back = w.rowsBetween(-EXTREME_WINDOW[cls], -1)
        own = rows.filter(F.col("value").isNotNull() & F.col("extreme") & F.col("headline") & (F.col("cls") == cls))
        own = own.withColumns({"n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1)), "low": F.min("value").over(back), "high": F.max("value").over(back)})
        own = own.withColumn("earlier", F.collect_list("period_end").over(back)).filter((F.col("n") >= least) & ((F.col("value") > F.col("high")) | (F.col("value") < F.col("low"))))
        out = own if out is None else out.unionByName(own)
    word = F.when(F.col("value") > F.col("high"), "highest").otherwise("lowest")
    severity = F.when(F.col("category").isin(*HIGH_CATEGORIES), "high").otherwise("medium")
    statement = F.concat(F.col("name"), F.lit(" of "), four_digits(F.col("value")), F.lit(" is the "), word, F.lit(" in "), (F.size("earlier") + 1).cast("string"), F.lit(" periods."))
    earlier = F.transform("earlier", lambda day: ref("metrics", metric_id(day), day))
    refs = F.concat(F.array(ref("metrics", F.col("id"), F.col("period_end"))), earlier)
    return out.select(*observation("metric_multi_year_extreme", severity, statement, refs))


def sigma_rows(rows: DataFrame) -> DataFrame:
    """The rows that the rule on standard deviations looks at."""
    return rows.filter(F.col("value").isNotNull() & F.col("headline") & (F.col("cls") == "quarterly"))


def beyond_sigma(rows: DataFrame) -> DataFrame:
    """Observations of rows whose value is more than two standard deviations from the mean of the ``n`` before (mean, sd)."""
    z = (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    own = rows.withColumn("z", F.when(F.col("n") >= SIGMA_LEAST, z)).filter(F.abs("z") > SIGMA_LIMIT)
    statement = F.concat(F.col("name"), F.lit(" of "), four_digits(F.col("value")), F.lit(" is "), four_digits(F.col("z")), F.lit(" standard deviations from its mean."))
    return own.select(*observation("metric_sigma_move", F.lit(None).cast("string"), statement, [ref("metrics", F.col("id"), F.col("period_end"))]))


def sigma_move(rows: DataFrame) -> DataFrame:
    """A quarterly value more than two population standard deviations from the mean of all before it."""
    w = Window.partitionBy("cik", "name", "cls").orderBy("period_end", "period_start").rowsBetween(Window.unboundedPreceding, -1)
    return beyond_sigma(sigma_rows(rows).withColumns({"n": F.count("*").over(w), "mean": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w)}))


def _previous(rows: DataFrame, by_class: bool) -> tuple[Window, DataFrame]:
    keys = ["cik", "name", "cls"] if by_class else ["cik", "name"]
    w = Window.partitionBy(*keys).orderBy("period_end", "period_start")
    return w, rows.withColumn("before", F.lag(F.struct("id", "period_end", "value")).over(w))


def _transitions(rows: DataFrame, rule: str, state: Column, crosses: Column, statement: Column, by_class: bool) -> DataFrame:
    w, own = _previous(rows.withColumn("state", state), by_class)
    own = own.withColumn("was", F.lag("state").over(w))
    fires = F.when(crosses, F.col("state") != F.col("was")).otherwise(F.col("state") & ~F.col("was"))
    refs = [ref("metrics", F.col("id"), F.col("period_end")), ref("metrics", F.col("before.id"), F.col("before.period_end"))]
    return own.filter(fires).select(*observation(rule, F.lit(None).cast("string"), statement, refs))


def threshold_cross(rows: DataFrame, thresholds: tuple = THRESHOLDS, by_class: bool = False) -> DataFrame:
    """A declared threshold crossed since the row before; annual and quarterly rows interleave unless ``by_class``."""
    own = rows.filter(F.col("value").isNotNull() & F.col("name").isin(*[t[0] for t in thresholds]))
    state, crosses = F.lit(None).cast("boolean"), F.lit(False)
    for name, kind, limit in thresholds:
        test = {"above": F.col("value") > limit, "below": F.col("value") < limit}.get(kind, F.col("value") >= 0) if limit is not None else F.col("value") >= 0
        state = F.when(F.col("name") == name, test).otherwise(state)
        crosses = F.when(F.col("name") == name, F.lit(kind == "crosses_zero")).otherwise(crosses)
    statement = F.concat(F.col("name"), F.lit(" crossed its threshold at "), four_digits(F.col("value")), F.lit("."))
    return _transitions(own, "metric_threshold_cross", state, crosses, statement, by_class)


def with_label_prior(rows: DataFrame) -> DataFrame:
    """Rows with the same metric's row of the same fiscal period a year before (and of the same class), each if there are several."""
    w = Window.partitionBy("cik", "name", "cls", "fiscal_period").orderBy("fiscal_year").rangeBetween(-1, -1)
    known = F.col("cik").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull()
    earlier = F.collect_list(F.struct("period_end", "value")).over(w)
    out = rows.withColumn("_before", earlier).withColumn("_before", F.explode_outer(F.when(known, F.col("_before"))))
    before = F.struct(metric_id("_before.period_end").alias("id"), F.col("_before.period_end").alias("period_end"), F.col("_before.value").alias("value"))
    return out.withColumn("year_before", F.when(F.col("_before").isNotNull(), before)).drop("_before")


def divergence(rows: DataFrame, divergences: tuple = DIVERGENCES, by_class: bool = False) -> DataFrame:
    """A declared level exceeded, or a fall against the year before, that did not hold at the row before."""
    own = with_label_prior(rows.filter(F.col("name").isin(*[d[0] for d in divergences]))).filter(F.col("value").isNotNull())
    state = F.lit(None).cast("boolean")
    change = F.col("value") / F.nullif("year_before.value", F.lit(0.0)) - 1
    for name, kind, limit in divergences:
        state = F.when(F.col("name") == name, F.col("value") > limit if kind == "above" else change < -limit).otherwise(state)
    statement = F.concat(F.col("name"), F.lit(" diverged at "), four_digits(F.col("value")), F.lit("."))
    return _transitions(own, "metric_divergence", state, F.lit(False), statement, by_class)


def stopped_computing(rows: DataFrame) -> DataFrame:
    """A metric that is null now but was not in the same fiscal period a year before."""
    own = with_label_prior(rows.filter(F.col("fiscal_year").isNotNull())).filter(F.col("value").isNull() & F.col("year_before.value").isNotNull())
    statement = F.concat(F.col("name"), F.lit(" stopped computing (it was "), four_digits(F.col("year_before.value")), F.lit(" a year before)."))
    refs = [ref("metrics", F.col("id"), F.col("period_end")), ref("metrics", F.col("year_before.id"), F.col("year_before.period_end"))]
    return own.select(*observation("metric_stopped_computing", F.lit(None).cast("string"), statement, refs))


METRIC_RULES = {
    "metric_multi_year_extreme": multi_year_extreme,
    "metric_sigma_move": sigma_move,
    "metric_threshold_cross": threshold_cross,
    "metric_divergence": divergence,
    "metric_stopped_computing": stopped_computing,
}


def metric_observations(metrics: DataFrame, filings: DataFrame, names: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """All metric rules, or those named, over all companies."""
    rows = metric_rows(metrics, filings, tasks)
    found = [rule(rows) for name, rule in METRIC_RULES.items() if names is None or name in names]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def eligible_counts(rows: DataFrame) -> DataFrame:
    """How often each metric rule could have fired, by company; rules on values only for companies that have some.

    Sums over counts say all of it, so that nothing is sorted: of n values of a history all but the first few have as many before
    them, and a row meets the values of the fiscal year before, which are counted a year ahead as well.
    """
    known = F.col("cik").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull()
    year, has, zero = F.when(known, F.col("fiscal_year")), F.col("value").isNotNull().cast("long"), F.lit(0).cast("long")
    own = F.struct(year.alias("year"), F.lit(1).cast("long").alias("rows"), has.alias("n"), zero.alias("before"))
    ahead = F.struct((year + 1).alias("year"), zero.alias("rows"), zero.alias("n"), F.when(known, has).otherwise(zero).alias("before"))
    each = rows.select("cik", "name", "cls", "fiscal_period", "extreme", "headline", F.inline(F.array(own, ahead))).filter("rows + before > 0")
    flags = [F.bool_or(c).alias(c) for c in ("extreme", "headline")]
    years = each.groupBy("cik", "name", "cls", "fiscal_period", "year").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("before").alias("before"), *flags)
    histories = years.groupBy("cik", "name", "cls").agg(F.sum("n").alias("n"), F.sum(F.col("rows") * F.col("before")).alias("stopped"), *flags)

    def beyond(n: str, least: Column | int) -> Column:
        return F.greatest(F.col(n) - least, F.lit(0))

    least = F.create_map(*[x for k, v in EXTREME_LEAST.items() for x in (F.lit(k), F.lit(v))])[F.col("cls")]
    extreme, quarterly = F.col("extreme") & F.col("headline"), F.col("headline") & (F.col("cls") == "quarterly")
    names = histories.groupBy("cik", "name").agg(
        F.sum("n").alias("n"), F.sum("stopped").alias("stopped"), F.sum(F.when(extreme, beyond("n", least)).otherwise(0)).alias("extreme"), F.sum(F.when(quarterly, beyond("n", SIGMA_LEAST)).otherwise(0)).alias("sigma")
    )
    counts = {
        "metric_multi_year_extreme": F.sum("extreme"),
        "metric_sigma_move": F.sum("sigma"),
        "metric_threshold_cross": F.sum(F.when(F.col("name").isin(*[t[0] for t in THRESHOLDS]), beyond("n", 1)).otherwise(0)),
        "metric_divergence": F.sum(F.when(F.col("name").isin(*[d[0] for d in DIVERGENCES]), beyond("n", 1)).otherwise(0)),
    }
    found = names.groupBy("cik").agg(*[F.when(F.sum("n") > 0, c).alias(k) for k, c in counts.items()], F.sum("stopped").alias("metric_stopped_computing"))
    return found.unpivot("cik", list(METRIC_RULES), "rule_name", "eligible").filter("eligible is not null")


def override_severities(observations: DataFrame, boilerplate: DataFrame, days: int = PEER_DAYS, stored: DataFrame | None = None) -> DataFrame:
    """Boilerplate subjects are low; else section rules with a peer company in a year are low and say so; metric rules stay.

    Peers are looked for in the batch and among observations ``stored`` before, of the same version of the rule.
    """
    names = F.broadcast(boilerplate.select("subject").distinct().withColumn("plain", F.lit(True)))
    of_sections = F.col("rule_name").isin(*SECTION_RULES)
    sections = with_peer(observations.filter(of_sections), "cik", ["rule_name", "rule_version", "subject"], "period_end", days, None if stored is None else stored.filter(of_sections))
    out = sections.unionByName(observations.filter(~of_sections).withColumn("peer", F.lit(False)), allowMissingColumns=True).join(names, "subject", "left")
    plain = F.coalesce("plain", F.lit(False))
    severity = F.when(plain | F.col("peer"), "low").otherwise(F.col("severity"))
    statement = F.when(~plain & F.col("peer"), F.concat(F.col("statement"), F.lit(" Other companies show the same within a year."))).otherwise(F.col("statement"))
    return out.withColumns({"severity": severity, "statement": statement}).select(*[F.col(c) for c in COLUMNS])


#: What tells observations apart, and what an update may change.
KEYS, PAYLOAD = ["cik", "accession_no", "period_end", "rule_name", "subject"], ["rule_version", "severity", "statement", "refs"]


def store(spark: SparkSession, path: str, **options: int) -> Snapshot:
    """Observations at ``path``, in buckets by company."""
    return Snapshot(spark, path, KEYS, PAYLOAD, ["cik"], **options)


def batch(found: list[DataFrame], boilerplate: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The observations of all rules and companies, computed once: severities overridden over all of them, and guarded.

    A batch with a reference to a later period is an error, and nothing of it is to be written.
    """
    raw = functools.reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in found])
    out = materialize(override_severities(raw, boilerplate, stored=stored), "observations")
    if lookahead(out).limit(1).count():
        raise ValueError("an observation refers to a later period")
    return out


def engine(found: list[DataFrame], boilerplate: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """A ``batch`` against those ``written`` before: what changes (_change: insert, update or same)."""
    out = batch(found, boilerplate, written)
    return upsert_changed(out.limit(0) if written is None else written, out, KEYS, PAYLOAD)


def run(found: list[DataFrame], boilerplate: DataFrame, into: Snapshot) -> DataFrame:
    """A ``batch`` merged into a store: only buckets of companies with something new or different are written.

    Returns the rows of the buckets that the batch falls into, with _change. A batch that changes nothing writes nothing.
    """
    return into.merge(batch(found, boilerplate, into.read()))


def lookahead(observations: DataFrame) -> DataFrame:
    """Observations with a reference later than their own period: there must be none."""
    return observations.filter(F.exists("refs", lambda r: r["period_end"] > F.col("period_end")))
