"""Hand-made rows: nulls, ties, boundaries, idempotence and corruption."""

import datetime as dt
import difflib
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from factlens import storage
from factlens.functions import text as t
from factlens.operators import briefs
from factlens.operators import facts as f
from factlens.operators import grounding as g
from factlens.operators import ledger, quality, rules, sections, selection, sinks
from factlens.operators.metrics import compute_metrics, inputs_json
from factlens.operators.periods import nearest_prior, with_peer
from factlens.registry import CONCEPTS, check_registry
from factlens.sources import feeds, pages

D = dt.date.fromisoformat
FACTS = "cik string, concept string, unit string, period_start date, period_end date, version int, value double, accession_no string, form_type string, fiscal_period string, fiscal_year int, filed_date date"


def fact(concept, start, end, value, filed="2025-01-01", unit="USD", version=0, cik="1"):
    return (cik, concept, unit, start and D(start), D(end), version, value, "a", "10-K", "FY", 2024, filed and D(filed))


@pytest.fixture(scope="module")
def year_facts(spark):
    rows = [
        fact("Revenues", "2024-01-01", "2024-12-31", 200.0), fact("Revenues", "2023-01-02", "2023-12-31", 100.0), fact("CostOfRevenue", "2024-01-01", "2024-12-31", 80.0),
        fact("SalesRevenueNet", "2024-01-01", "2024-12-31", 999.0), fact("Revenues", "2024-10-01", "2024-12-31", 55.0), fact("Revenues", "2024-01-01", "2024-09-30", 145.0),
        fact("NetIncomeLoss", "2024-01-01", "2024-12-31", 10.0, "2025-02-01"), fact("NetIncomeLoss", "2024-01-01", "2024-12-31", 12.0, "2025-03-01"), fact("NetIncomeLoss", "2024-01-01", "2024-12-31", 99.0, None, version=9),
        fact("StockholdersEquity", None, "2024-12-31", -5.0), fact("LongTermDebt", None, "2024-12-31", 50.0), fact("CashAndCashEquivalentsAtCarryingValue", None, "2024-12-31", 20.0), fact("ShortTermInvestments", None, "2024-12-31", 5.0),
    ]
    return spark.createDataFrame(rows, FACTS)


@pytest.fixture(scope="module")
def year_filings(spark):
    return spark.createDataFrame([("1", "10-K", D("2024-12-31")), ("1", "10-K", D("2023-12-31"))], "cik string, form_type string, period_end date")


def test_latest_wins_and_null_dates_lose(year_facts):
    found = {r.concept: r.value for r in f.latest_filed(year_facts.filter("concept = 'NetIncomeLoss'")).collect()}
    assert found == {"NetIncomeLoss": 12.0}


def test_metrics_and_reasons(year_facts, year_filings):
    found = {(r.name, str(r.period_end)): r for r in compute_metrics(year_facts, year_filings).collect() if r.cls == "annual"}
    now = "2024-12-31"
    assert found["revenue_yoy", now].value == pytest.approx(1.0) and dict(found["revenue_yoy", now].inputs) == {"Revenues_t": 200.0, "Revenues_t-1": 100.0}
    assert found["revenue_yoy", "2023-12-31"].null_reason == "no earlier period to compare with"
    assert found["gross_margin", now].value == pytest.approx(0.6)
    assert (found["roe", now].value, found["roe", now].null_reason) == (None, "equity is negative")
    assert found["net_debt", now].value == pytest.approx(25.0) and "finance_lease_liability_current=0 [assumed]" in found["net_debt", now].formula
    assert found["ebitda_margin", now].null_reason == "ebitda cannot be taken: operating_income missing"
    assert all((r.value is None) == (r.null_reason is not None) for r in found.values())
    only = compute_metrics(year_facts, year_filings, names=["net_margin"], entities=["2"]).collect()
    assert only == []


def test_quarter_without_a_filing_is_no_period(year_facts, year_filings):
    spine = f.period_spine(f.latest_filed(year_facts), year_filings).collect()
    assert {(r.cls, str(r.period_start)) for r in spine} == {("annual", "2024-01-01"), ("annual", "2023-01-02"), ("three-quarter", "2024-01-01")}


def test_nearest_prior_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        end = D("2010-01-01") + dt.timedelta(days=rng.randrange(4000))
        rows.append((str(k % 4), end - dt.timedelta(days=360 + rng.randrange(5)), end))
    df = spark.createDataFrame(rows, "cik string, s date, e date")
    found = df.withColumn("p", nearest_prior(df, ["cik"], "s", "e", 365, 20)).collect()
    for r in found:
        near = [(abs((x[2] - (r.e - dt.timedelta(days=365))).days), -x[2].toordinal(), -x[1].toordinal()) for x in rows if x[0] == r.cik and abs((x[2] - (r.e - dt.timedelta(days=365))).days) <= 20]
        want = min(near, default=None)
        assert (r.p and (r.p.end.toordinal(), r.p.start.toordinal())) == (want and (-want[1], -want[2]))


def test_registry_is_checked():
    check_registry()
    with pytest.raises(ValueError, match="twice"):
        check_registry((*CONCEPTS, CONCEPTS[0]))


def syllables(word):
    clean = re.sub("[^a-z]", "", word.lower())
    n = len(re.findall("[aeiouy]+", clean))
    n -= clean.endswith("e") and n > 1
    n += bool(re.search("[^aeiouy]le$", clean))
    return max(n, 1)


def test_text_functions_as_plain_python(spark):
    texts = ["The little apple. Don't re-enter 3.5 times! v1", "", "No. 5 costs $1,234.50 (up 12%)...", "v1.2.3\nBecause of rain, will it fall?", "“Quotes” – and​ dashes", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    x = F.col("x")
    found = rows.select("k", t.word_count(x).alias("w"), t.sentence_count(x).alias("s"), t.complex_word_count(x).alias("c"), t.wording(x).alias("m"), t.numeric_tokens(x).alias("n"), t.normalize_inline(x).alias("i"), t.has_cause(x).alias("why"), t.has_prediction(x).alias("will")).collect()
    for r in found:
        text = texts[r.k]
        if text is None:
            assert not r.why and not r.will
            continue
        words = re.findall(r"[A-Za-z]+(?:['-][A-Za-z]+)*", text)
        assert r.w == len(words) and r.c == sum(syllables(w) >= 3 for w in words)
        assert r.s == (max(1, len(re.findall(r"(?<!\d)[.!?]+(?=\s|$)", text))) if words else 0)
        assert r.m == re.sub(r"\d[\d,]*\.?\d*", "<NUM>", re.sub(r"\Av\d+(?:\.\d+)+[ \t]*\n?", "", text))
        assert r.n == list(dict.fromkeys(n.replace(",", "") for n in re.findall(r"\d[\d,]*(?:\.\d+)?", text)))
    assert found[4].i == '"Quotes" - and dashes' and found[3].why and found[3].will


def test_numbers_are_bounded(spark):
    rows = [("16", "in 1160 of", False), ("16", "in 16 of", True), ("16.0", "in 16 of", True), ("16", "16.5 of", False), ("4", "the fourth of", True), ("1234", "1,234 of", True), ("16", "ends 16.", True)]
    df = spark.createDataFrame(rows, "n string, s string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", t.number_in(F.col("n"), t.ordinals_as_digits(F.col("s")))).collect())


def test_sums():
    assert g.adds_up(57, [27, 18, 12]) and not g.adds_up(58, [27, 18, 12]) and not g.adds_up(27, [27, 18]) and g.adds_up(45, [27, 18, 12])


def test_quotes(spark):
    source = "It was a long and winding road that led  to the old mill by the river."
    rows = [("a long and winding road that led to the old mill", True), ("a long and winding road that led to the new mill", False), ("winding road", False), (None, False)]
    df = spark.createDataFrame([(q, source, w) for q, w in rows], "quote string, source_text string, want boolean")
    assert all(r.quote_ok == r.want for r in g.check_quotes(df).collect())


def test_selection_is_the_greedy_walk(spark):
    rng = random.Random(3)
    names = [("metric_sigma_move", "v2"), ("metric_divergence", "v2"), ("section_appeared", "v4"), ("metric_sigma_move", "v1")]
    rows = [("a", k, *rng.choice(names), rng.choice(["gross_margin", "roe", "net_debt", "note"]), rng.choice(["high", "medium", "low"])) for k in range(60)]
    df = spark.createDataFrame(rows, "accession_no string, id int, rule_name string, rule_version string, subject string, severity string")
    found = {r.id for r in selection.select_observations(df).collect()}
    category = {"gross_margin": "margins", "roe": "returns", "net_debt": "solvency"}
    slots, per_rule, want = {}, {}, []
    for _, k, rule, version, subject, severity in sorted(rows, key=lambda r: ({"high": 0, "medium": 1, "low": 2}[r[5]], r[1])):
        slot = (rule, category.get(subject))
        if version == rules.RULES[rule][0] and slots.get(slot, 0) < 2 and per_rule.get(rule, 0) < 4 and len(want) < 8:
            want.append(k)
            slots[slot], per_rule[rule] = slots.get(slot, 0) + 1, per_rule.get(rule, 0) + 1
    assert found == set(want)


def test_state_rules_fire_on_transitions_only(spark):
    values = [("2020-12-31", 1.2), ("2021-12-31", 0.8), ("2022-12-31", 0.7), ("2023-12-31", None), ("2024-12-31", 0.9), ("2025-12-31", 1.5)]
    rows = spark.createDataFrame([("1", "annual", D(e), D(e), "current_ratio", v, "solvency", True, True, "a", int(e[:4]), "FY", e) for e, v in values], "cik string, cls string, period_start date, period_end date, name string, value double, category string, extreme boolean, headline boolean, accession_no string, fiscal_year int, fiscal_period string, id string")
    assert [str(r.period_end) for r in rules.threshold_cross(rows).collect()] == ["2021-12-31"]
    assert [str(r.period_end) for r in rules.stopped_computing(rows).collect()] == ["2023-12-31"]
    assert rules.sigma_move(rows).count() == 0


def test_overrides_and_lookahead(spark):
    ref = [("metrics", "x", D("2024-06-30"))]
    late = [("metrics", "x", D("2025-06-30"))]
    rows = [("1", "a", D("2024-12-31"), "section_appeared", "v4", "Note", "high", "s", ref), ("2", "b", D("2025-06-30"), "section_appeared", "v4", "Note", "high", "s", ref), ("3", "c", D("2020-01-01"), "section_appeared", "v4", "Note", "high", "s", late), ("1", "a", D("2024-12-31"), "metric_sigma_move", "v2", "roe", "high", "s", ref), ("2", "b", D("2024-12-31"), "metric_sigma_move", "v2", "roe", "high", "s", ref), ("9", "z", D("2024-12-31"), "section_renamed", "v3", "Plain", "high", "s", ref)]
    df = spark.createDataFrame(rows, "cik string, accession_no string, period_end date, rule_name string, rule_version string, subject string, severity string, statement string, refs array<struct<kind:string,id:string,period_end:date>>")
    found = {(r.cik, r.rule_name): r.severity for r in rules.override_severities(df, spark.createDataFrame([("Plain",)], "subject string")).collect()}
    assert found == {("1", "section_appeared"): "low", ("2", "section_appeared"): "low", ("3", "section_appeared"): "high", ("1", "metric_sigma_move"): "high", ("2", "metric_sigma_move"): "high", ("9", "section_renamed"): "low"}
    assert [r.cik for r in rules.lookahead(df).collect()] == ["3"]


def test_section_rules(spark):
    base = "We sell goods to many customers in many places every year. " * 12
    rows = []
    for year, names in ((2022, {"Leases": base, "Old name": base + "It is about leases of land.", "Gone": "short"}), (2023, {"Leases": base * 2, "New name": base + "It is about leases of lands.", "Fresh": "entirely different words in here now"})):
        rows += [(f"{n}-{year}", "c", "10-K", "FY", year, f"c-{year}", "Notes", n, x) for n, x in names.items()]
    df = spark.createDataFrame(rows, "section_id string, company string, form_type string, fiscal_period string, fiscal_year int, accession_no string, category string, short_name string, text string")
    measured = sections.measured(df)
    changes = sections.presence_changes(measured)
    words = sections.worded(df)
    found = sections.renames(changes, words)
    assert sections.renames(changes, words, ("Old name",)).count() == 0
    assert [(r.old_name, r.new_name) for r in found.collect()] == [("Old name", "New name")]
    assert [r.subject for r in sections.appeared_or_gone(changes, found, "a").collect()] == ["Fresh"] and [r.subject for r in sections.appeared_or_gone(changes, found, "d").collect()] == ["Gone"]
    assert [r.subject for r in sections.length_change(measured).collect()] == ["Leases"]
    assert sections.similarity("abcd", "bcde", -1) == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "d")], "k int, v string")
    first = sinks.upsert_changed(old, new, ["k"], ["v"])
    assert {r.k: r._change for r in first.collect()} == {1: "same", 2: "same", 3: "update", 4: "insert"}
    assert {r._change for r in sinks.upsert_changed(first.drop("_change"), new, ["k"], ["v"]).collect()} == {"same"}


def test_statuses_and_backfill(spark):
    rows = spark.createDataFrame([("a", "discovered", D("2024-01-02")), ("b", "failed", D("2024-01-01")), ("c", "sectioned", D("2024-01-03"))], "accession_no string, status string, filing_date date")
    outcomes = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False)], "accession_no string, ok boolean")
    assert {r.accession_no: r.status for r in sinks.advance(rows, outcomes, "fetched").collect()} == {"a": "fetched", "b": "failed", "c": "sectioned"}
    assert [r.accession_no for r in sinks.pending(rows, ["discovered", "failed"], 1).collect()] == ["b"]
    assert sinks.backfill(rows.withColumn("n", F.when(F.col("accession_no") == "a", 1)), {"n": F.lit(2)}).count() == 2


def test_insert_absent_is_idempotent(spark):
    rows = spark.createDataFrame([("k", None, 1, "first"), ("k", None, 2, "second")], "a string, b string, o int, v string")
    target = f.insert_absent(rows.limit(0), rows, ["a", "b"], "o")
    assert [r.v for r in target.collect()] == ["first"] and f.insert_absent(target, rows, ["a", "b"], "o").count() == 0


def test_admission_ends_at_the_first_refusal(spark):
    rows = spark.createDataFrame([("r", k, c) for k, c in enumerate([1, 2, 9, 1, 1])] + [("q", 0, 1)], "run string, k int, cost int")
    found = {(r.run, r.k): r.admitted for r in ledger.admit(rows, "run", ["k"], "cost", 5, 10).collect()}
    assert found == {("r", 0): True, ("r", 1): True, ("r", 2): False, ("r", 3): False, ("r", 4): False, ("q", 0): True}


def test_corruption_is_detected(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "text string, text_hash string")
    assert {r.problem for r in sinks.hash_mismatches(rows).collect()} == {"mismatch", "missing"}
    differ = quality.snapshot_differences(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string"), ["k"], ["v"])
    assert [r.k for r in differ.collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<S><Report><ShortName>Leases</ShortName><MenuCategory>Notes</MenuCategory><HtmlFileName>R1.htm</HtmlFileName><Position>x</Position></Report><Report><ShortName> </ShortName><MenuCategory>Notes</MenuCategory><HtmlFileName>R2.htm</HtmlFileName><Position>2</Position></Report><Report><ShortName>C</ShortName><MenuCategory>Cover</MenuCategory><HtmlFileName>R3.htm</HtmlFileName></Report></S>")
    assert [tuple(r) for r in feeds.read_report_index(spark, str(tmp_path / "r.xml")).collect()] == [("Notes", "Leases", "R1.htm", None)]
    (tmp_path / "i.json").write_text('{"directory": {"item": [{"name": "a.htm"}, {"name": " "}]}}')
    assert [r.filename for r in feeds.read_filing_index(spark, str(tmp_path / "i.json")).collect()] == ["a.htm"]
    page = '<table summary="Document Format Files"><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr><tr><td>1</td><td>Press release</td><td><a href="x">ex.htm</a></td><td>EX-99..1</td></tr><tr><td>only</td></tr></table>'
    found = pages.with_document_types(spark.createDataFrame([("a", page), ("b", None)], "accession_no string, html string"))
    assert [tuple(r) for r in found.collect()] == [("a", "ex.htm", "EX-99..1", "Press release")]
    types = found.select("accession_no", "type")
    have = {r.accession_no: r.has_exhibit for r in feeds.has_exhibit(spark.createDataFrame([("a",), ("b",)], "accession_no string"), types).collect()}
    assert have == {"a": True, "b": None}
    assert pages.page_text("<html><head><title>x</title></head><body><p>One<p>two 1<b>2</b>3<br>three<table><tr><td>a</td><td>b</td></tr></table></body>") == "One\ntwo 123\nthree\na  b"
    items = spark.createDataFrame([("9.01, 2.02", None), ("  ", "Item 2.02 and Item 9.01, Item 2.02"), (None, "x")], "items string, page string")
    assert [r.x for r in items.select(feeds.item_list(F.col("items"), F.col("page")).alias("x")).collect()] == [["9.01", "2.02"], ["2.02", "9.01"], None]


def test_native_operators_have_no_python_worker(year_facts, year_filings):
    plan = compute_metrics(year_facts, year_filings)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_numbers_stand_on_their_own(spark):
    """16 isn't in 1160; zeros that end a decimal part don't count; 16.50 is 16.5."""
    cases = [("16", "of 1160", False), ("16", "of 1,16", False), ("16", "it was 16.", True), ("16", "16.5", False), ("16.50", "it was 16.5 units", True), ("16.0", "16 units", True), ("16.05", "16.0", False), ("100", "in 1 of", False), ("1160", "1,160 in all", True), ("4", "4%", True)]
    df = spark.createDataFrame([(n, s) for n, s, _ in cases], "n string, s string")
    assert [r[0] for r in df.select(t.number_in(F.col("n"), F.col("s"))).collect()] == [w for _, _, w in cases]


def slow_units(text):
    out = []
    for m in re.finditer(r"\d[\d,]*(?:\.\d+)?", text):
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        out.append((float(m[0].replace(",", "")), before if before in ("$", "€", "£") and before else "%" if after == "%" else ""))
    return out


def test_numbers_with_units_against_plain_python(spark):
    rng = random.Random(2)
    texts = ["$ 5 and $5% and 5 % or 5%", "€1,234.50", "7.", "", "$$3"] + ["".join(rng.choice("$€£%., 01 29a") for _ in range(20)) for _ in range(300)]
    found = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.numbers_with_units(F.col("x")).alias("n")).collect()
    for r in found:
        assert [(n.value, n.unit) for n in r.n] == slow_units(r.x), r.x


def slow_complex(text):
    n = 0
    for w in re.findall(r"[A-Za-z]+(?:['-][A-Za-z]+)*", text):
        w = re.sub("[^a-z]", "", w.lower())
        groups = len(re.findall("[aeiouy]+", w))
        n += groups - (w.endswith("e") and groups > 1) + bool(re.search("[^aeiouy]le$", w)) >= 3
    return n


def test_complex_words_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["Reusable tables are incapable; tomate re-use can't-be", "", "idea'able", "a-e-i-o", "x'--y"] + ["".join(rng.choice("aeioule tbcrsy'-E1.") for _ in range(60)) for _ in range(400)]
    found = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.complex_word_count(F.col("x")).alias("n")).collect()
    assert [(r.x, r.n) for r in found] == [(x, slow_complex(x)) for x in texts]


def test_no_date_is_below_every_date(spark):
    rows = [fact("Revenues", "1968-01-01", "1968-12-31", 1.0, "1969-03-01"), fact("Revenues", "1968-01-01", "1968-12-31", 2.0, None, version=5)]
    assert [r.value for r in f.latest_filed(spark.createDataFrame(rows, FACTS)).collect()] == [1.0]


def test_sums_against_all_subsets():
    rng = random.Random(4)
    for _ in range(300):
        values = [float(rng.choice([0, 1, 2, 5, 12, 18, 27, 0.5])) for _ in range(rng.randrange(0, 9))]
        target = float(rng.choice([0, 3, 5, 57, 30, 45.5, 1]))
        want = any(abs(sum(x) - target) <= 1e-6 for n in range(2, len(values) + 1) for x in itertools.combinations(values, n))
        assert g.adds_up(target, values) == want, (target, values)
    assert not g.adds_up(21.0, [1.0] * 21) and g.adds_up(20.0, [1.0] * 20) and not g.adds_up(1.0, [1.0])


METRIC = "cik string, cls string, name string, period_start date, period_end date, value double, inputs map<string,double>"


def test_inputs_of_other_periods_are_found(spark):
    latest = spark.createDataFrame(
        [("1", "Revenues", D("2024-01-01"), D("2024-12-31"), 200.0), ("1", "Revenues", D("2023-01-01"), D("2023-12-31"), 150.0), ("1", "Revenues", D("2024-10-01"), D("2024-12-31"), 60.0), ("1", "Assets", None, D("2024-12-31"), 900.0), ("1", "Assets", None, D("2023-12-31"), 800.0)],
        "cik string, concept string, period_start date, period_end date, value double",
    )
    year = ("1", "annual", "m", D("2024-01-01"), D("2024-12-31"), 1.0)
    cases = [({"Revenues_t": 200.0, "Revenues_t-1": 150.0}, []), ({"Revenues": 60.0}, ["Revenues"]), ({"Revenues_t-1": 60.0, "Revenues_t": 200.0}, ["Revenues_t-1"]), ({"Assets": 800.0}, ["Assets"]), ({"Assets_t-1": 800.0, "Assets_t": 900.0}, []), ({"Assets_t-1": 1.0}, ["Assets_t-1"]), ({"beneish_dsri": 5.0}, [])]
    for inputs, bad in cases:
        assert [r.key for r in quality.mixed_periods(spark.createDataFrame([(*year, inputs)], METRIC), latest).collect()] == bad, inputs


def test_drift_between_tags_that_never_met(spark):
    other = "RevenueFromContractWithCustomerExcludingAssessedTax"
    days = lambda y: (D(f"{y}-01-01"), D(f"{y}-12-31"))
    facts = [("1", "Revenues", *days(2023), 1.0), ("1", other, *days(2024), 2.0), ("2", "Revenues", *days(2023), 1.0), ("2", other, *days(2024), 2.0), ("2", other, *days(2020), 2.0), ("2", "Revenues", *days(2020), 2.0)]
    latest = spark.createDataFrame(facts, "cik string, concept string, period_start date, period_end date, value double")
    inputs = {f"{other}_t": 2.0, "Revenues_t-1": 1.0, "Assets_t": 3.0}
    rows = [(c, "annual", "incremental_gross_margin", *days(2024), 1.0, inputs) for c in "12"] + [("1", "annual", "m", *days(2024), None, inputs), ("1", "annual", "gross_margin", *days(2024), 1.0, {other: 2.0, "Revenues": 1.0})]
    found = quality.unverified_drift(spark.createDataFrame(rows, METRIC), latest).collect()
    assert [(r.cik, r.name, r.canonical, r.tag_now, r.tag_before) for r in found] == [("1", "incremental_gross_margin", "revenue", other, "Revenues")]


def test_peers_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"c{rng.randrange(4)}", D("2020-01-01") + dt.timedelta(rng.randrange(3000))) for _ in range(400)]
    found = with_peer(spark.createDataFrame(rows, "k string, cik string, day date"), "cik", ["k"], "day", 60).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.peer == any(k == r.k and c != r.cik and abs((d - r.day).days) <= 60 for k, c, d in rows)


def test_renames_against_a_plain_walk(spark):
    """Greedy by name over all pairs of a filing, without bands."""
    rng = random.Random(6)
    base = ["We sell goods to many people. " * n for n in (3, 4, 5)]
    rows, want = [], []
    for c in range(6):
        texts = {y: {f"{'old' if y == 2022 else 'new'} {k}": "".join(x if rng.random() > 0.1 else rng.choice("xyz ") for x in rng.choice(base)) for k in range(5)} for y in (2022, 2023)}
        rows += [(f"{c}-{n}-{y}", str(c), "10-K", "FY", y, f"{c}-{y}", "Notes", n, x) for y, names in texts.items() for n, x in names.items()]
        free = dict(texts[2023])
        for old in sorted(texts[2022]):
            ratios = sorted((-difflib.SequenceMatcher(None, texts[2022][old], x).ratio(), n) for n, x in free.items())
            if ratios and -ratios[0][0] > 0.7:
                want.append((str(c), old, ratios[0][1]))
                del free[ratios[0][1]]
    df = spark.createDataFrame(rows, "section_id string, company string, form_type string, fiscal_period string, fiscal_year int, accession_no string, category string, short_name string, text string")
    found = sections.renames(sections.presence_changes(sections.measured(df)), sections.worded(df)).collect()
    assert sorted((r.company, r.old_name, r.new_name) for r in found) == sorted(want) and want
    pairs = sections.wording_changed(sections.measured(df.withColumn("short_name", F.substring("short_name", 5, 1))), sections.worded(df)).collect()
    text_of = {r[0]: r[8] for r in rows}
    slow = sum(difflib.SequenceMatcher(None, text_of[f"{c}-new {k}-2023"], text_of[f"{c}-old {k}-2022"]).ratio() < 0.6 for c in range(6) for k in range(5))
    assert len(pairs) == slow


def test_page_text_as_rendered():
    page = "<DOCUMENT><body><div><p>One</p></div>\n <p>“two” – 1<b>2</b>​3<br>three<table><tr><td> 1 </td><td> (2)</td></tr><tr><td></td></tr><tr><td>x</td></tr></table><script>no</script><ul><li>a\n b<li>c</ul></body>"
    assert pages.page_text(page) == 'One\n\n"two" - 123\nthree\n1  (2)\nx\na b\nc'
    assert pages.page_text(None) == "" and pages.page_text("plain") == "plain"


def test_briefs_fail_closed(spark):
    verified = spark.createDataFrame([("b", 1, "x", None), ("b", 2, "y", "bad"), ("b", 3, "z", None), ("b", 5, "w", None), ("c", 1, "v", None)], "brief_id string, position int, text string, drop_reason string")
    body = '{"verifications": [{"position": 0, "verdict": "unsupported"}, {"position": 0, "verdict": "supported"}, {"position": 1, "verdict": "maybe"}]}'
    responses = spark.createDataFrame([("b", body), ("c", "not json"), ("c", '{"verifications": [{"position": "0", "verdict": "supported"}]}')], "brief_id string, body string")
    rows = briefs.merged(verified, briefs.verdicts(responses))
    assert {(r.brief_id, r.position): r.outcome for r in rows.collect()} == {("b", 1): "kept", ("b", 2): "generator", ("b", 3): "verifier", ("b", 5): "verifier", ("c", 1): "verifier"}
    assert [(r.brief_id, r.place, r.text) for r in briefs.assembled(rows).collect()] == [("b", 0, "x")]
    counted = briefs.brief_rows(spark.createDataFrame([("b",), ("c",), ("empty",)], "brief_id string"), rows).collect()
    assert {r.brief_id: (r.sentences, r.generator_dropped, r.verifier_dropped, r.kept) for r in counted} == {"b": (4, 1, 2, 1), "c": (1, 0, 1, 0), "empty": (0, 0, 0, 0)}


def test_rule_engine_guards_and_upserts(spark):
    ref = [("metrics", "x", D("2024-06-30"))]
    schema = "cik string, accession_no string, period_end date, rule_name string, rule_version string, subject string, severity string, statement string, refs array<struct<kind:string,id:string,period_end:date>>"
    one = spark.createDataFrame([("1", "a", D("2024-12-31"), "section_appeared", "v4", "Note", "high", "s", ref)], schema)
    two = spark.createDataFrame([("2", "b", D("2025-06-30"), "section_appeared", "v4", "Note", "high", "s", ref), ("2", "b", D("2025-06-30"), "metric_sigma_move", "v1", "roe", "medium", "s", ref)], schema)
    plain = spark.createDataFrame([("Plain",)], "subject string")
    first = rules.engine([one, two], plain)
    assert {(r.cik, r.rule_name): (r.severity, r._change) for r in first.collect()} == {("1", "section_appeared"): ("low", "insert"), ("2", "section_appeared"): ("low", "insert"), ("2", "metric_sigma_move"): ("medium", "insert")}
    assert {r._change for r in rules.engine([one, two], plain, first.drop("_change")).collect()} == {"same"}
    late = two.withColumn("refs", F.array(F.struct(F.lit("metrics").alias("kind"), F.lit("x").alias("id"), F.lit(D("2026-01-01")).alias("period_end"))))
    with pytest.raises(ValueError, match="later period"):
        rules.engine([one, late], plain)


def test_admission_of_runs(spark):
    rows = [("a", 1, False, 5), ("a", 2, False, 5), ("a", 3, False, 5), ("a", 4, False, 1), ("b", 1, True, 5), ("b", 2, True, 1), ("c", 1, False, 3), ("c", 2, False, 3), ("c", 3, False, 3), ("d", 1, False, 1)]
    found = ledger.admit_all(spark.createDataFrame(rows, "run string, place int, scheduled boolean, cost long"), 0, 20, 12, 3, 4).collect()
    got = {(r.run, r.place): r.refusal for r in found}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): "run cost", ("a", 4): "calls", ("b", 1): "run cost", ("b", 2): "run cost", ("c", 1): None, ("c", 2): None, ("c", 3): None, ("d", 1): None}
    refused = ledger.refusal_rows(ledger.admit_all(spark.createDataFrame(rows, "run string, place int, scheduled boolean, cost long"), 15, 20, 12, 3, 4))
    assert {r.note for r in refused.collect()} == {"run cost", "calls", "lifetime budget"} and all(r.cost == 0 and r.status == "refused" for r in refused.collect())


def test_every_null_has_a_reason_and_inputs_give_the_value(spark, year_facts):
    rows = year_facts.withColumn("x", F.lit(1)).drop("x")
    filings = rows.select("cik", "period_end", "form_type").distinct()
    for r in compute_metrics(rows, filings).collect():
        assert (r.value is None) == (r.null_reason is not None) and r.formula
        if r.value is not None and r.name in ("net_margin", "operating_margin"):
            assert any(abs(a / b - r.value) < 1e-9 for a, b in itertools.permutations(r.inputs.values()) if b)


def test_inputs_as_json(spark):
    row = spark.sql("SELECT map('b_t-1', 2.5D, 'a\"x', 1.0D) AS i, CAST(NULL AS STRING) AS n, map() AS e, 'no \"x\"' AS why").select(inputs_json(F.col("i"), F.col("n")), inputs_json(F.col("e").cast("map<string,double>"), F.col("why"))).first()
    assert [json.loads(x) for x in row] == [{'a"x': 1.0, "b_t-1": 2.5}, {"_null_reason": 'no "x"'}]
    assert row[0].index("a") < row[0].index("b_t")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, getCheckpointDir = "spark://host:7077", lambda self: None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
