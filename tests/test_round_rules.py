"""Renames by rounds, prefixes in similarity, canonical and fluctuating names, numbers on their own, table functions."""

import difflib
import random
import re

from pyspark.sql import functions as F

from factlens.functions import text as t
from factlens.operators import analysis, briefs, quality, rules
from factlens.operators import sections as s
from factlens.plans.texts import FLUCTUATING
from factlens.sources import tables

PAIRS = "company string, form_type string, fiscal_period string, fiscal_year int, old_name string, new_name string, ratio double"


def test_renames_as_a_walk_in_order(spark):
    rng, rows, want = random.Random(7), [], []
    for filing in range(25):
        olds, news = [f"o{k}" for k in range(rng.randrange(1, 9))], [f"n{k}" for k in range(rng.randrange(1, 9))]
        pairs = {(o, n): rng.choice([0.75, 0.8, 0.9]) for o in olds for n in news if rng.random() < 0.7}
        rows += [(f"c{filing}", "10-K", "FY", 2020, o, n, r) for (o, n), r in pairs.items()]
        used = set()
        for o in olds:
            free = sorted((-r, n) for (x, n), r in pairs.items() if x == o and n not in used)
            if free:
                used.add(free[0][1])
                want.append((f"c{filing}", o, free[0][1]))
    found = s.matched(spark.createDataFrame(rows, PAIRS))
    assert sorted((r.company, r.old_name, r.new_name) for r in found.collect()) == sorted(want)
    assert s.matched(spark.createDataFrame([], PAIRS)).count() == 0


def test_similarity_of_prefixes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoin shrdlu<>NUM.,Qz") for _ in range(rng.randrange(1, 9)))
    rows = []
    for k in range(120):
        a = "".join(word() for _ in range(rng.randrange(120)))
        b = a[: rng.randrange(len(a) + 1)] if k % 2 else a + word() * rng.randrange(30)
        rows.append((a, b) if k % 3 else (b, a))
    rows += [("", ""), ("a", ""), ("", "b"), ("abcd", "bcde"), ("private", "privately so")]
    found = spark.createDataFrame(rows, "a string, b string").withColumn("ratio", s.text_similarity(F.col("a"), F.col("b"))).collect()
    assert all(abs(r.ratio - difflib.SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in found)
    nothing = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in nothing.select(s.text_similarity(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_canonical_and_fluctuating_names(spark):
    rows = [("1", 2020, "Leases"), ("2", 2021, "Lease Accounting"), ("3", 2020, "Taxes"), ("4", 2021, "Taxes"), ("5", 2020, "Pending"), ("6", 2021, "Debt"), ("7", 2020, FLUCTUATING[0])]
    table = spark.createDataFrame([(i, "c", "10-K", "FY", y, f"c-{y}", "Notes", n, f"The text of {n} is this.") for i, y, n in rows], "section_id string, company string, form_type string, fiscal_period string, fiscal_year int, accession_no string, category string, short_name string, text string")
    aliases = spark.createDataFrame([("Lease Accounting", "Leases")], "alias string, canonical string")
    changes = lambda rows, names: {(r.short_name, r.kind) for r in s.presence_changes(rows, fluctuating=names).collect()}
    plain, known = s.measured(table), s.measured(table, aliases)
    assert changes(plain, ()) == {("Leases", "d"), ("Lease Accounting", "a"), ("Pending", "d"), ("Debt", "a"), (FLUCTUATING[0], "d")}
    assert changes(known, ("Pending", FLUCTUATING[0])) == {("Debt", "a")}
    assert {r.short_name for r in s.with_year_before(known, ["words"]).collect()} == {"Leases", "Taxes"}
    eligible = {r.rule_name: r.eligible for r in s.eligible_sections(known, fluctuating=("Pending", FLUCTUATING[0])).collect()}
    assert eligible["section_appeared"] == 3 and eligible["section_length_change"] == 2


def test_numbers_on_their_own_as_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("1230..,, a-$%") for _ in range(rng.randrange(25))) for _ in range(400)]
    rows = [(n, x) for x in texts for n in {rng.choice(["1", "12", "3.0", "1.20", "2.3", "0", "30"]) for _ in range(3)}]

    def plain(n, x):
        x = x.replace(",", "")
        return any(re.search(rf"(?<![\d.,]){re.escape(v)}(?![\d,]|\.\d)", x) for v in (n, re.sub(r"\.?0+$", "", n) if "." in n else n))

    found = spark.createDataFrame(rows, "n string, x string").withColumn("got", t.number_in(F.col("n"), F.col("x"))).collect()
    assert all(r.got == plain(r.n, r.x) for r in found)


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "$5 and 7.5% of 1,000"), (2, None), (3, "none")], "k long, x string")
    rows.createOrReplaceTempView("some_texts")
    found = spark.sql("SELECT k, n.* FROM some_texts, LATERAL numbers_with_units(x) n ORDER BY k, place").collect()
    assert [tuple(r) for r in found] == [(1, 0, 5.0, "$"), (1, 1, 7.5, "%"), (1, 2, 1000.0, "")]
    native = rows.select("k", F.posexplode(t.numbers_with_units(F.col("x"))).alias("place", "n")).select("k", "place", "n.value", "n.unit")
    assert sorted(map(tuple, found)) == sorted(map(tuple, native.collect()))
    assert spark.sql("SELECT * FROM document_rows(NULL)").count() == 0


def test_references(spark):
    refs = spark.createDataFrame([([("metrics", "a|b", None), ("sections", 'x"1', None)],), ([],)], "refs array<struct<kind: string, id: string, period_end: date>>")
    assert [r[0] for r in refs.select(rules.refs_json(F.col("refs"))).collect()] == ['[{"table":"metrics","id":"a|b"},{"table":"sections","id":"x\\"1"}]', "[]"]
    seen = spark.createDataFrame([("1", "r", "s", [("sections", "1", None), ("sections", "2", None), ("metrics", "m", None)])], "cik string, rule_name string, subject string, refs array<struct<kind: string, id: string, period_end: date>>")
    known = spark.createDataFrame([(1,)], "section_id long")
    assert [r.ref.id for r in quality.orphan_references(seen, sections=known).collect()] == ["2"]
    sentences = spark.createDataFrame([("b", 0, "finding:1,obs:2,finding:9,note:1")], "brief_id string, position int, refs string")
    findings, observations = spark.createDataFrame([(1, "h")], "finding_id long, headline string"), spark.createDataFrame([(2, "It fell.")], "id long, statement string")
    out = sorted(briefs.resolved_references(sentences, findings, observations).collect(), key=lambda r: r.k)
    assert [(r.kind, r.finding and r.finding.headline, r.observation and r.observation.statement) for r in out] == [("finding", "h", None), ("observation", None, "It fell."), ("finding", None, None), (None, None, None)]


def test_rates_by_prompt_version(spark):
    analyses = spark.createDataFrame([(1, "v1", '{"findings": [1, 2, 3]}'), (2, "v1", '{"findings": []}'), (3, "v2", "{}"), (4, "v2", None), (5, "v3", "not json")], "id long, prompt_version string, output_json string")
    kept = spark.createDataFrame([(1,), (1,)], "analysis_id long")
    assert {r.prompt_version: (r.returned, r.kept, r.discarded, round(r.discard_rate, 6)) for r in analysis.discard_rates(analyses, kept).collect()} == {"v1": (3, 2, 1, 0.333333), "v2": (0, 0, 0, 0.0), "v3": (0, 0, 0, 0.0)}
    tiers = spark.createDataFrame([(1, "5", "in_quote"), (1, "6", "unsupported"), (1, "7", "unsupported"), (2, "8", "in_note_only")], "finding_id long, number string, tier string")
    versions = spark.createDataFrame([(1, "v1"), (2, "v1"), (3, "v1")], "finding_id long, prompt_version string")
    row = analysis.support_rates(tiers, versions).first()
    assert (row.checked, row.in_quote, row.in_note_only, row.derived_verified, row.findings_with_unsupported, row.support_rate) == (4, 1, 1, 0, 1, 0.5)
