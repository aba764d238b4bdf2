"""What grows with the tables: results of the ways that stay small are those of plain ones, and plans hold nothing large in one place."""

import datetime as dt

from factlens.operators import facts, quality, rules
from factlens.streaming import keyed


def test_ids_are_never_broadcast(spark, tmp_path):
    """A table of ids whose file is small has too many ids for the driver."""
    refs = "cik string, rule_name string, subject string, refs array<struct<kind: string, id: string, period_end: date>>"
    seen = spark.createDataFrame([("1", "r", "s", [("metrics", "1|m|annual|2020-12-31", None), ("metrics", "1|n|annual|2020-12-31", None)])], refs)
    spark.createDataFrame([("1", "m", "annual", "2020-12-31"), ("1", "m", "annual", "2020-12-31")], "cik string, name string, cls string, period_end string").write.parquet(str(tmp_path / "metrics"))
    found = quality.orphan_references(seen, spark.read.parquet(str(tmp_path / "metrics")))
    assert [r.ref.id for r in found.collect()] == ["1|n|annual|2020-12-31"]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_periods_by_one_shuffle(spark):
    """Wide rows dealt out by company are those of joins, with the filings of their periods; odd facts give none."""
    f = "cik string, concept string, unit string, period_start date, period_end date, version int, value double, filed_date date"
    day = dt.date
    q1, q2, half = (day(2020, 1, 1), day(2020, 3, 31)), (day(2020, 4, 1), day(2020, 6, 30)), (day(2020, 1, 1), day(2020, 6, 30))
    rows = [(c, "Revenues", "USD", *p, v, float(k + v), day(2020, 8, 1 + v)) for c in ("1", "2", None) for k, p in enumerate((q1, q2, half)) for v in (0, 1)]
    rows += [(c, "Assets", "USD", None, end, 0, 7.0, None) for c in ("1", "3") for end in (q1[1], q2[1], None)] + [("1", "Unknown", "USD", *q1, 0, 1.0, None), ("2", "Revenues", "USD", q1[0], None, 0, 1.0, None)]
    given = spark.createDataFrame(rows, f)
    filings = spark.createDataFrame([("1", "10-Q", q1[1], "a"), ("1", "10-Q", q1[1], "b"), ("1", "10-K", q2[1], "c"), ("2", "10-Q", q2[1], "d"), ("2", "8-K", q1[1], "e"), (None, "10-Q", q1[1], "f")], "cik string, form_type string, period_end date, accession_no string")
    found = facts.wide_periods(given, filings, ("accession_no",))
    latest = facts.latest_filed(given)
    want = facts.wide(facts.resolve(latest), facts.period_spine(latest, filings)).filter("cik is not null and period_end is not null")
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 4
    assert {(r.cik, r.cls): sorted(x.accession_no for x in r.filed) for r in found.collect()} == {("1", "quarterly"): ["a", "b"], ("2", "quarterly"): ["d"], ("1", "half-year"): [], ("2", "half-year"): []}
    plan = facts.wide_periods(given, filings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cik") == 2, plan  # facts and filings, once each


def test_year_before_without_a_join(spark):
    row = "cik string, name string, cls string, period_end string, fiscal_year int, fiscal_period string, value double"
    rows = spark.createDataFrame([("1", "m", "annual", "2020", 2020, "FY", 1.0), ("1", "m", "annual", "2021", 2021, "FY", None), ("1", "m", "annual", "2021b", 2021, "FY", 5.0), ("1", "m", "annual", "2022", 2022, "FY", 2.0), ("1", "m", "annual", "x", None, "FY", 3.0), ("1", "m", "annual", "y", 2022, None, 3.0), (None, "m", "annual", "2021", 2021, "FY", 4.0), (None, "m", "annual", "2020", 2020, "FY", 4.0)], row)
    found = rules.with_label_prior(rows)
    got = sorted((str(r.period_end), str(r.year_before and (r.year_before.id, r.year_before.value))) for r in found.collect())
    assert got == sorted((p, str(b)) for p, b in [("2020", None), ("2021", ("1|m|annual|2020", 1.0)), ("2021b", ("1|m|annual|2020", 1.0)), ("2022", ("1|m|annual|2021", None)), ("2022", ("1|m|annual|2021b", 5.0)), ("x", None), ("y", None), ("2021", None), ("2020", None)])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_streams_call_for_companies_and_buckets(spark, tmp_path):
    """State has a row a company, however many periods it has, and a row a bucket of filings; each period is still judged by itself."""
    day = dt.date(2020, 3, 31)
    given = spark.createDataFrame([("1", "Revenues", "USD", None, day + dt.timedelta(days=k), v, float(k), dt.date(2022, 1, 2 - v)) for k in range(50) for v in (0, 1)], "cik string, concept string, unit string, period_start date, period_end date, version long, value double, filed_date date")
    begun = spark.createDataFrame([(f"f{k}", n, 2, n > 0, dt.datetime(2024, 1, 1)) for k in range(50) for n in (0, 1)], "accession_no string, part int, parts int, ok boolean, at timestamp")
    rows = {}
    for name, table, stream in (("facts", given, keyed.restatements), ("parts", begun, lambda x: keyed.statuses(x, buckets=4))):
        table.write.parquet(str(tmp_path / name))
        with keyed.rocksdb(spark):
            source = spark.readStream.schema(table.schema).parquet(str(tmp_path / name))
            query = stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / f"{name}-out"))
            query = query.trigger(availableNow=True).start()
            query.awaitTermination()
        rows[name] = query.recentProgress[0].stateOperators[0].numRowsTotal
    assert rows["facts"] == 1 and rows["parts"] <= 4, rows
    found = spark.read.parquet(str(tmp_path / "facts-out")).groupBy("effect").count().collect()
    assert {(r.effect, r["count"]) for r in found} == {("first", 50), ("late", 50)}


def test_texts_are_dealt_out_however_files_lie(spark, monkeypatch):
    """Documents of one row group are measured in many tasks, and sections are those of the plain view."""
    from factlens.bindings import view
    from factlens.plans import texts

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(texts, "DOCUMENTS_A_TASK", 20)
    assert spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions() == 1
    assert texts.documents(spark, folder).rdd.getNumPartitions() >= 10 and texts.words(spark, folder).rdd.getNumPartitions() >= 10
    plain = view(spark, folder, "sections")
    assert sorted(texts.sections(spark, folder).select(plain.columns).collect()) == sorted(plain.collect())


def test_latest_values_of_tags_in_few_buffers(spark):
    """Of each tag the version filed last, of tags the first priority, null values included, by one aggregation that keeps no list."""
    day = dt.date
    f = "cik string, concept string, unit string, period_start date, period_end date, version int, value double, filed_date date"
    start, end = day(2020, 1, 1), day(2020, 3, 31)
    second = "RevenueFromContractWithCustomerExcludingAssessedTax"
    rows = [("1", "Revenues", "USD", start, end, 0, 1.0, day(2020, 5, 1)), ("1", "Revenues", "USD", start, end, 1, 2.0, None), ("1", second, "USD", start, end, 0, 3.0, None), ("2", second, "USD", start, end, 0, 4.0, None), ("2", second, "USD", start, end, 1, 5.0, None)]
    rows += [("3", "Revenues", "USD", start, end, 0, 6.0, day(2020, 5, 1)), ("3", "Revenues", "USD", start, end, 0, None, day(2020, 6, 1)), ("1", "Assets", "USD", None, end, 0, 7.0, None), ("1", "Assets", "USD", start, end, 0, 8.0, None), ("1", "Revenues", "EUR", start, end, 9, 9.0, None)]
    found = facts.by_period(spark.createDataFrame(rows, f), 3)
    want = facts.resolve(facts.latest_filed(spark.createDataFrame(rows, f)))
    wanted = {(r.cik, r.period_start, r.canonical): (r.value, r.priority) for r in want.collect()}
    got = {(r.cik, r.period_start, c.name): (r[f"{c.name}_v"], r[f"{c.name}_p"]) for r in found.collect() for c in facts.CONCEPTS if r[f"{c.name}_p"] is not None}
    assert got == wanted and len(got) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and found.rdd.getNumPartitions() == 3


def test_eligible_without_sorting(spark):
    """Counts of what rules could have said are sums: no window, no join, nothing held by history."""
    row = "cik string, name string, cls string, period_start date, period_end date, fiscal_year int, fiscal_period string, value double, extreme boolean, headline boolean"
    rows = [("1", "current_ratio", "annual", None, dt.date(2000 + k, 12, 31), 2000 + k, "FY", None if k == 3 else float(k), True, True) for k in range(7)]
    rows += [("1", "current_ratio", "quarterly", None, dt.date(2000 + k, 3, 31), 2000 + k, "Q1" if k else None, 1.0, True, True) for k in range(9)] + [("2", "roe", "annual", None, dt.date(2000, 12, 31), 2000, "FY", None, True, True)]
    found = rules.eligible_counts(spark.createDataFrame(rows, row))
    got = {(r.cik, r.rule_name): r.eligible for r in found.collect()}
    assert got == {("1", "metric_multi_year_extreme"): 3, ("1", "metric_sigma_move"): 1, ("1", "metric_threshold_cross"): 14, ("1", "metric_divergence"): 0, ("1", "metric_stopped_computing"): 12, ("2", "metric_stopped_computing"): 0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan, plan


def test_tags_are_compared_where_facts_lie(spark):
    """Facts that were dealt out by company are not shuffled again to compare tags, and their tasks are those of facts."""
    f = "cik string, concept string, unit string, period_start date, period_end date, value double"
    start, end = dt.date(2020, 1, 1), dt.date(2020, 3, 31)
    second = "RevenueFromContractWithCustomerExcludingAssessedTax"
    rows = [(c, t, "USD", start, e, v) for c, e in (("1", end), ("2", end), (None, end), ("1", None)) for t, v in (("Revenues", 1.0), (second, 2.0 if c == "1" else 1.001))]
    found = facts.tag_disagreements(spark.createDataFrame(rows, f).repartition(3, "cik"))
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    assert [(r.cik, r.tag_a, r.tag_b, r.value_a, r.value_b) for r in found.collect()] == [("1", second, "Revenues", 2.0, 1.0)]


def test_null_reasons_need_no_provenance(spark, monkeypatch):
    """Reasons are counted from values alone: formulas and inputs of all metrics are not made for them."""
    from factlens.plans import common, filings

    def never(*_):
        raise AssertionError("metrics with formulas and inputs were asked for")

    monkeypatch.setattr(common, "metrics", never)
    monkeypatch.setattr(filings, "metrics", never)
    assert filings.null_reasons_of_seven(spark, "/root/testdata/sf0.001").count() and filings.metric_null_reasons(spark, "/root/testdata/sf0.001").count()
