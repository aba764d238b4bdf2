"""Snapshots that change bucket by bucket, the content store, and digests of buckets."""

import datetime
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from factlens.operators import rules, stores
from factlens.storage import Folders, materialize


def files(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in pathlib.Path(path).rglob("*.parquet") if "lists" not in f.parts}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, sub string, v double")


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    store = stores.Snapshot(spark, str(tmp_path / "s"), ["k", "sub"], ["v"], ["k"], buckets=8)
    first = store.merge(rows(spark, *[(k, "a", float(k)) for k in range(60)], (None, None, 1.0)))
    assert {r._change for r in first.collect()} == {"insert"} and first.count() == 61
    before, places = files(store.folders.path), store.folders.places()

    out = store.merge(rows(spark, (5, "a", 50.0), (5, "b", None), (7, "a", 7.0)))
    assert sorted((r.k, r.sub, r._change) for r in out.collect() if r._change != "same") == [(5, "a", "update"), (5, "b", "insert")]
    after = files(store.folders.path)
    assert all(after[f] == x for f, x in before.items())  # files of every other bucket, and of the version before, are as they were
    changed = {b for b, v in store.folders.places().items() if places.get(b) != v}
    assert len(changed) == 1 and len(places) > 3
    assert {r.v for r in store.read().filter("k = 5").collect()} == {50.0, None}
    assert store.read().count() == 62

    version = store.folders.version()
    assert {r._change for r in store.merge(rows(spark, (5, "b", None), (None, None, 1.0))).collect()} == {"same"}
    assert store.folders.version() == version and store.merge(rows(spark, (1, "a", 1.0)).limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        store.merge(rows(spark, (1, "a", 1.0), (1, "a", 2.0)))


def test_a_write_that_did_not_end_is_not_read(spark, tmp_path):
    store = Folders(spark, str(tmp_path / "f"), "bucket")
    assert store.read() is None and store.version() == 0
    store.write(spark.createDataFrame([(1, 0), (2, 1)], "v long, bucket int"))
    spark.createDataFrame([(9, 0)], "v long, bucket int").write.partitionBy("bucket").parquet(f"{store.path}/{store.VERSION}=2")
    assert sorted(r.v for r in store.read().collect()) == [1, 2]
    with pytest.raises(Exception, match="already exists"):  # a second writer of the same version
        store.write(spark.createDataFrame([(3, 0)], "v long, bucket int"), {0})
    assert {r.v for r in store.read({1}).collect()} == {2}


def observations(spark, *values):
    ref = [("metrics", "x", None)]
    full = [(c, f"{c}-1", p, r, "v4" if r == "section_appeared" else "v2", s, "medium", "It did.", ref) for c, p, r, s in values]
    schema = "cik string, accession_no string, period_end string, rule_name string, rule_version string, subject string, severity string, statement string, refs array<struct<kind: string, id: string, period_end: string>>"
    out = spark.createDataFrame(full, schema).withColumn("period_end", F.to_date("period_end"))
    return out.withColumn("refs", F.transform("refs", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), F.col("period_end"))))


def test_engine_runs_into_a_store(spark, tmp_path):
    store = rules.store(spark, str(tmp_path / "o"), buckets=16)
    plain = spark.createDataFrame([("Dull",)], "subject string")
    one = observations(spark, *[(str(k), "2020-03-31", "section_appeared", f"Note {k}") for k in range(40)], ("1", "2020-03-31", "metric_sigma_move", "Dull"))
    first = rules.run([one], plain, store)
    assert {r._change for r in first.collect()} == {"insert"} and first.count() == 41
    assert {r.severity for r in store.read().filter("subject = 'Dull'").collect()} == {"low"}
    before, places = files(store.folders.path), store.folders.places()
    # a company that comes later meets a peer that is stored only
    late = observations(spark, ("99", "2020-06-30", "section_appeared", "Note 3"), ("99", "2023-06-30", "section_appeared", "Note 4"))
    out = {r.subject: r for r in rules.run([late], plain, store).filter("cik = '99'").collect()}
    assert out["Note 3"].severity == "low" and "Other companies" in out["Note 3"].statement and out["Note 4"].severity == "medium"
    assert all(files(store.folders.path)[f] == x for f, x in before.items())
    assert sum(places.get(b) != v for b, v in store.folders.places().items()) == 1
    later = late.withColumn("refs", F.transform("refs", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), F.date_add(x["period_end"], 1).alias("period_end"))))
    version = store.folders.version()
    with pytest.raises(ValueError, match="later period"):
        rules.run([later], plain, store)
    assert store.folders.version() == version


def test_contents_are_stored_once_and_verified(spark, tmp_path):
    store = stores.ContentStore(spark, str(tmp_path / "c"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    assert store.read().count() == 0 and store.damaged().count() == 0
    refs = store.add(docs)
    assert refs.columns == ["id", "text_hash"] and store.read().count() == 3
    again = store.add(docs.unionByName(spark.createDataFrame([(6, "c"), (7, "b")], "id long, text string")))
    assert store.read().count() == 4 and again.count() == 7
    assert sorted((r.id, r.text) for r in store.texts(again).collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c"), (7, "b")]
    found = store.read().filter("text = 'c'").first()
    wrong = spark.createDataFrame([("0" * 64, "not its text", 0)], "text_hash string, text string, folder int")
    wrong.write.mode("append").partitionBy("folder").parquet(store.path)
    assert [(r.text_hash, r.problem) for r in store.damaged().collect()] == [("0" * 64, "mismatch")]
    assert store.texts(spark.createDataFrame([(found.text_hash,)], "text_hash string")).first().text == "c"
    for bad in ("0" * 64, "f" * 64):  # damaged, missing
        with pytest.raises(Exception, match="no such content"):
            store.texts(spark.createDataFrame([(bad,)], "text_hash string")).collect()


def test_migration_is_whole_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string").withColumn("text_hash", F.sha2("text", 256))
    bad = docs.withColumn("text_hash", F.when(F.col("id") == 2, F.lit("0")).otherwise(F.col("text_hash")))
    for wrong in (bad, docs.withColumn("text_hash", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="stored hash"):
            stores.migrate(wrong, str(tmp_path / "m"))
        assert not (tmp_path / "m").exists()
    kept = stores.migrate(docs, str(tmp_path / "m"))
    store = stores.ContentStore(spark, str(tmp_path / "m"))
    assert sorted((r.id, r.text) for r in store.texts(kept).collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, None)] and "text" not in kept.columns
    with pytest.raises(ValueError, match="already"):
        stores.migrate(docs, str(tmp_path / "m"))


def test_only_differing_buckets_are_compared(spark):
    stored = spark.createDataFrame([(str(k), k % 5, "x") for k in range(200)] + [("7", 0, "y")] * 2, "cik string, n long, statement string")
    fresh = stored.withColumn("statement", F.when(F.col("cik") == "42", "z").otherwise(F.col("statement"))).filter("not (cik = '7' and statement = 'y')").unionByName(stored.filter("cik = '7' and statement = 'y'").limit(1))
    columns = ["cik", "n", "statement"]
    found = stores.differing_rows(stored, fresh, columns, ["cik"], 32)
    assert sorted(tuple(r) for r in found.collect()) == [("42", 2, "x", 1, 0), ("42", 2, "z", 0, 1), ("7", 0, "y", 2, 1)]
    assert stores.differing_rows(stored, stored.repartition(3), columns, ["cik"], 32).count() == 0
    wanted = {r[0] for r in stored.filter("cik in ('42', '7')").select(stores.bucket_of(["cik"], 32)).collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(str(b) in plan for b in wanted) and "Join" not in plan
    digests = {r.bucket: (r.n, r.digest) for r in stores.bucket_digests(stored, columns, ["cik"], 32).collect()}
    other = {r.bucket: (r.n, r.digest) for r in stores.bucket_digests(fresh, columns, ["cik"], 32).collect()}
    assert {b for b in digests if digests[b] != other.get(b)} == wanted


def test_added_facts_read_only_their_companies(spark, tmp_path, monkeypatch):
    """Quarters added one after the other, then a restated past, against a run over everything."""
    import datetime as dt
    import random

    from factlens.operators import incremental
    from factlens.operators.metrics import compute_metrics

    rng, quarters = random.Random(3), [dt.date(2015 + k // 4, 3 * (k % 4) + 1, 1) for k in range(24)]
    end = lambda q: (q.replace(month=q.month + 2) + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    values = {(c, q): rng.gauss(100, 3) * (5 if rng.random() < 0.15 else 1) for c in "12345" for q in quarters}
    shares = {k: (0.1 + 0.02 * rng.random(), 0.6 + 0.05 * rng.random()) for k in values}
    schema = "cik string, concept string, unit string, period_start date, period_end date, filed_date date, version long, value double"

    def facts(which, version=0, times=1.0):
        rows = []
        for c, q in which:
            for tag, share in (("Revenues", 1.0), ("NetIncomeLoss", shares[c, q][0]), ("CostOfRevenue", shares[c, q][1])):
                rows.append((c, tag, "USD", q, end(q), end(q) + dt.timedelta(days=30 + version), version, values[c, q] * share * times))
        return spark.createDataFrame(rows, schema)

    filings = spark.createDataFrame([(f"{c}-{q}", c, "10-Q", end(q), q.year, f"Q{q.month // 3 + 1}") for c, q in values], "accession_no string, cik string, form_type string, period_end date, fiscal_year int, fiscal_period string")
    read = []
    monkeypatch.setattr(incremental, "compute_metrics", lambda f, *a, **b: (read.append({r.cik for r in f.select("cik").distinct().collect()}), compute_metrics(f, *a, **b))[1])
    kept = incremental.Kept(spark, str(tmp_path / "k"), [x.split()[0] for x in schema.split(", ")], 8)
    every = facts((c, q) for c, q in values if q < quarters[20])
    found = [kept.add(every, filings)]
    places = kept.metrics.folders.places()
    for batch in (facts([("2", quarters[20])]), facts([("2", q) for q in quarters[21:23]] + [("4", quarters[20])])):
        found.append(kept.add(batch, filings))
        every = every.unionByName(batch)
    assert read[1:] == [{"2"}, {"2", "4"}] and sum(v != places.get(b) for b, v in kept.metrics.folders.places().items()) <= 2
    shown = lambda df: sorted((r.cik, r.subject, str(r.period_end), r.statement) for r in df.collect())
    full = compute_metrics(every, filings, provenance=False)
    want = shown(rules.sigma_move(rules.metric_rows(full, filings)))
    assert sorted(x for f in found for x in shown(f)) == want and len(want) > 5

    past = facts([("2", quarters[5])], 1, 3.0)
    again = kept.add(past, filings)
    full = compute_metrics(every.unionByName(past), filings, provenance=False)
    want = rules.sigma_move(rules.metric_rows(full, filings)).filter("cik = '2'")
    changed = {(r.cik, r.subject) for r in again.collect()}
    assert set(shown(again)) <= set(shown(want)) and changed and {x for x in shown(want) if (x[0], x[1]) in changed} == set(shown(again))
    same = lambda df: sorted((r.cik, r.name, r.cls, str(r.period_end), r.value is None, round(r.value or 0, 6)) for r in df.collect())
    assert same(kept.metrics.read()) == same(full)
    moments = {(r.cik, r.name): (r.n, round(r.mean, 6), round(r.m2, 3)) for r in kept.moments.read().collect()}
    assert moments == {(r.cik, r.name): (r.n, round(r.mean, 6), round(r.m2, 3)) for r in incremental.moments(rules.sigma_rows(rules.metric_rows(full, filings))).collect()}
    version = kept.metrics.folders.version()
    assert kept.add(past, filings).count() == 0 and kept.metrics.folders.version() == version


def test_what_is_written_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(k).getName() for k in range(blocks.size()) if blocks.apply(k).getName().startswith("shuffle_")}

    before = files()
    rows = materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "rows")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_merge_joins_only_what_shares_its_place_with_an_update(spark, tmp_path, monkeypatch):
    store = stores.Snapshot(spark, str(tmp_path / "s"), ["k", "sub"], ["v"], ["k"], buckets=2)
    joined, changes_of = [], stores.null_safe_changes
    monkeypatch.setattr(stores, "null_safe_changes", lambda old, new, *more: joined.append(old.count()) or changes_of(old, new, *more))
    first = rows(spark, *[(k, s, 1.0) for k in [None, *range(20)] for s in ("a", None)])
    assert {r._change for r in store.merge(first).collect()} == {"insert"} and not joined  # nothing was there to be joined
    found = store.merge(rows(spark, (3, "a", 2.0), (None, None, 2.0), (99, None, 1.0))).collect()
    assert joined == [4] and {(r.k, r.sub, r.v, r._change) for r in found if r._change != "same"} == {(3, "a", 2.0, "update"), (None, None, 2.0, "update"), (99, None, 1.0, "insert")}
    after = {(r.k, r.sub): r.v for r in store.read().collect()}
    assert len(after) == 43 and sum(v == 2.0 for v in after.values()) == 2 and len(found) <= 43


def test_a_refused_first_merge_leaves_the_store_empty(spark, tmp_path):
    store = stores.Snapshot(spark, str(tmp_path / "s"), ["k", "sub"], ["v"], ["k"], buckets=2)
    with pytest.raises(ValueError, match="key twice"):
        store.merge(rows(spark, (1, None, 1.0), (1, None, 2.0), (2, "a", 1.0)))
    assert store.read() is None and not store.folders.version()
    store.merge(rows(spark).limit(0))
    assert store.read() is None and not store.folders.version()
    store.merge(rows(spark, (1, None, 1.0)))
    assert [tuple(r) for r in store.read().collect()] == [(1, None, 1.0)]


def test_engine_computes_what_section_rules_found_once(spark):
    from factlens.plans import runs

    looked = spark.sparkContext.accumulator(0)

    def statement(subject):
        looked.add(1)
        return f"about {subject}"

    schema = "cik string, accession_no string, period_end date, rule_name string, rule_version string, subject string, severity string, refs array<struct<kind:string,id:string,period_end:date>>"
    day = datetime.date(2022, 12, 31)
    none = spark.createDataFrame([], schema).withColumn("statement", F.lit("s"))
    found = spark.createDataFrame([(f"c{k}", f"a{k}", day, "section_length_change", "v1", f"Note {k}", "medium", []) for k in range(5)], schema)
    found = found.repartition(2, "cik").withColumn("statement", F.udf(statement)("subject"))
    out = runs.stored_engine(spark, "", [none, found, none.limit(0)]).collect()
    assert {(r.subject, r.statement, r._change) for r in out} == {(f"Note {k}", f"about Note {k}", "same") for k in range(5)} and looked.value == 5


def test_period_mixing_writes_no_table_of_metrics(spark, monkeypatch):
    from factlens.plans import checks, common

    common.forget()
    written = []
    monkeypatch.setattr(common, "materialize", lambda rows, name: written.append(name) or materialize(rows, name))
    checks.period_mixing(spark, "/root/testdata/sf0.001").schema  # noqa: B018
    assert "facts" in written and "metrics" not in written
