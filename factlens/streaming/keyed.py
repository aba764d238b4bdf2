"""Keyed state on Structured Streaming: restated facts, and filings whose parts arrive one by one.

What came before is kept by key in the state store, so a batch reads what it holds and the state of its own keys, never the
history. The store is RocksDB's, which keeps state on disk and checkpoints what changed.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factlens.operators.facts import NO_DATE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: How long the parts of a filing may take, and how far events may come out of order.
LIMIT, DELAY = "4 hours", "1 hour"
#: Groups of filings whose open ones share a state.
BUCKETS = 512


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def restatements(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """Filed versions of a stream of facts, each once, with their effect on the value known by then.

    A version is told by its fact (company, concept, unit, period) and the day it was filed; one that came before, in this
    batch or an earlier one, is a replay and is dropped. Effect: first; restates (filed after all versions known); late (filed
    before one that is known, which stays the latest). Of versions that come in one batch the lower ``version`` is first.

    State is kept by company, so that a batch calls for each company and not for each of its periods. With ``keep`` (a time
    such as "400 days") what is known of a period without news for so long is dropped, and a replay after that would count as
    first. Nulls are keys like any other: no date is the earliest day; a batch without rows changes nothing.
    """
    wait = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def met(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        facts, ends, days, periods, news = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        heard, changed = dict(zip(periods, news, strict=True)), False
        if wait is not None:
            now = state.getCurrentProcessingTimeMs()
            heard = {end: at for end, at in heard.items() if at + wait > now}
            kept = [k for k, end in enumerate(ends) if end in heard]
            changed = len(kept) < len(ends)
            facts, ends, days = ([x[k] for k in kept] for x in (facts, ends, days))
        found = []
        if not state.hasTimedOut:
            seen, latest = set(zip(facts, ends, days, strict=True)), {}
            for fact, end, day in seen:
                latest[fact, end] = max(day, latest.get((fact, end), day))
            rows = [r for x in frames for r in zip(x.place.tolist(), x.day.tolist(), x.fact.tolist(), x.end.tolist(), x.row.tolist(), strict=True)]
            for _, day, fact, end, row in sorted(rows, key=lambda r: r[:2]):
                if wait is not None:
                    heard[end], changed = now, True
                if (fact, end, day) not in seen:
                    known = latest.get((fact, end))
                    found.append((row, "first" if known is None else "restates" if day > known else "late"))
                    seen.add((fact, end, day))
                    latest[fact, end] = day if known is None else max(day, known)
                    facts.append(fact)
                    ends.append(end)
                    days.append(day)
        if found or (changed and facts):
            state.update((facts, ends, days, list(heard), list(heard.values())))
        elif changed and state.exists:
            state.remove()
        if wait is not None and facts:
            state.setTimeoutDuration(max(1, min(heard.values()) + wait - now))
        yield pd.DataFrame(found, columns=["row", "effect"])

    fact = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("concept", "unit", "period_start")])).alias("fact")
    day, place = F.coalesce(F.unix_date("filed_date"), F.lit(NO_DATE)).alias("day"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("place")
    packed, end = F.to_json(F.struct(*stream.columns)).alias("row"), F.coalesce(F.unix_date("period_end"), F.lit(NO_DATE)).alias("end")
    keyed = stream.select("cik", fact, end, day, place, packed).groupBy("cik")
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    held = "fact array<string>, end array<int>, day array<int>, period array<int>, news array<long>"
    out = keyed.applyInPandasWithState(met, "row string, effect string", held, "append", timeout)
    return out.select(F.from_json("row", stream.schema).alias("row"), "effect").select("row.*", "effect")


def statuses(events: DataFrame, limit: str = LIMIT, delay: str = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """What becomes of each filing of a stream of ``events(accession_no, part, parts, ok, at)``: (accession_no, status, reason, at).

    Part 0 starts a filing and says how many ``parts`` it has; parts come in any order. Done: all came in time and went
    well. Retry: all came and one failed, or, as a timer tells, one didn't come within ``limit`` of the start, whatever
    comes later. Each filing ends once, at the time of its last part or of the limit; another attempt has another number.
    Of a part that comes twice the earlier counts; a part without an outcome (null) failed, an event without a time is left
    out. Parts whose start doesn't come are forgotten after as long.

    State is kept by ``buckets`` of filings (a number that stays while a stream does), each with those that are open alone, so
    that a batch calls for each bucket and not for each filing.
    """
    wait = int(pd.Timedelta(limit).total_seconds() * 1000)

    def met(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, starts, sizes, owners, numbers, fine, times = state.get if state.exists else ([],) * 7
        filings = {name: [start, size, []] for name, start, size in zip(names, starts, sizes, strict=True)}
        for owner, n, ok, t in zip(owners, numbers, fine, times, strict=True):
            filings[names[owner]][2].append((t, n, ok))
        came, late, ended, due = set(), state.getCurrentWatermarkMs(), [], []
        if not state.hasTimedOut:
            rows = [r for x in frames for r in zip(x.ms.tolist(), x.part.tolist(), x.parts.tolist(), x.ok.tolist(), x.accession_no.tolist(), strict=True)]
            for t, n, size, ok, name in sorted(rows, key=lambda r: r[0]):
                filing = filings.setdefault(name, [-1, 0, []])
                came.add(name)
                if n == 0 and filing[0] < 0:
                    filing[:2] = [t, size]
                elif n > 0:
                    filing[2].append((t, n, ok))
        for name, (started, parts, given) in list(filings.items()):
            end = None
            over = (started if started >= 0 else max((t for t, _, _ in given), default=late)) + wait
            if started >= 0 and name in came:
                first: dict[int, tuple[int, bool]] = {}
                for t, n, ok in sorted(given):
                    if t <= started + wait and 1 <= n <= parts:
                        first.setdefault(n, (t, ok))
                if len(first) == parts:
                    well = all(ok for _, ok in first.values())
                    end = ("done" if well else "retry", "complete" if well else "failed part", max([started, *(t for t, _ in first.values())]))
            if end is None and started >= 0 and over < late:
                end = ("retry", "timed out", over)
            if end:
                ended.append((name, *end))
            if end or (started < 0 and over < late and name not in came):
                del filings[name]
            else:
                due.append(max(late + 1, over))
        if filings:
            parts = [(k, n, ok, t) for k, (_, _, given) in enumerate(filings.values()) for t, n, ok in given]
            state.update((list(filings), [f[0] for f in filings.values()], [f[1] for f in filings.values()], *([p[c] for p in parts] for c in range(4))))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ended, columns=["accession_no", "status", "reason", "ms"])

    rows = events.filter("at is not null and part is not null").withWatermark("at", delay)
    rows = rows.select(F.pmod(F.xxhash64("accession_no"), F.lit(buckets)).alias("bucket"), "accession_no", "part", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("ok", F.lit(False)).alias("ok"), "at", F.unix_millis("at").alias("ms"))
    held = "names array<string>, starts array<long>, sizes array<int>, owners array<int>, numbers array<int>, fine array<boolean>, times array<long>"
    out = rows.groupBy("bucket").applyInPandasWithState(met, "accession_no string, status string, reason string, ms long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("accession_no", "status", "reason", F.timestamp_millis("ms").alias("at"))


def statuses_at_once(events: DataFrame, limit: str = LIMIT) -> DataFrame:
    """``statuses`` of a table that holds all events there are."""
    events = events.filter("at is not null").withColumn("ok", F.coalesce("ok", F.lit(False)))
    starts = events.filter("part = 0").groupBy("accession_no").agg(F.min("at").alias("started"), F.min_by("parts", "at").alias("parts"))
    first = events.filter("part > 0").drop("parts").join(starts, "accession_no").filter(F.col("at") <= F.col("started") + F.expr(f"INTERVAL {limit}"))
    first = first.filter("part <= parts").groupBy("accession_no", "part").agg(F.min("at").alias("at"), F.min_by("ok", "at").alias("ok"))
    came = first.groupBy("accession_no").agg(F.count("*").alias("n"), F.bool_and("ok").alias("well"), F.max("at").alias("last"))
    rows = starts.join(came, "accession_no", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "well": F.coalesce("well", F.lit(True))})
    whole = F.col("n") == F.col("parts")
    return rows.select(
        "accession_no",
        F.when(whole & F.col("well"), "done").otherwise("retry").alias("status"),
        F.when(~whole, "timed out").when(F.col("well"), "complete").otherwise("failed part").alias("reason"),
        F.when(whole, F.greatest("started", "last")).otherwise(F.col("started") + F.expr(f"INTERVAL {limit}")).alias("at"),
    )
