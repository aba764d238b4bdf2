"""Matching a row with an earlier one, or with peers: by days within a tolerance, or by fiscal label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.registry import PEER_DAYS


def nearest_prior(df: DataFrame, keys: list[str], start: str, end: str, offset: int, tolerance: int, carried: Column | None = None) -> Column:
    """Struct (end, start) of the period, and what its row has ``carried`` if that is given, whose end is closest to ``offset`` days before, within ``tolerance``; else null.

    Of equally close ones the later end, then the later start wins. Two range frames over days give the last row up to the day
    looked for and the first one from it on, so there is no join, and no list of candidates; the frames never reach the row
    itself as long as the offset is the larger one.
    """
    if tolerance >= offset:
        raise ValueError("the tolerance must stay below the offset")
    day, began = F.unix_date(end), F.unix_date(start)
    w = Window.partitionBy(*keys).orderBy(day)
    more = [] if carried is None else [carried.alias("carried")]
    low = F.max(F.struct(day.alias("e"), began.alias("s"), *more)).over(w.rangeBetween(-(offset + tolerance), -offset))
    high = F.min(F.struct(day.alias("e"), (-began).alias("s"), *more)).over(w.rangeBetween(-offset, -(offset - tolerance)))
    later = low.isNull() | (high["e"] - (day - offset) <= (day - offset) - low["e"])
    out = F.struct(F.date_from_unix_date(low["e"]).alias("end"), F.date_from_unix_date(low["s"]).alias("start"), *([] if carried is None else [low["carried"].alias("carried")]))
    other = F.struct(F.date_from_unix_date(high["e"]).alias("end"), F.date_from_unix_date(-high["s"]).alias("start"), *([] if carried is None else [high["carried"].alias("carried")]))
    return F.when(high.isNotNull() & later, other).when(low.isNotNull(), out)


def label_prior(df: DataFrame, identity: list[str], columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the row of the same identity and fiscal period a fiscal year before, as prior_*."""
    before = df.select(*identity, (F.col("fiscal_year") + 1).alias("fiscal_year"), "fiscal_period", *[F.col(c).alias(f"prior_{c}") for c in columns])
    return df.join(before, [*identity, "fiscal_year", "fiscal_period"], "left")


def with_peer(rows: DataFrame, entity: str, keys: list[str], date: str, days: int = PEER_DAYS, others: DataFrame | None = None) -> DataFrame:
    """Rows with peer: whether another entity has a row with the same keys within so many days, among these or ``others``.

    Only the smallest and largest entity of each day count, so that the window holds a row a day however many entities
    share the keys.
    """
    every = rows.select(entity, *keys, date)
    if others is not None:
        every = every.unionByName(others.select(entity, *keys, date).join(rows.select(*keys).distinct(), keys, "left_semi"))
    day = every.groupBy(*keys, date).agg(F.min(entity).alias("_low"), F.max(entity).alias("_high"))
    near = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-days, days)
    peers = day.select(*keys, date, (F.min("_low").over(near) != F.max("_high").over(near)).alias("peer"))
    return rows.join(peers, [*keys, date])
