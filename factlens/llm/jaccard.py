"""Exact joins of texts whose sets of shingles have a Jaccard similarity of at least 4/5.

Prefix filter: under one order of all shingles, two sets of n and m shingles that are alike share a shingle among the
first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. So only these prefixes are shuffled, pairs that meet there are kept if
the shingles shared can still suffice, and what is left is compared in full. Any order gives the same pairs; shingles
that are common in a sample come last, so that few texts meet at them. Equal sets are merged before that. Where many texts
meet all the same, they are compared with leaders first, and then only those that aren't connected by that. Leaders are the
texts with the fewest shingles of their own: in a large group of near copies those are close to what all are copies of, so
one of them reaches the whole group, and a copy too far from it has so many shingles of its own that its prefix has no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.common import BROADCAST_KEYS, ROW, materialize, sliced, tidy
from factlens.llm.components import components
from factlens.storage import drop_scratch, scratch_path, written

SEED = 42
SHINGLE = 5
#: Documents and shingles that set the order; results don't depend on them.
SAMPLE, COMMON, LEAST = 20_000, 200_000, 3
#: Texts at a prefix shingle beyond which leaders are compared first, and how often; results don't depend on them.
CROWD, ROUNDS = 32, 2
#: Shingles that several texts share may be broadcast up to this number, some 50 MB in memory.
BROADCAST_SHARED = BROADCAST_KEYS // 4


def digests(text: str | None, size: int) -> list[bytes]:
    """A hash of eight bytes for every run of ``size`` words; for all words if there are fewer, none if there are none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and white space of ASCII alone
    if not words:
        return []
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(words) < size:
        return [digest(join(words), SEED)]
    return [digest(join(x), SEED) for x in zip(*(words[k:] for k in range(size)), strict=False)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted signed longs."""
    return np.unique(np.frombuffer(b"".join(digests(text, size)), ">i8").astype(np.int64))


def enough(overlap: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share ``overlap`` have a similarity of 4/5."""
    return 9 * overlap >= 4 * (a + b)


def rest(n: Column) -> Column:
    """How many shingles aren't in the prefix of a set of n."""
    return F.ceil(4 * n / 5) - 1


def common(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample share, sorted, and how many documents they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            sets = [shingles(x.as_py(), size) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["key"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    counts = docs.select("text").sample(share, SEED).mapInArrow(tidy(run), "key long").groupBy("key").count()
    found = sorted((r.key, r["count"]) for r in counts.filter(F.col("count") >= LEAST).orderBy(F.desc("count"), "key").limit(COMMON).collect())
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def prefixes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row number, doc_id, digest of the set, its size n, how many of them no other text of the sample has, its prefix) of every text."""
    keys, counts = common(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(x.as_py(), size) for x in batch.column("text")]
            first, own = [], []
            for s in sets:
                seen = np.zeros(len(s), np.int64)
                if len(keys) and len(s):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    seen = np.where(keys[at] == s, counts[at], 0)
                n = len(s)
                own.append(int((seen == 0).sum()))
                first.append(s[np.argsort(seen, kind="stable")[: n - (4 * n + 4) // 5 + 1]])
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            arrays = [batch.column(ROW), batch.column("doc_id"), pa.array(marks, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[ROW, "doc_id", "digest", "n", "own", "prefix"])

    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), f"{ROW} long, doc_id long, digest binary, n long, own long, prefix array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row number, shingles) of the rows of ``docs`` whose number is in ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = pa.array([shingles(x.as_py(), size) for x in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), sets], names=[ROW, "shingles"])

    if rows.count() <= BROADCAST_KEYS:
        rows = F.broadcast(rows)
    return docs.select(ROW, "text").join(rows, ROW, "left_semi").select(ROW, "text").mapInArrow(tidy(run), f"{ROW} long, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b, na, nb)`` whose sets have a similarity of 4/5."""
    left, right = sets.select(F.col(ROW).alias("a"), F.col("shingles").alias("x")), sets.select(F.col(ROW).alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(enough(shared, F.col("na"), F.col("nb"))).select("a", "b")


def grouped(at: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``at`` with the group of each row number under the links found so far."""
    if edges is None:
        return at.withColumns({"group": F.col("a"), "alone": F.lit(True)})
    nodes = components(edges).withColumnRenamed("node", "a")
    return at.join(nodes, "a", "left").withColumns({"group": F.coalesce("component", "a"), "alone": F.col("component").isNull()}).drop("component")


def met_at(found: DataFrame) -> DataFrame:
    """(key, a, na, own, i): the prefixes of ``found(row number, n, own, prefix)`` unfolded, without shingles that only one prefix has.

    Most are such, so shingles are counted by themselves before anything wider is shuffled or written.
    """
    every = found.select(F.col(ROW).alias("a"), F.col("n").alias("na"), "own", F.posexplode("prefix").alias("i", "key"))
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key"), "shared")
    if shared.count() <= BROADCAST_SHARED:
        shared = F.broadcast(shared)
    return every.join(shared, "key", "left_semi").select("key", "a", "na", "own", "i")


def compared(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Links (a, b): those of ``pairs(a, b, na, nb)``, a written table, that are alike. The sets of their texts are written for this, and removed."""
    rows = materialize(pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct(), "rows")
    path = scratch_path(docs.sparkSession, "sets")
    out = materialize(alike(pairs, written(sets_of(docs, rows, size), path)), "links")
    drop_scratch(docs.sparkSession, path)
    return out


def led(docs: DataFrame, at: DataFrame, size: int, edges: DataFrame | None = None) -> DataFrame | None:
    """Links of the members of crowded prefix shingles to leaders, so that large groups are joined by few comparisons.

    Every round takes as leader of each shingle and size band the text with the fewest shingles of its own, from the second
    round on among those that nothing is linked to yet; what leaders miss is left to the pairs. ``edges`` are links that
    are known before, and come back with the new ones.
    """
    crowd = at.groupBy("key").count().filter(F.col("count") > CROWD).select("key")
    many = materialize(at.join(crowd, "key", "left_semi").withColumn("band", F.floor(F.log("na") / F.log(F.lit(1.25)))), "crowd")
    if not many.limit(1).count():
        return edges
    path = scratch_path(docs.sparkSession, "sets")
    sets = written(sets_of(docs, materialize(many.select(F.col("a").alias(ROW)).distinct(), "rows"), size), path)
    for k in range(ROUNDS):
        now = materialize(grouped(many, edges), "crowd")
        free = F.struct("own", F.xxhash64("a").alias("tie"))
        if k:
            free = F.when(F.col("alone"), free)
        lead = now.groupBy("key", "band").agg(F.min_by(F.struct("a", "na", "group"), free).alias("lead")).filter("lead is not null")
        pairs = now.join(lead, ["key", "band"]).filter(F.col("group") != F.col("lead.group"))
        pairs = pairs.filter(5 * F.least("na", "lead.na") >= 4 * F.greatest("na", "lead.na"))
        pairs = materialize(pairs.select("a", F.col("lead.a").alias("b"), "na", F.col("lead.na").alias("nb")).distinct(), "pairs")
        new = materialize(alike(pairs, sets), "links")
        edges = new if edges is None else edges.union(new)
    drop_scratch(docs.sparkSession, path)
    return edges


def links(docs: DataFrame, found: DataFrame, size: int = SHINGLE, edges: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of row numbers in ``found(row number, n, own, prefix)``, enough to connect all whose texts are alike.

    The first shingle that two alike sets share, in the order of prefixes, has so few before it in either that what follows
    can still be enough; of the smaller set it is among the first ninth. So only those rows meet that pass both. Then the
    shingles that the two prefixes share are counted, and what can still be alike is compared in full. What ``edges``
    connect isn't compared again.
    """
    at = materialize(met_at(found), "at")
    edges = led(docs, at, size, edges)
    at = grouped(at, edges)
    apart = at.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("key")
    at = materialize(at.join(apart, "key", "left_semi").select("key", "a", "na", "i", "group"), "apart")
    other = at.select("key", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("i").alias("j"), F.col("group").alias("other"))
    na, nb, i, j = (F.col(c) for c in ("na", "nb", "i", "j"))
    small = (na < nb) | ((na == nb) & (F.col("a") < F.col("b")))
    close = (5 * na >= 4 * nb) & enough(F.least(na - i, nb - j), na, nb)
    met = at.filter(9 * (na - i) >= 8 * na).join(other.hint("merge"), "key").filter(small & close & (F.col("group") != F.col("other")))
    met = materialize(met.select("a", "b", "na", "nb").distinct(), "met")
    left, right = found.select(F.col(ROW).alias("a"), F.col("prefix").alias("p")), found.select(F.col(ROW).alias("b"), F.col("prefix").alias("q"))
    shared = F.size(F.array_intersect("p", "q"))
    pairs = met.join(left, "a").join(right, "b").filter(enough(shared + F.greatest(rest(na), rest(nb)), na, nb)).select("a", "b", "na", "nb")
    rest_links = compared(docs, materialize(pairs, "pairs"), size)
    return rest_links if edges is None else edges.union(rest_links)


def similar(docs: DataFrame, size: int = SHINGLE, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Row number, doc_id and group of every document of ``docs`` (numbered rows): the texts linked, directly or over others.

    Texts without a word, null ones too, are alike. Repeated rows come back as often as they are there; a null doc_id is
    carried along; an empty table gives an empty result. Pairs that ``first`` makes of the distinct sets are compared before all others.
    """
    found = materialize(prefixes(docs, size), "prefixes")
    one = materialize(found.groupBy("digest").agg(F.min(ROW).alias("one")), "one")
    alone = found.join(one.select(F.col("one").alias(ROW)), ROW, "left_semi")
    edges = None if first is None else compared(docs, materialize(first(alone), "pairs"), size)
    nodes = components(links(docs, alone, size, edges)).withColumnRenamed("node", "one")
    named = materialize(one.join(nodes, "one", "left").select("digest", F.coalesce("component", "one").alias("group")), "groups")
    return found.select(ROW, "doc_id", "digest").join(named, "digest").select(ROW, "doc_id", "group")
