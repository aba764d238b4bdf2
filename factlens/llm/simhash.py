"""SimHash near-dedup by anchor points.

Two 64-bit fingerprints that differ in at most four bits differ, by the pigeonhole principle, in at most one bit of
part A, or at most one of part B, or in none of part C (21, 21 and 22 bits: two errors or more in A and in B leave none
for C). For each part the anchors are a covering code: in A and B the product of the perfect [15,11] Hamming code
(covering radius one) and six free bits, in C every word (radius zero). A fingerprint has one home anchor within the
covering radius, and is replicated to every anchor within covering radius plus threshold; each pair in reach therefore
meets at the home anchor of either. Pairs are compared per anchor.

Equal fingerprints are merged before that. A crowded anchor is cut into blocks of homes and blocks of replicas that are
compared block by block in different tasks, and what a block emits is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.common import BROADCAST_KEYS, ROW, materialize, numbered, sliced, tidy, without_rows
from factlens.llm.components import components
from factlens.llm.jaccard import digests, similar

SHINGLE = 4
THRESHOLD = 4
#: Offset and width in bits of the parts A, B (threshold one each) and C (threshold zero).
PARTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
CODE_BITS = 15
#: Rows of one anchor that are compared in one task.
HOME_BLOCK, REPLICA_BLOCK = 4096, 16384
#: Up to this many comparisons an anchor's links are all given; beyond it a spanning forest.
SMALL = 4096


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    """The SimHash of a whole text as eight bytes, the highest first; zero if it has no words."""
    hashed = digests(text, size)
    if not hashed:
        return bytes(8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashed), 1 << 16):
        part = np.frombuffer(b"".join(hashed[k : k + (1 << 16)]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashed)).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(row number, doc_id, fp) of every whole text; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            prints = b"".join(fingerprint(x.as_py(), size) for x in batch.column("text"))
            fps = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(fps)], names=[ROW, "doc_id", "fp"])

    rows = numbered(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), f"{ROW} long, doc_id long, fp long")


def hamming_words() -> np.ndarray:
    """For each 15-bit word the codeword of the [15,11] Hamming code within distance one."""
    words = np.arange(1 << CODE_BITS, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    return np.where(syndrome, words ^ (1 << np.maximum(syndrome - 1, 0)), words)


def anchors_in_reach(value: np.ndarray, width: int, threshold: int, nearest: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Home anchors of a part's values, and (indices, anchors) lists of all anchors within radius plus threshold."""
    if threshold == 0:
        return value, [(np.arange(len(value)), value)]
    low, high = value & ((1 << CODE_BITS) - 1), value >> CODE_BITS
    home = nearest[low] | high << CODE_BITS
    every = np.arange(len(value))
    reach = [(every, home)]
    for bit in range(width - CODE_BITS):  # one free bit differs: the code part has radius one left
        reach.append((every, home ^ (1 << (CODE_BITS + bit))))
    for bit in range(CODE_BITS):  # codewords at distance two: one bit flipped, then the nearest codeword
        other = nearest[low ^ (1 << bit)]
        fresh = other != nearest[low]
        if bit:  # each such codeword is reached by two flips; the lower one counts
            apart = other ^ low
            fresh &= (apart & -apart) == (1 << bit)
        reach.append((every[fresh], (other | high << CODE_BITS)[fresh]))
    return home, reach


def replicate(fps: DataFrame) -> DataFrame:
    """(part, anchor, home, fp): each fingerprint at its home anchors and, as a replica, at every anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = hamming_words()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for part, (shift, width, threshold) in enumerate(PARTS):
                value = (fp.view(np.uint64) >> np.uint64(shift)).astype(np.uint64).view(np.int64) & ((1 << width) - 1)
                home, reach = anchors_in_reach(value, width, threshold, nearest)
                for at_home, at, anchor in [(True, np.arange(len(fp)), home), *((False, i, x) for i, x in reach)]:
                    key = anchor << 2 | part
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), at_home)), pa.array(fp[at])], names=["anchor", "home", "fp"])

    return fps.select("fp").mapInArrow(tidy(run), "anchor long, home boolean, fp long")


def forest(homes: np.ndarray, replicas: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Edges that connect what the links between homes and replicas connect; fewer than there are rows."""
    label, left, right = np.arange(len(homes)), [], []
    for k in range(0, len(replicas), 256):
        near = np.bitwise_count(homes[:, None] ^ replicas[None, k : k + 256]) <= threshold
        for j in np.flatnonzero(near.any(axis=0)):
            _, first = np.unique(label[at := np.flatnonzero(near[:, j])], return_index=True)
            tops = at[first]
            left += homes[tops].tolist()
            right += [int(replicas[k + j])] * len(tops)
            if len(tops) > 1:
                label[np.isin(label, label[tops])] = label[tops[0]]
    return left, right


def compare(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between homes and replicas of each block; rows of a block lie together, homes first."""

    def links(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(key)]
        n_home = np.add.reduceat(home.astype(np.int64), starts)
        n_rest = ends - starts - n_home
        size, a, b = n_home * n_rest, [], []
        small = np.flatnonzero((size > 0) & (size <= SMALL))
        for k in range(0, len(small), 1024):
            s = small[k : k + 1024]
            n, rest = size[s], np.repeat(n_rest[s], size[s])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(starts[s], n) + at // rest
            j = np.repeat(starts[s] + n_home[s], n) + at % rest
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= threshold) & (fp[i] != fp[j])
            a.append(fp[i[near]])
            b.append(fp[j[near]])
        for s in np.flatnonzero(size > SMALL):
            middle = starts[s] + n_home[s]
            x, y = forest(fp[starts[s] : middle], fp[middle : ends[s]], threshold)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (a, b))
        a, b = a.astype(np.uint64).view(np.int64), b.astype(np.uint64).view(np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], axis=1)[low != high], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "h", "r")], axis=1)
            home, fp = batch.column("home").to_numpy(zero_copy_only=False).astype(bool), batch.column("fp").to_numpy().view(np.uint64)
            if held:
                key, home, fp = (np.concatenate([x, y]) for x, y in zip(held.pop(), (key, home, fp), strict=True))
            last = len(key) - int((key != key[-1]).any(axis=1)[::-1].argmax()) if (key != key[-1]).any() else 0
            if last:
                yield links(key[:last], home[:last], fp[:last])
            held.append((key[last:], home[last:], fp[last:]))
        if held:
            yield links(*held[0])

    return rows.mapInArrow(tidy(run), "a long, b long")


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps(fp)``, enough to connect all that lie within ``threshold`` bits."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors reach {THRESHOLD} bits")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = replicate(fps.repartition(parts, "fp"))  # a fingerprint becomes some 30 rows, so they are dealt out first
    crowd = (
        rows.groupBy("anchor")
        .agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("replicas"))
        .select(
            "anchor",
            F.ceil(F.col("homes") / HOME_BLOCK).cast("int").alias("nh"),
            F.ceil(F.col("replicas") / REPLICA_BLOCK).cast("int").alias("nr"),
        )
        .filter("nh > 1 or nr > 1")
    )
    crowd = materialize(crowd, "crowd")
    if crowd.count() <= BROADCAST_KEYS:
        crowd = F.broadcast(crowd)
    spread, nh, nr = F.xxhash64("fp"), F.greatest("nh", F.lit(1)), F.greatest("nr", F.lit(1))
    block = F.when(
        F.col("home"),
        F.transform(F.sequence(F.lit(0), nr - 1), lambda r: F.struct(F.pmod(spread, nh).cast("int").alias("h"), r.alias("r"))),
    ).otherwise(F.transform(F.sequence(F.lit(0), nh - 1), lambda h: F.struct(h.alias("h"), F.pmod(spread, nr).cast("int").alias("r"))))
    placed = rows.join(crowd, "anchor", "left").select("anchor", "home", "fp", F.inline(block).alias("h", "r"))
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(n, "anchor", "h", "r").sortWithinPartitions("anchor", "h", "r", F.desc("home"))
    return compare(ordered, threshold).distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or over others.

    Returns row number, doc_id, fingerprint (16 lowercase hex digits) and component_id: the smallest doc_id in the group.
    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id takes part but never names a
    group unless all are null. Repeated rows come back as often as they are there. Other columns are not looked at.
    """
    prints = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    nodes = components(near_links(distinct.select("fp"), threshold))
    placed = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = materialize(placed, "placed")
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = materialize(placed.join(named, "component").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select(ROW, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def led_by_fingerprints(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of the rows of ``found(row number, n, own)`` with the leader of the group that fingerprints put them into.

    A leader is the text with the fewest shingles of its own, as in ``jaccard``; what is too far from it is no pair.
    """
    groups = near_duplicates(docs).select(ROW, "component_id").filter("component_id is not null")
    members = materialize(found.select(ROW, "n", "own").join(groups, ROW), "members")
    lead = members.groupBy("component_id").agg(F.min_by(F.struct(F.col(ROW).alias("b"), F.col("n").alias("nb")), F.struct("own", ROW)).alias("lead"), F.count("*").alias("members"))
    pairs = members.join(lead.filter("members > 1").select("component_id", "lead.*"), "component_id").select(F.col(ROW).alias("a"), "b", F.col("n").alias("na"), "nb")
    return pairs.filter("a <> b and 5 * least(na, nb) >= 4 * greatest(na, nb)")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the smallest doc_id, of repeated rows one.

    Fingerprints group texts first, by anchor points as for ``near_duplicates``, and an exact check follows: similar are
    five-word shingles with a Jaccard similarity of at least 0.8, directly or over others. Similar texts whose fingerprints are
    further apart are found by the join in ``jaccard``, which leaves out what is connected by then. All
    texts without a word, null ones too, are one group; a null doc_id stays only in a group of such; an empty table stays empty.
    """
    rows = numbered(docs)
    found = materialize(similar(rows, first=lambda alone: led_by_fingerprints(rows, alone)), "near")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return without_rows(rows, found.join(first, ROW, "left_anti"))
