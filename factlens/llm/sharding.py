"""Resharding by minimum-cost flow: from the sizes of old shards to new ones of equal size, moving the fewest bytes.

Shards are nodes; what an old shard holds flows to new ones for nothing if it stays and at a price a byte if it moves, so
the cheapest flow moves the fewest bytes. The graph has a few edges a shard (moves pass through a hub), and is solved on
the driver; rows never go there. A flow from one shard to another is a block: a run of the old shard's rows in their order. So a
plan is a list of cuts, not a list of rows: each task looks its rows' positions up among the cuts, and texts are read once and
written once, without a shuffle. Rows so large that a cut beside one would make shards uneven are placed one by one;
there can be only so many of them for each shard.

Positions are running sums over the rows by ranges of them: within each range, plus the sums of the ranges before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import PLACE_BITS, ROW, materialize, numbered, read_table, scratch_path, tidy
from factlens.storage import Folders

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: A row is placed by itself if it has over 1/LARGE of a shard's share; so there are at most LARGE for each shard.
LARGE = 200
SHARD, VERSION = "__shard", Folders.VERSION


@dataclass
class Graph:
    """A network with capacities and costs; edges in pairs, each with its reverse."""

    n: int
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out = [[] for _ in range(self.n)]

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> None:
        """As much as possible at the least cost, along one shortest path after the other; prices keep costs from being negative."""
        price = [0] * self.n
        while True:
            far, by, heap = {source: 0}, {}, [(0, source)]
            done: set[int] = set()
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    new = d + self.cost[e] + price[x] - price[self.to[e]]
                    if self.room[e] and new < far.get(self.to[e], new + 1):
                        far[self.to[e]], by[self.to[e]] = new, e
                        heapq.heappush(heap, (new, self.to[e]))
            if sink not in far:
                return
            most = max(far.values())
            price = [p + far.get(k, most) for k, p in enumerate(price)]
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def transfers(have: list[int], room: list[int], hosts: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of the cheapest way to get all that old shards ``have`` into the ``room`` of the new ones.

    A byte that stays costs nothing, one that moves costs 1, and with ``hosts`` (of shards by number) 2 if it leaves its host.
    """
    n = max(len(have), len(room))
    home = (hosts or [0] * n)[:n]
    places = sorted(set(home))
    old, new, hub, far = (lambda k: 2 + k), (lambda k: 2 + n + k), {h: 2 + 2 * n + k for k, h in enumerate(places)}, 2 + 2 * n + 2 * len(places)
    into = {h: 2 + 2 * n + len(places) + k for k, h in enumerate(places)}
    graph, everything = Graph(far + 1), sum(have)
    stay, leave, arrive = {}, {}, {}
    for k, size in enumerate(have):
        graph.edge(0, old(k), size, 0)
        leave[k] = graph.edge(old(k), hub[home[k]], size, 1)
        if k < len(room):
            stay[k] = graph.edge(old(k), new(k), size, 0)
    for k, size in enumerate(room):
        graph.edge(new(k), 1, size, 0)
        arrive[k] = graph.edge(into[home[k]], new(k), size, 0)
    within = {h: graph.edge(hub[h], into[h], everything, 0) for h in places}
    over = {h: (graph.edge(hub[h], far, everything, 1), graph.edge(far, into[h], everything, 0)) for h in places}
    graph.send(0, 1)
    sent = lambda e: graph.room[e ^ 1]
    out = [(k, k, sent(e)) for k, e in stay.items()]
    waiting: list[list[int]] = []
    left = {h: [[k, sent(leave[k])] for k in leave if home[k] == h] for h in places}

    def take(queue: list[list[int]], amount: int) -> Iterator[tuple[int, int]]:
        while amount:
            part = min(amount, queue[0][1])
            yield queue[0][0], part
            queue[0][1] -= part
            amount -= part
            if not queue[0][1]:
                queue.pop(0)

    queues = {}
    for h in places:
        left[h] = [x for x in left[h] if x[1]]
        queues[h] = [list(x) for x in take(left[h], sent(within[h]))]
        waiting += left[h]
    for h in places:
        queues[h] += [list(x) for x in take(waiting, sent(over[h][1]))]
        for k in arrive:
            if home[k] == h:
                out += [(i, k, amount) for i, amount in take(queues[h], sent(arrive[k]))]
    summed: dict[tuple[int, int], int] = defaultdict(int)
    for i, j, amount in out:
        summed[i, j] += amount
    return [(i, j, amount) for (i, j), amount in summed.items() if amount]


def filled(total: int, taken: list[int], shares: list[float]) -> list[int]:
    """How much more each shard takes so that all are as near to their share as can be, given what is ``taken`` already."""
    order = sorted(range(len(taken)), key=lambda k: taken[k] / shares[k])
    level, weight, used = 0.0, 0.0, 0
    for i, k in enumerate(order):
        weight, used = weight + shares[k], used + taken[k]
        level = (total + used) / weight
        if i + 1 == len(order) or level <= taken[order[i + 1]] / shares[order[i + 1]]:
            break
    room = [max(0, int(level * s) - t) for s, t in zip(shares, taken, strict=True)]
    rest, k = total - sum(room), 0
    while rest > 0:  # what rounding down left, spread
        part = -(-rest // len(room))
        room[order[k % len(room)]] += min(part, rest)
        rest, k = rest - part, k + 1
    return room


@dataclass
class Plan:
    """Which runs of an old shard's rows go where. Runs are in order; ``middle`` is the position at which each starts."""

    shards: int
    middle: np.ndarray
    old: np.ndarray
    shard: np.ndarray
    large: dict[int, tuple[int, int]]
    part_bytes: dict[int, int]
    part_rows: dict[int, int]
    first: np.ndarray | None = None
    slot: np.ndarray | None = None
    first_row: np.ndarray | None = None
    moved: int = 0
    changed: set[int] = field(default_factory=set)


def sizes(docs: DataFrame) -> DataFrame:
    """(row number, doc_id, size, text_crc32, old) of ``docs``, with a column ``old`` or with the file's number in its place."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    old = F.col("old").cast("long") if "old" in docs.columns else F.shiftright(ROW, PLACE_BITS)
    return docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), old.alias("old"))


def positioned(rows: DataFrame, large: int) -> DataFrame:
    """``rows`` in the order of old shard and row number, in ranges (part), with the bytes and rows before each in its range; rows over ``large`` don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            small = size <= large
            sums, counts = np.cumsum(np.where(small, size, 0)), np.cumsum(small)
            before, place = total + sums - np.where(small, size, 0), count + counts - small
            if len(size):
                total, count = total + int(sums[-1]), count + int(counts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(place, pa.int64())], names=[*batch.schema.names, "before", "place"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "old", ROW).sortWithinPartitions("old", ROW).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{c} {t}" for c, t in ordered.dtypes)
    return ordered.mapInArrow(tidy(run), f"{schema}, before long, place long")


def runs_of(plan: Plan, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row is placed by itself, the run it lies in (else -1), and its place among all rows of runs."""
    part = batch.column("part").to_numpy()
    numbers = batch.column(ROW).to_numpy()
    known = {int(p): (plan.part_bytes[int(p)], plan.part_rows[int(p)]) for p in np.unique(part)}
    start = np.array([known[int(p)] for p in part], np.int64).reshape(-1, 2)
    alone = np.fromiter((int(x) in plan.large for x in numbers), bool, len(numbers))
    middle = start[:, 0] + batch.column("before").to_numpy() + batch.column("size").to_numpy() // 2
    run = np.searchsorted(plan.middle, middle, side="right") - 1
    return alone, np.where(alone, -1, run), start[:, 1] + batch.column("place").to_numpy()


def solved(rows: DataFrame, shards: int, shares: list[float] | None = None, hosts: list[int] | None = None) -> tuple[Plan, DataFrame]:
    """The plan for ``rows`` as of ``sizes``, and these rows with their positions, written."""
    shares = shares or [1.0] * shards
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large = max(ROW_BYTES, int(total * min(shares) / sum(shares) / LARGE))
    single = rows.filter(F.col("size") > large).select(ROW, "old", "size").collect()  # LARGE for each shard at most, for equal shares
    placed = materialize(positioned(rows, large), "positions")
    small = F.when(F.col("size") <= large, F.col("size")).otherwise(0)
    have_of = {r.old: r.n for r in placed.groupBy("old").agg(F.sum(small).alias("n")).collect()}  # a row for each old shard
    part_bytes, part_rows, b, n = {}, {}, 0, 0
    for r in sorted(placed.groupBy("part").agg(F.sum(small).alias("b"), F.count_if(F.col("size") <= large).alias("n")).collect()):
        part_bytes[r.part], part_rows[r.part] = b, n
        b, n = b + r.b, n + r.n

    goal = [total * s / sum(shares) for s in shares]
    load, lone, changed, moved = [0] * shards, {}, set(), 0
    heap = [(-g, k) for k, g in enumerate(goal)]
    heapq.heapify(heap)
    slots = [0] * shards
    for r in sorted(single, key=lambda r: (-r.size, r[ROW])):
        k = r.old
        if not (k < shards and load[k] + r.size <= goal[k]):
            while -heap[0][0] != goal[heap[0][1]] - load[heap[0][1]]:  # an entry that is out of date
                heapq.heapreplace(heap, (load[heap[0][1]] - goal[heap[0][1]], heap[0][1]))
            k = heap[0][1]
        load[k] += r.size
        lone[r[ROW]] = (k, slots[k])
        slots[k] += 1
        if k != r.old:
            changed |= {k, r.old}
            moved += r.size

    last = max(have_of, default=-1)
    have = [have_of.get(k, 0) for k in range(last + 1)]
    flows = transfers(have, filled(sum(have), load, shares), hosts)
    by_old = defaultdict(list)
    for i, j, amount in flows:
        by_old[i].append((i != j, j, amount))
        if i != j:
            changed |= {i, j}
            moved += amount
    at, middle, old, shard = 0, [], [], []
    for i in sorted(by_old):
        for _, j, amount in sorted(by_old[i]):
            middle.append(at)
            old.append(i)
            shard.append(j)
            at += amount
    plan = Plan(shards, np.array(middle, np.int64), np.array(old, np.int64), np.array(shard, np.int64), lone, part_bytes, part_rows, moved=moved, changed=changed)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, run, place = runs_of(plan, batch)
            keep = ~alone
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (run, place, batch.column(ROW).to_numpy())], names=["run", "place", "number"])

    edges = placed.select("part", ROW, "before", "size", "place").mapInArrow(tidy(found), "run long, place long, number long")
    edges = edges.groupBy("run").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.min("number").alias("number")).collect()  # a row for each run
    plan.first, plan.slot, plan.first_row = (np.full(len(middle), -1, np.int64) for _ in range(3))
    for r in sorted(edges):
        plan.first[r.run], plan.first_row[r.run] = r.first, r.number
        plan.slot[r.run] = slots[plan.shard[r.run]]
        slots[plan.shard[r.run]] += r.n
    return plan, placed


def assigned(plan: Plan, placed: DataFrame) -> DataFrame:
    """(row number, doc_id, size, text_crc32, shard, slot): slots count up from 0 in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, at, place = runs_of(plan, batch)
            numbers = batch.column(ROW).to_numpy()
            lone = np.array([plan.large.get(int(x), (0, 0)) for x in numbers], np.int64).reshape(-1, 2)
            shard = np.where(alone, lone[:, 0], plan.shard[at] if len(plan.shard) else 0)
            slot = np.where(alone, lone[:, 1], (plan.slot[at] + place - plan.first[at]) if len(plan.shard) else 0)
            columns = [batch.column(c) for c in (ROW, "doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[ROW, "doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(tidy(run), f"{ROW} long, doc_id long, size long, text_crc32 long, shard int, slot long")


def with_shard(docs: DataFrame, plan: Plan, old: Column) -> DataFrame:
    """``docs`` (numbered) with the new shard of each row, by the runs of its old shard and the rows placed by themselves."""
    spark = docs.sparkSession
    runs = defaultdict(list)
    for i, j, row in zip(plan.old.tolist(), plan.shard.tolist(), plan.first_row.tolist(), strict=True):
        if row >= 0:
            runs[i].append((row, j))
    table = spark.createDataFrame(list(runs.items()), "__old long, __runs array<struct<row: long, shard: int>>")
    lone = spark.createDataFrame([(r, k) for r, (k, _) in plan.large.items()], f"{ROW} long, __lone int")
    rows = docs.withColumn("__old", old).join(F.broadcast(table), "__old", "left").join(F.broadcast(lone), ROW, "left")
    own = F.try_element_at(F.filter("__runs", lambda x: x["row"] <= F.col(ROW)), F.lit(-1))["shard"]
    return rows.withColumn(SHARD, F.coalesce("__lone", own)).drop("__old", "__runs", "__lone")


class ShardedTable(Folders):
    """Documents in folders of shards; a write replaces the shards that it names and leaves the others' files where they are."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SHARD)


def reshard(table: ShardedTable, shards: int, shares: list[float] | None = None, hosts: list[int] | None = None) -> Plan:
    """Spread a table over ``shards`` shards of equal size (or by ``shares``) with the fewest bytes moved; only shards that gain or lose are rewritten."""
    rows = numbered(table.read())
    plan, _ = solved(materialize(sizes(rows.withColumn("old", F.col(SHARD))), "sizes"), shards, shares, hosts)
    if plan.changed:
        table.write(with_shard(rows, plan, F.col(SHARD).cast("long")).drop(ROW, VERSION), plan.changed)
    return plan


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, shares: list[float] | None = None) -> DataFrame:
    """Spread ``docs`` over ``shards`` shards of near equal bytes, written to ``path``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The old shards are the files that hold the table (stretches of files, if they are more). A row's size is its text's
    bytes plus 16. Sizes of shards differ by what their rows allow: no cut is further off than half of a 1/200 of a share.
    A null text has no bytes, a null doc_id is carried along, repeated rows and equal texts are rows like any other: equal
    texts stay together only if they lie together. An empty table gives an empty result. Other columns are written along.
    """
    rows = numbered(docs)
    each = materialize(sizes(rows.drop("old")), "sizes")
    files = (each.agg(F.max("old")).first()[0] or 0) + 1
    spread = lambda k: k if files <= shards else F.floor(k * shards / files).cast("long")
    plan, placed = solved(each.withColumn("old", spread(F.col("old"))), shards, shares)
    table = ShardedTable(docs.sparkSession, path)
    table.write(with_shard(rows.select(ROW, "doc_id", "text", *[c for c in rows.columns if c not in (ROW, "doc_id", "text", SHARD, VERSION)]), plan, spread(F.shiftright(ROW, PLACE_BITS))))
    if not table.places():
        return assigned(plan, placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    written = table.read().select(ROW, F.col(SHARD).cast("int").alias("shard"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    slots = assigned(plan, placed).drop("text_crc32")
    return written.join(slots, [ROW, "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return shard_documents(read_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
