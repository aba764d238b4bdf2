import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factlens.llm import sharding
from factlens.llm.common import numbered


def cheapest(have, room, cost):
    """The least cost of all ways to send whole units, one unit after the other tried at every place."""
    best = {tuple(room): 0}
    for i, n in enumerate(have):
        for _ in range(n):
            new = {}
            for left, c in best.items():
                for j, r in enumerate(left):
                    if r:
                        key = (*left[:j], r - 1, *left[j + 1 :])
                        new[key] = min(new.get(key, 1 << 30), c + cost(i, j))
            best = new
    return min(best.values())


@pytest.mark.parametrize("with_hosts", [False, True])
def test_transfers_move_the_least(with_hosts):
    rng = random.Random(6)
    for _ in range(60):
        have, n = [rng.randrange(4) for _ in range(rng.randrange(1, 5))], rng.randrange(1, 5)
        room = [0] * n
        for _ in range(sum(have) + rng.randrange(2)):
            room[rng.randrange(n)] += 1
        hosts = [rng.randrange(2) for _ in range(5)] if with_hosts else None
        cost = lambda i, j, h=hosts: 0 if i == j else 1 if not h or h[i] == h[j] else 2
        flows = sharding.transfers(have, room, hosts)
        out, into = Counter(), Counter()
        for i, j, amount in flows:
            out[i] += amount
            into[j] += amount
        assert [out[k] for k in range(len(have))] == have
        assert all(into[k] <= room[k] for k in range(n))
        assert sum(cost(i, j) * amount for i, j, amount in flows) == cheapest(have, room, cost)


def check_shards(rows, out, shards):
    """Every row once with its size and digest, slots without gaps, and shards as equal as their rows allow."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots, load = defaultdict(list), Counter()
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    total, largest = sum(load.values()), max((size(t) for _, t in rows), default=0)
    share = total / shards
    most, least = max(load.values(), default=0), min(load[k] for k in range(shards))
    return share, largest, most, least


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sharding_of_odd_rows(spark, docs, tmp_path, shards):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = sharding.shard_documents(docs, str(tmp_path / "shards"), shards).collect()
    check_shards(rows, out, shards)


def test_sharding_is_even_and_moves_little(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, "w" * int(rng.paretovariate(1.1) * 50)) for k in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    out = sharding.shard_documents(docs, str(tmp_path / "out"), 12).collect()
    share, largest, most, least = check_shards(rows, out, 12)
    assert most <= max(share * 1.02, largest) and least >= min(share * 0.98, (share * 12 - largest) / 11 * 0.98)


def test_sharding_of_nothing(spark, empty, tmp_path):
    assert sharding.shard_documents(empty, str(tmp_path / "none"), 4).count() == 0


def files_of(path):
    return {str(f): (f.stat().st_mtime_ns, f.read_bytes()) for f in path.rglob("*.parquet") if "lists" not in f.parts}


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    rows = [(k, "text " * 50 + str(k)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = sharding.ShardedTable(spark, str(tmp_path / "t"))
    uneven = F.when(F.col("doc_id") < 1500, 0).when(F.col("doc_id") < 2500, 1).when(F.col("doc_id") < 3500, 2).otherwise(3)
    table.write(docs.withColumn(sharding.SHARD, uneven).repartition(3))
    before, where = files_of(tmp_path / "t"), table.places()
    plan = sharding.reshard(table, 4)
    after = files_of(tmp_path / "t")
    assert all(after[f] == x for f, x in before.items())  # nothing is overwritten; what isn't affected is where it was
    load = {r[sharding.SHARD]: r.n for r in table.read().groupBy(sharding.SHARD).agg(F.sum(F.length("text") + 16).alias("n")).collect()}
    share = sum(load.values()) / 4
    assert all(abs(n - share) < 0.01 * share for n in load.values())
    assert plan.changed == {0, 3} or abs(plan.moved - 500 * 270) < 3000
    assert all(table.places()[k] == where[k] for k in range(4) if k not in plan.changed)
    assert sorted((r.doc_id, r.text) for r in table.read().collect()) == rows

    more = sharding.reshard(table, 5)
    assert abs(more.moved - share * 4 / 5) < 0.02 * share  # only what the new shard takes
    fewer = sharding.reshard(table, 2)
    assert set(table.places()) == {0, 1} and fewer.moved > 0
    assert sorted(r.doc_id for r in table.read().collect()) == list(range(4000))
    assert sharding.reshard(table, 2).moved == 0 or sharding.reshard(table, 2).moved < 0.01 * share


def test_half_written_versions_are_not_read(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(10).selectExpr("id AS doc_id", "'x' AS text", f"id % 2 AS {sharding.SHARD}"))
    spark.range(5).selectExpr("id AS doc_id", "'y' AS text", f"0 AS {sharding.SHARD}").write.partitionBy(sharding.SHARD).parquet(f"{table.path}/{sharding.VERSION}=2")
    assert {r.text for r in table.read().collect()} == {"x"}


def test_numbers_and_runs_agree(spark, docs):
    rows = numbered(docs)
    plan, placed = sharding.solved(sharding.sizes(rows), 5)
    by_row = {r[0]: r.shard for r in sharding.assigned(plan, placed).collect()}
    again = sharding.with_shard(rows, plan, F.shiftright(sharding.ROW, sharding.PLACE_BITS)).collect()
    assert {r[sharding.ROW]: r[sharding.SHARD] for r in again} == by_row
    assert len(by_row) == len(again) == len(list(itertools.chain(again)))
