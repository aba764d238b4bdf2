import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from factlens.llm import resampling
from factlens.llm.queries import ORACLE

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs: list[tuple], target: list, run: int, buckets: int, percent: int, least: int) -> list[tuple]:
    """The contract by loops."""

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, run + 1) for k in range(len(words) - n + 1)]

    own, aim = [found(t) for _, t in docs], Counter(b for t in target for b in found(t)[1])
    raw = Counter(b for _, x in own for b in x)
    s_all, t_all = raw.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in raw}
    rows = []
    for (doc_id, _), (n, x) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append((doc_id, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= least)
    drawn = order[: percent * len(order) // 100]
    return sorted((str(r[0]), *r[2:]) for r in rows), [((None if null else d), -score, k + 1) for k, (score, null, d) in enumerate(drawn)]


@pytest.mark.parametrize(("run", "percent", "least", "stretch"), [(1, 10, 20, 1 << 16), (3, 60, 1, 7), (2, 100, 0, 5), (1, 0, 0, 9)])
def test_resampling_as_plain_loops(spark, docs, run, percent, least, stretch, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(500 + k % 7, "the same words again and again " * 5) for k in range(30)]  # ties of score and of doc_id
    rng = random.Random(4)
    rows += [(900 + k, "".join(rng.choice("aB9 é字-_ ") for _ in range(200))) for k in range(40)]
    target = ["the cat sat on a mat", "Été 字 9", None]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = [resampling.bucket_numbers(t, run, 10_000) for _, t in rows]  # stretches don't matter
    assert found[0][0] == plain(rows[:1], target, run, 10_000, 0, 0)[0][0][1] or run > 1
    out = resampling.resample(table, aim, run, 10_000, percent, least).collect()
    want, drawn = plain(rows, target, run, 10_000, percent, least)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in out) == want
    assert sorted(((r.doc_id, r.score, r.rank) for r in out if r.rank), key=lambda x: x[2]) == drawn


def test_resampling_of_nothing(spark, empty):
    aim = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, aim).count() == 0
    few = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), aim, least=1, percent=100).collect()
    assert [(r.n_features, r.rank) for r in few] == [(2, 1)]


def test_resampling_as_sql(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
        want = db.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({ORACLE['op11_resampling']})").fetchall()
    found = resampling.op11_resampling(spark, path).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_nth_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([-(1 << 62), 1 << 62, 0, 5, 5, 6, rng.randrange(-100, 100)]) for _ in range(200)]
    table = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for n in (1, 2, 57, 100, 199, 200):
        cut = sorted(values)[n - 1]
        assert resampling.nth(table, "v", n) == (cut, sum(v < cut for v in values))
