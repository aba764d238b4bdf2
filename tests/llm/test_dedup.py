import hashlib
import random
import re

import numpy as np
import xxhash

from factlens.llm import exact_dedup, jaccard, simhash
from factlens.llm.common import ROW, numbered, scratch_path, without_rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_against_brute_force(docs):
    found = exact_dedup.dedupe_once(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    groups = {}
    for doc_id, text in texts:
        groups.setdefault(normal(text), []).append((-len(text or ""), doc_id is None, doc_id))
    assert len(found) == len(texts)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in found:
        group = by_hash[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(group), min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2])
    assert sum(r.kept for r in found) == len(groups)


def test_row_numbers_do_not_depend_on_the_split(spark, docs):
    """Numbers made while the scan was split in one way find their rows when it is split in another."""
    key, seen = "spark.sql.files.minPartitionNum", []
    try:
        for n in ("1", "40"):
            spark.conf.set(key, n)
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if n == "40" else "4194304")
            seen.append({r[ROW]: (r.doc_id, r.text) for r in numbered(docs).collect()})
            if n == "1":
                gone = spark.createDataFrame([(k,) for k, (i, _) in seen[0].items() if i is not None and i % 2 == 0], f"{ROW} long")
        assert seen[0] == seen[1] and len(seen[0]) == docs.count()
        left = without_rows(numbered(docs), gone).collect()
        assert sorted(str(r.doc_id) for r in left) == sorted(str(i) for i, _ in seen[0].values() if i is None or i % 2) and left[0].__fields__ == docs.columns
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    made = numbered(spark.range(20).selectExpr("id AS doc_id", "rand() AS text"))
    assert made.orderBy(ROW).collect() == made.orderBy(ROW).collect()


def test_index_decides_across_batches(spark):
    """The first batch's texts are found in the index by the second one, and only new ones are appended."""
    rows = [spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a b"), (2, "ab"), (3, "c")], [(0, "a  b "), (4, "d"), (5, "d")], [])]
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), 3)
    got = [{r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.dedupe(x, index, str(k)).collect()} for k, x in enumerate(rows)]
    assert got == [{1: (1, True, 2), 2: (1, False, 2), 3: (3, True, 1)}, {0: (1, False, 1), 4: (4, True, 2), 5: (4, False, 2)}, {}]
    held = index.read().collect()
    assert sorted(r.keep_id for r in held) == [1, 3, 4] and len({r.batch for r in held}) == 2
    index.close()


def test_index_persists_between_batches(spark, docs):
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = exact_dedup.dedupe(docs, index, "a").collect()
    index.close()
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = exact_dedup.dedupe(docs, again, "b").collect()
    assert sum(r.kept for r in first) == again.read().count() and not any(r.kept for r in second)
    assert {(r.text_sha256, r.keep_id) for r in first} == {(r.text_sha256, r.keep_id) for r in second}
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {again.table}").collect()}
    assert (described["Num Buckets"], described["Sort Columns"]) == ("4", "[`digest`]")
    again.close()


def test_exact_dedup_has_no_python(docs):
    plan = exact_dedup.dedupe_once(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" in plan


def test_empty_tables(empty):
    assert exact_dedup.dedupe_once(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, threshold=4):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= threshold
    label = np.array([x if x is not None else 1 << 60 for x in ids])
    while True:
        new = np.array([label[near[k]].min() for k in range(len(label))])
        if (new == label).all():
            return label
        label = new


def test_simhash_against_brute_force(docs):
    found = simhash.near_duplicates(docs).collect()
    texts = {(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in found} == texts and len(found) == docs.count()
    want = brute_components(np.array([int(r.fingerprint, 16) for r in found], np.uint64), [r.doc_id for r in found])
    assert [r.component_id if r.component_id is not None else 1 << 60 for r in found] == want.tolist()


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    fps = [*centres.tolist()]
    for c in centres.tolist():
        for flips in (1, 2, 3, 4, 5):
            fps.append(c ^ int(sum(1 << int(b) for b in rng.choice(64, flips, replace=False))))
    signed = np.array(fps, np.uint64).view(np.int64)
    edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in np.unique(signed)], "fp long")).collect()
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= 4
    want = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i, j in zip(*np.nonzero(near), strict=True) if signed[i] != signed[j]}
    assert {(e.a, e.b) for e in edges} == want


def test_crowded_anchors_are_cut_and_stay_connected(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOME_BLOCK", 16)
    monkeypatch.setattr(simhash, "REPLICA_BLOCK", 32)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = np.random.default_rng(4)
    fps = {0}
    while len(fps) < 300:
        fps.add(int(rng.choice(list(fps))) ^ (1 << int(rng.integers(0, 63))))
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(e.a, e.b) for e in simhash.near_links(rows).collect()]
    parent = {x: x for x in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert (a ^ b).bit_count() <= 4
        parent[top(a)] = top(b)
    assert len({top(x) for x in fps}) == 1


def test_pipeline_stages_keep_one_of_each(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({normal(r.text) for r in docs.collect()})
    once = simhash.keep_one(docs)
    found = simhash.near_duplicates(docs)
    assert once.count() == found.select("component_id").distinct().count()


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_keep_one_against_brute_force_jaccard(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three"]
    for k in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 25, 120, 400]))]
        texts.append(" ".join([*words, *"all rights reserved by the same owner of this long notice".split()]))
        for edits in (1, 2, 3, 5, 9):  # copies on both sides of the threshold
            copy = list(words)
            for _ in range(max(1, len(words) * edits // 200)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy + words[: edits * 2 if k % 2 else 0]))
    rows = [(k * 7 % 1009, x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    sets = [slow_shingles(x) for _, x in rows]
    alike = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    label = [i for i, _ in rows]
    while (new := [min(m for m, near in zip(label, line, strict=True) if near) for line in alike]) != label:
        label = new
    far = [(simhash.fingerprint(a), simhash.fingerprint(b)) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows) if i < j and alike[i][j]]
    assert sum((int.from_bytes(a) ^ int.from_bytes(b)).bit_count() > 4 for a, b in far) > 20
    found = simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(r.doc_id for r in found) == sorted(set(label)) and len(set(label)) < len(rows)


def test_large_group_of_near_copies_is_joined_by_leaders(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows.append((300, " ".join([*base[:100], *(f"y{k}" for k in range(100))])))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    compared, alike = [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    found = simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(r.doc_id for r in found) == [0, 300] and sum(compared) < 300 * 299 / 4


def test_keep_one_goes_by_fingerprints_first(spark, tmp_path, monkeypatch):
    """What anchors group is checked before the join on shingles and isn't compared there again; what they group wrongly is kept apart."""
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(5)] + [(9, "another text altogether")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 2
    compared, alike = [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, sets: compared.append(pairs.count()) or alike(pairs, sets))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 9] and compared == [4, 0]
    monkeypatch.setattr(simhash, "near_duplicates", lambda d: numbered(d).selectExpr("__row", "0L AS component_id"))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 9]


def test_shingles_of_one_text_are_dropped_before_anything_is_joined(spark):
    rows = [(1, 10, 2, [5, 6, 7]), (2, 12, 3, [6, 8]), (3, 4, 4, [9]), (4, 0, 0, [])]
    found = spark.createDataFrame(rows, "__row long, n long, own long, prefix array<long>")
    assert sorted(tuple(r) for r in jaccard.met_at(found).collect()) == [(6, 1, 10, 2, 1), (6, 2, 12, 3, 0)]


def test_sets_of_shingles_go_once_they_are_compared(spark, tmp_path):
    from pathlib import Path

    from factlens.storage import shared_dir

    rows = [(k, " ".join([*(f"w{n}" for n in range(60 + k % 2)), f"x{k}"])) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    top = Path(shared_dir(spark).removeprefix("file:"))
    before = set(top.rglob("factlens-sets-*"))
    assert [r.doc_id for r in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()] == [0]
    assert set(top.rglob("factlens-sets-*")) <= before
