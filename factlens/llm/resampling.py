"""Importance resampling of documents towards a target text, drawn by Gumbel-perturbed scores.

Features are runs of words, hashed into buckets. Each document's buckets are written once; bucket totals of all documents
and of the target are summed over them, and the gain of each bucket, an array of fixed size, scores every document. The
highest scores are drawn without sorting all of them: the cutoff is found by bisection of the range of scores, each step an
exact count over the written scores, and ties at the cutoff by bisection over doc_id. Only what is drawn is sorted, by ranges,
and a rank is a row's place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import ROW, materialize, read_table, sliced, tidy

#: Words of bytes: digits, letters and everything beyond ASCII. A-Z are lower-cased before.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words in a feature at most, and buckets.
RUN, BUCKETS = 1, 10_000
#: Share drawn of the documents that have enough words, and the seed of the draw.
PERCENT, LEAST_WORDS, SEED = 10, 20, 2024
#: Words of a text that are held at once.
STRETCH = 1 << 16
#: Thresholds that one count job tries.
PROBES = 15

FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def bucket_numbers(text: str | None, run: int, buckets: int) -> tuple[int, list[np.ndarray]]:
    """How many words a whole text has, and the bucket of every feature."""
    found, before, n = WORD.finditer((text or "").encode().lower()), [], 0
    out: list[np.ndarray] = []
    while words := [m.group() for _, m in zip(range(STRETCH), found, strict=False)]:
        n += len(words)
        for size in range(1, run + 1):
            own = before[max(0, len(before) - size + 1) :] + words
            features = own if size == 1 else map(b" ".join, zip(*(own[k:] for k in range(size)), strict=False))
            out.append((np.fromiter(map(zlib.crc32, features), np.uint32) % buckets).astype("<u4"))
        before = (before + words)[max(0, len(before) + len(words) - run + 1) :]
    return n, out


def features(rows: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """FEATURES of ``rows(doc_id, text)``: the buckets of every feature of the whole text, as unsigned 32-bit integers."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            each = [bucket_numbers(x.as_py(), run, buckets) for x in batch.column("text")]
            at = [b"".join(x.tobytes() for x in y) for _, y in each]
            columns = [batch.column("doc_id"), pa.array([n for n, _ in each], pa.int64()), pa.array([len(x) // 4 for x in at], pa.int64()), pa.array(at, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(found), FEATURES)


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: each task adds up an array, and the arrays are summed by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            for x in batch.column("buckets"):
                sums += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    found = rows.select("buckets").mapInArrow(tidy(counted), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths of a nat, rounded down, with one added to every bucket on both sides."""
    s, t, size = raw.astype(np.float64), target.astype(np.float64), float(len(raw))
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """FEATURES without the buckets, but with their sum of gains."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            weight = [int(gain[np.frombuffer(x.as_buffer(), "<u4")].sum()) for x in batch.column("buckets")]
            kept = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(tidy(summed), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and doc_id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def nth(rows: DataFrame, key: str, n: int) -> tuple[int, int]:
    """The n-th smallest of a column of longs, and how many are below it.

    By bisection of the range of values: each job counts exactly, for several thresholds at once, the rows at or below.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        tried = sorted({min(low + k * step, high) - 1 for k in range(1, PROBES + 2)})
        counts = rows.agg(*[F.count_if(F.col(key) <= x).alias(f"c{k}") for k, x in enumerate(tried)]).first()
        enough = next((k for k, c in enumerate(counts) if c >= n), len(tried))
        if enough:
            low, below = tried[enough - 1] + 1, counts[enough - 1]
        if enough < len(tried):
            high = tried[enough]
    return low, below


def is_drawn(scored: DataFrame, n: int) -> Column:
    """Whether a row of ``scored`` is among the n first by score, highest first, then by doc_id (null last), then by row number."""
    out = F.lit(False)
    level, ties = F.lit(True), scored
    for key in ("order_score", "order_id", ROW):
        if n == 0:
            return out
        cut, below = nth(ties, key, n)
        out = out | (level & (F.col(key) < cut))
        level, n = level & (F.col(key) == cut), n - below
        ties = ties.filter(F.col(key) == cut)
    return out | level


def ranked(drawn: DataFrame) -> DataFrame:
    """``drawn`` with rank 1, 2, 3, ... in order: sorted by ranges, numbered within each, with the sizes of those before added."""
    spark, order = drawn.sparkSession, ["order_score", "order_id", ROW]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = drawn.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ranges.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, "drawn")
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row a partition
        starts.append((part, before))
        before += n
    table = spark.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(table), "part").withColumn("rank", F.col("start") + F.col("place") + 1)


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` with the weight of its features under ``target(text)``, its score, and its rank if drawn.

    Of the N documents with at least ``least`` words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller doc_id, then to the row that was read first. A null text has no features and weight 0; a null doc_id takes part
    and loses ties; repeated rows are documents of their own, so each gets a rank of its own. An empty table gives an empty
    result, an empty target no features. Other columns aren't looked at.

    Returns doc_id, n_features, weight, score, rank (null if not drawn).
    """
    own = materialize(features(docs, run, buckets).withColumn(ROW, F.monotonically_increasing_id()), "features", compression="zstd")
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), run, buckets)
    gain = gains(totals(own, buckets), totals(aim, buckets))
    scored = weighted(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumns({"order_score": F.bitwise_not("score"), "order_id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), ROW: F.monotonically_increasing_id()})
    scored = materialize(scored, "scores")
    enough = scored.filter(F.col("n_words") >= least)
    mark = (F.col("n_words") >= least) & is_drawn(enough, percent * enough.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~mark).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(scored.filter(mark)).select(*columns, "rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards the benchmark texts."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
