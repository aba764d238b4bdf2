"""Document fingerprints as invertible Bloom lookup sketches.

A text is a set of paragraph digests (long paragraphs give one per sentence or stretch, repeated ones are numbered). The
sketch adds every digest to one cell in each of three tables of a power of two cells; a cell holds a count, the exclusive
or of its digests and of their check sums. Subtracting the sketches of two versions leaves only digests that differ, and
peeling cells with a single one recovers them; if that gets stuck both sketches are made four times as large.

Documents are dealt into ranges of doc_id, and each range gets a copy of the row that follows it, so that every document
meets its successor with one shuffle of the texts and without a window over all rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import read_table, tidy

TABLES = 3
#: Cells in each table of a sketch that is stored, as a power of two, and how many powers each retry adds.
BASE_BITS, RETRY_BITS = 3, 2
#: Code points of a piece of a paragraph at most.
PIECE = 128

UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+[^\S\n]*|\n+|\Z)")
UNIT_END = re.compile(r"(?:[.!?]\s*|\n)\Z")
WORD64 = (1 << 64) - 1


def check(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 & WORD64) >> 32


class Pieces:
    """The pieces of a text in order with where they end, and their distinct 64-bit digests (the n-th occurrence has its own)."""

    def __init__(self, text: str, before: Pieces | None = None, kept: int = 0):
        """The pieces of ``text``, after the first ``kept`` ones of ``before``."""
        self.pieces = before.pieces[:kept] if before else []
        self.ends = before.ends[:kept] if before else []
        self.digests = before.digests[:kept] if before else []
        seen = Counter(self.pieces)
        at = self.ends[-1] if self.ends else 0
        for unit in UNIT.findall(text, at):
            for k in range(0, len(unit), PIECE):
                piece = unit[k : k + PIECE]
                at += len(piece)
                self.pieces.append(piece)
                self.ends.append(at)
                self.digests.append(xxhash.xxh64_intdigest(piece.encode(), seen[piece]))
                seen[piece] += 1

    def edited(self, text: str, cut: int) -> tuple[Pieces, int]:
        """The pieces of a text that is the same up to ``cut``, and how many are shared: those of all units that end before it."""
        kept = bisect_left(self.ends, cut)
        while kept and (len(self.pieces[kept - 1]) == PIECE or not UNIT_END.search(self.pieces[kept - 1])):
            kept -= 1  # a unit that goes on is cut into pieces anew
        return Pieces(text, self, kept), kept


def digests(text: str | None) -> list[int]:
    return Pieces(text or "").digests


class Sketch:
    """An invertible Bloom lookup table."""

    def __init__(self, bits: int):
        self.bits, n = bits, TABLES << bits
        self.count, self.key, self.sum = [0] * n, [0] * n, [0] * n

    def add(self, keys: list[int], sign: int = 1) -> Sketch:
        count, key, total, bits, mask = self.count, self.key, self.sum, self.bits, (1 << self.bits) - 1
        for k in keys:
            c = check(k)
            for at in (k & mask, (k >> 21 & mask) + (1 << bits), (k >> 42 & mask) + (2 << bits)):
                count[at] += sign
                key[at] ^= k
                total[at] ^= c
        return self

    def copy(self) -> Sketch:
        out = Sketch(0)
        out.bits, out.count, out.key, out.sum = self.bits, self.count[:], self.key[:], self.sum[:]
        return out

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.bits)
        out.count = [a - b for a, b in zip(self.count, other.count, strict=True)]
        out.key = [a ^ b for a, b in zip(self.key, other.key, strict=True)]
        out.sum = [a ^ b for a, b in zip(self.sum, other.sum, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """Digests only on the left and only on the right; None if peeling gets stuck. Uses the sketch up.

        A cell of several digests whose check sums happen to agree passes for a single one; what it gives comes back as the
        opposite, so a digest that turns up twice means that the sketch failed.
        """
        left: list[int] = []
        right: list[int] = []
        done: set[int] = set()
        todo = [at for at, c in enumerate(self.count) if c in (1, -1)]
        while todo:
            at = todo.pop()
            c, k = self.count[at], self.key[at]
            if c not in (1, -1) or self.sum[at] != check(k):
                continue
            if k in done:
                return None
            done.add(k)
            (left if c == 1 else right).append(k)
            self.add([k], -c)
            mask = (1 << self.bits) - 1
            todo += [k & mask, (k >> 21 & mask) + (1 << self.bits), (k >> 42 & mask) + (2 << self.bits)]
        return None if any(self.count) or any(self.key) else (left, right)

    def text(self) -> str:
        """The sketch as base64, counts modulo 65,536."""
        parts = [struct.pack("<HQI", c & 0xFFFF, k, s) for c, k, s in zip(self.count, self.key, self.sum, strict=True)]
        return base64.b64encode(b"".join(parts)).decode()


def difference(a: list[int], b: list[int], bits: int = BASE_BITS, sketches: tuple[Sketch, Sketch] | None = None) -> tuple[list[int], list[int]]:
    """Digests only in ``a`` and only in ``b``, from sketches that grow until peeling recovers them."""
    while True:
        x, y = sketches if sketches else (Sketch(bits).add(a), Sketch(bits).add(b))
        found = x.minus(y).peel() if abs(len(a) - len(b)) <= TABLES << bits else None
        if found is not None:
            return found
        need = (3 * (len(a) + len(b)) // (2 * TABLES)).bit_length()  # enough cells for all digests to differ
        bits, sketches = max(bits + RETRY_BITS, need), None


def likeness(a: list[int], b: list[int], sketches: tuple[Sketch, Sketch] | None = None, shared: int = 0) -> float:
    """Shared digests over all digests; 1 for two empty texts. The first ``shared`` digests are known to be the same.

    Sketches are linear, so what both sides share cancels: larger sketches are made of the rest alone.
    """
    if not a and not b:
        return 1.0
    left, right = difference(a[shared:], b[shared:], BASE_BITS, sketches)
    apart = len(left) + len(right)
    return (len(a) + len(b) - apart) / (len(a) + len(b) + apart)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many code points from the start of the next one, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def ranges(rows: DataFrame, n: int) -> tuple[list[int], dict[int, int]]:
    """Lower bounds of about ``n`` ranges of doc_id, and in how many parts each range of a single frequent doc_id is cut."""
    found = [int(x) for x in rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if x is not None]
    often = Counter(found)
    bounds = sorted({*found, *(x + 1 for x, k in often.items() if k > 1)})
    return bounds, {bounds.index(x) + 1: 1 << (2 * k - 1).bit_length() for x, k in often.items() if k > 1}


def with_heads(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, plus for each range a copy of the row that follows it (head = true).

    Rows of a doc_id that is repeated very often are dealt into ranges of their texts' hashes, in the same order.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, parts = ranges(rows, n)
    edges = np.array(bounds, np.int64)
    cuts = np.ones(len(bounds) + 1, np.int64)
    cuts[list(parts)] = list(parts.values())
    most = int(cuts.max())

    @F.arrow_udf("long")
    def bucket_of(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        missing = doc_id.is_null().to_numpy(zero_copy_only=False)
        at = np.searchsorted(edges, doc_id.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        part = (tie.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5) * cuts[at]
        return pa.array(np.where(missing, -1, at * most + np.minimum(part.astype(np.int64), cuts[at] - 1)))

    tie = F.xxhash64("text")
    rows = rows.withColumn("tie", tie).withColumn("bucket", bucket_of("doc_id", "tie"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")
    starts = sorted((r.bucket, r.first) for r in rows.groupBy("bucket").agg(first).collect())  # one row a range
    after = [(*starts[(k + 1) % len(starts)][1][1:], starts[k][0]) for k in range(len(starts))]
    heads = F.broadcast(spark.createDataFrame(after, "head_id long, head_tie long, head_of long"))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    found = rows.drop("bucket").join(heads, same).groupBy("doc_id", "tie", "head_of").agg(F.first("text").alias("text"))
    found = found.select("doc_id", "text", "tie", F.col("head_of").alias("bucket"), F.lit(True).alias("head"))
    return rows.withColumn("head", F.lit(False)).unionByName(found)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them with each other and with the next document.

    The next document is the one with the next larger doc_id; of equal doc_ids the order of the texts' hashes decides,
    null doc_ids come first, and after the last row follows the first. A null text is an empty one; two empty texts have
    likeness 1. A single row is its own next one; an empty table gives an empty result. Other columns are not looked at.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int | None, text: str, own: Pieces, sketch: Sketch, following: str, after: Pieces, next_sketch: Sketch) -> tuple:
        other = edited(text, following)
        if other == text:
            other_sketch, near = sketch, 1.0
        else:
            others, shared = own.edited(other, len(text) - len(text) // 4)
            other_sketch = sketch.copy().add(own.digests[shared:], -1).add(others.digests[shared:])
            near = likeness(own.digests, others.digests, (sketch, other_sketch), shared)
        near_next = 1.0 if text == following else likeness(own.digests, after.digests, (sketch, next_sketch))
        return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), sketch.text(), other_sketch.text(), near, near_next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc_id, text, bucket, head in zip(*(batch.column(c) for c in ("doc_id", "text", "bucket", "head")), strict=True):
                doc_id, text, bucket = doc_id.as_py(), text.as_py(), bucket.as_py()
                if held is not None and held[0] != bucket:
                    held = None  # the rows of a range end with its head
                own = Pieces(text)
                sketch = Sketch(BASE_BITS).add(own.digests)
                if held is not None:
                    out.append(row(*held[1:], text, own, sketch))
                held = None if head.as_py() else (bucket, doc_id, text, own, sketch)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_heads(docs).repartition(n, "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").asc_nulls_first(), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "bucket", "head").mapInArrow(tidy(run), schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
