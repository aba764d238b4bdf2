"""Byte-level BPE of whole texts: pre-tokenised in overlapping chunks, stitched, encoded and decoded again.

The pattern has no look-behind, so from a true pre-token boundary on, matching depends only on what follows. A chunk that
starts anywhere may begin out of step; once one of its boundaries coincides with a boundary of the chunk before it that
is sure (not decided at that chunk's end), both are in step from there on. Chunks of a long text are pre-tokenised in
different tasks and stitched where they resynchronise; where they do not within the overlap, the stitcher matches on
from the last sure boundary until they do. Short texts are one chunk and never leave their task.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import ROW, kept_in_task, numbered, read_table, sliced, tidy

#: Code points of a chunk without its overlap, and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: A match is sure if it ends so many code points before its chunk does: the pattern looks ahead two at most.
MARGIN = 4
CACHE_TOKENS, CACHE_LEN = 300_000, 64

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Ids of pre-tokens by a rank file, with a cache, and the bytes of ids; a worker keeps its codec from task to task."""

    kept: ClassVar[dict[tuple[str, str], Codec]] = kept_in_task()

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Codec:
        if (ranks, pattern) not in cls.kept:
            cls.kept[ranks, pattern] = cls(ranks, pattern)
        return cls.kept[ranks, pattern]

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.token = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.token[rank] = token
        self.seen: dict[str, bytes] = {}

    def ends(self, text: str) -> Iterator[int]:
        """Where pre-tokens end."""
        return (m.end() for m in self.find.finditer(text))

    def ids(self, tokens: list[str]) -> bytes:
        """Ids of pre-tokens, each encoded on its own, as little-endian unsigned 32-bit integers."""
        seen = self.seen
        try:
            return b"".join(map(seen.__getitem__, tokens))
        except KeyError:
            pass
        out, encode = [], self.encoding.encode_ordinary
        for t in tokens:
            x = seen.get(t)
            if x is None:
                x = np.array(encode(t), "<u4").tobytes()
                if len(t) <= CACHE_LEN:
                    if len(seen) >= CACHE_TOKENS:
                        seen.clear()
                    seen[t] = x
            out.append(x)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Overlapping chunks: each starts ``chunk`` after the one before it and goes on ``overlap`` into the next."""
    return [text[k : k + chunk + overlap] for k in range(0, max(1, len(text)), chunk)]


def stitch(chunks: Iterator[tuple[str, np.ndarray]], codec: Codec, chunk: int = CHUNK) -> Iterator[list[str]]:
    """The pre-tokens of a text, from its chunks in order and the ends of each chunk's own matches."""

    def tokens(text: str, base: int, bounds: np.ndarray) -> list[str]:
        b = (bounds - base).tolist()
        return [text[i:j] for i, j in zip(b, b[1:], strict=False)]

    text, base, ends, at = "", 0, np.empty(0, np.int64), 0  # ends after ``at``, a true boundary, are in step
    for k, (fresh, own) in enumerate(chunks):
        start = k * chunk
        own = own.astype(np.int64) + start
        if k == 0:
            text, ends = fresh, own
            continue
        sure = np.r_[at, ends[(ends > at) & (ends <= base + len(text) - MARGIN)]]
        both = np.intersect1d(sure[sure >= start], np.r_[start, own])
        if len(both):
            yield tokens(text, base, sure[sure <= both[0]])
            text, base, ends, at = fresh, start, own, int(both[0])
        else:  # out of step all along: match on from the last sure boundary, over this chunk
            yield tokens(text, base, sure)
            at = int(sure[-1])
            text = text[at - base : start - base] + fresh if at < start else fresh[at - start :]
            base, ends = at, np.fromiter(codec.ends(text), np.int64) + at
    yield tokens(text, base, np.r_[at, ends[ends > at]])


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one (no ids); a null doc_id is carried along; repeated rows come back as often as they are
    there; an empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = codec.ids(codec.find.findall(text.as_py() or ""))
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield result(rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in (ROW, "doc_id", "text")), strict=True):
                parts = cut(text.as_py(), chunk, overlap)
                n = len(parts)
                arrays = [pa.array([row.as_py()] * n), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts)]
                yield pa.RecordBatch.from_arrays(arrays, names=[ROW, "doc_id", "k", "text"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        for batch in sliced(batches, 64):
            ends = [np.fromiter(codec.ends(x.as_py()), np.int32).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary())], names=[*batch.schema.names, "ends"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in zip(*(batch.column(c) for c in (ROW, "doc_id", "text", "ends")), strict=True):
                    yield tuple(x.as_py() for x in r)

        for (_, doc_id), group in itertools.groupby(rows(), key=lambda r: r[:2]):
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for tokens in stitch(((text, np.frombuffer(ends, np.int32)) for _, _, text, ends in group), codec, chunk):
                ids = codec.ids(tokens)
                n += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(codec.decode(ids))
            yield result([(doc_id, n, of_ids.hexdigest(), of_bytes.hexdigest())])

    rows = numbered(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = f"{ROW} long, doc_id long, k int, text string"
    chunks = rows.filter(long).select(ROW, "doc_id", "text").mapInArrow(tidy(split), fields).repartition(parts, ROW, "k").mapInArrow(tidy(match), fields + ", ends binary")
    joined = chunks.repartition(parts, ROW).sortWithinPartitions(ROW, "k").mapInArrow(tidy(join), RESULT)
    return rows.filter(~long).select("doc_id", "text").mapInArrow(tidy(whole), RESULT).union(joined)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode_documents(read_table(spark, sf_dir, "documents"))
