"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a word bigram model over a closed vocabulary: the VOCABULARY most frequent words of the trusted text (a
parameter; ids grow from 16 to 32 bits with it), all others one unknown word whose probability is shared out over as many
types as were left out. What belongs to single words (continuation probability, back-off weight) is bounded by the
vocabulary and goes to every task, and so do the COMMON_PAIRS most frequent pairs, so that no shard is asked for them by
every document. All other pairs grow with the corpus and stay sharded: a block of documents sends each shard its distinct
pairs with their postings, compressed; the shard looks its counts up and answers with a partial sum for each document;
blocks add the sums up.

The logarithm of a pair's probability is split so that sums suffice: backing off costs gamma(u) + p(w), and a pair that
was seen adds the difference between its interpolated probability and that.

Half of the trusted documents (by a checksum of doc_id) train the model; the other half sets, for each language, the
perplexity quantile beyond which a document is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import BROADCAST_KEYS, ROW, give_back, materialize, numbered, read_table, tidy, without_rows

#: Known words at most; 0 is the start of a text and 1 the unknown word. Up to this many, ids take 16 bits, else 32.
VOCABULARY = 65_534
START, UNKNOWN, FIRST = 0, 1, 2
#: Pairs whose gains every task holds (12 bytes each); which pairs these are doesn't change results.
COMMON_PAIRS = 65_536
#: A block ends at so many words or documents.
BLOCK_WORDS, BLOCK_DOCS = 1_000_000, 65_000
#: Characters of text for each shard.
SHARD_CHARS = 16_000_000
#: Share of trusted documents whose perplexity stays under the threshold, and how many a language (and a band of lengths
#: within it, as short texts scatter more) needs for a threshold of its own.
QUANTILE, LEAST_TRUSTED = 0.995, 100
#: Added to the quantile, in nats a word: trusted documents just beyond it are still alike.
SLACK = 0.25


def mix(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def id_bits(words: int) -> int:
    """Bits of a word's id in a pair."""
    return 16 if words <= VOCABULARY else 32


def packed(values: np.ndarray) -> bytes:
    """Compressed integers, the bytes of equal weight together."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 2 == 0


@dataclass
class Unigrams:
    """By word id: log probability without context (of the unknown word: of one of its types), and log back-off weight."""

    words: list[str]
    alone: np.ndarray
    gamma: np.ndarray
    discounts: tuple[float, float, float]
    totals: np.ndarray
    unknown_types: int
    bits: int


def pairs(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.r_[START, ids[:-1]] << bits | ids


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where those are missing, a half."""
    if min(n1, n2) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 > 0 else 1.0]
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column("text"):
                found.update((x.as_py() or "").split())
                if len(found) > 500_000:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return texts.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, words: list[str]) -> DataFrame:
    """(code, n) of word pairs over all texts; a code is the first id, shifted, and the second."""
    shared, bits = texts.sparkSession.sparkContext.broadcast(words), id_bits(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: k + FIRST for k, w in enumerate(shared.value)}
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for x in batch.column("text"):
                split = (x.as_py() or "").split()
                if split:
                    held.append(pairs(np.fromiter(map(known.get, split, repeat(UNKNOWN)), np.int64, len(split)), bits))
                    size += len(split)
                if size > BLOCK_WORDS:
                    yield rows()
                    held, size = [], 0
        yield rows()

    return texts.select("text").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Unigrams, DataFrame] | None:
    """The bounded part of the model, and the pairs (code, n) that it was trained on; None without text."""
    counted = materialize(count_words(texts), "words")
    types, once = counted.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
    if not types:
        return None
    words = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect()]  # bounded by the vocabulary
    found, bits = materialize(count_pairs(texts, words), "pairs"), id_bits(len(words))
    of = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    first = found.groupBy(F.shiftright("code", bits).alias("id")).agg(F.sum("n").alias("total"), F.count("*").alias("types"), *of).toPandas()  # a row a word
    second = found.groupBy(F.col("code").bitwiseAND(F.lit((1 << bits) - 1)).alias("id")).agg(F.count("*").alias("types")).toPandas()  # a row a word
    size = len(words) + FIRST
    d1, d2, d3 = discounts(*(float(first[f"n{k}"].sum()) for k in (1, 2, 3, 4)))
    totals, gamma = np.zeros(size), np.zeros(size)
    at = first["id"].to_numpy()
    totals[at] = first["total"]
    gamma[at] = np.log((d1 * first["n1"] + d2 * first["n2"] + d3 * (first["types"] - first["n1"] - first["n2"])) / first["total"])
    before = np.zeros(size)
    before[second["id"].to_numpy()] = second["types"]
    e = discounts(*(float((before == k).sum()) for k in (1, 2, 3, 4)))
    off = np.where(before >= 3, e[2], np.where(before == 2, e[1], np.where(before == 1, e[0], 0.0)))
    alone = np.maximum(before - off, 0) / before.sum() + off.sum() / before.sum() / (size - 1)
    unknown_types = max(types - len(words), once, 1)
    alone = np.log(alone)
    return Unigrams(words, alone, gamma, (d1, d2, d3), totals, int(unknown_types), bits), found


def gain(code: np.ndarray, n: np.ndarray, alone: np.ndarray, gamma: np.ndarray, totals: np.ndarray, cuts: tuple, bits: int) -> np.ndarray:
    """What the log probability of pairs seen n times has over backing off."""
    u, w = code >> bits, code & ((1 << bits) - 1)
    back = gamma[u] + alone[w]
    p = (n - np.where(n >= 3, cuts[2], np.where(n == 2, cuts[1], cuts[0]))) / totals[u] + np.exp(back)
    return np.log(p) - back


def gains(found: DataFrame, model: Unigrams, shards: int) -> DataFrame:
    """(shard, code, gain) of every pair seen."""
    shared = found.sparkSession.sparkContext.broadcast((model.alone, model.gamma, model.totals, model.discounts, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(mix(code, shards).astype(np.int32)), batch.column("code"), pa.array(gain(code, n, *shared.value))], names=["shard", "code", "gain"])

    return found.select("code", "n").mapInArrow(tidy(run), "shard int, code long, gain double")


def common_gains(found: DataFrame, model: Unigrams, most: int = COMMON_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order, and gains of the most frequent pairs."""
    rows = sorted((r.code, r.n) for r in found.orderBy(F.desc("n"), "code").limit(most).collect())
    code, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    return code, gain(code, n, model.alone, model.gamma, model.totals, model.discounts, model.bits)


REQUEST = "shard int, block long, pairs binary, runs binary, docs binary, header binary"


def requests(rows: DataFrame, model: Unigrams, common: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """For each block of documents and shard: distinct pairs, how often each occurs, and in which of the block's documents.

    One shard of each block also carries the header: row numbers, words and the sums that need no pair counts.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.words, model.alone, model.gamma, model.unknown_types, model.bits, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alone, gamma, unknown_types, bits, (often, often_gain) = shared.value
        known = {w: k + FIRST for k, w in enumerate(words)}
        kind = np.uint32 if bits == 16 else np.uint64
        often = often.astype(kind)
        alone = alone.copy()
        alone[UNKNOWN] -= np.log(unknown_types)
        numbers, sizes, sums, codes, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            code = np.concatenate([np.empty(0, kind), *codes])
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            value = np.array(sums, np.float64)
            if len(often):
                at = np.minimum(np.searchsorted(often, code), len(often) - 1)
                hit = often[at] == code
                value += np.bincount(doc[hit], weights=often_gain[at[hit]], minlength=len(sizes))
                code, doc = code[~hit], doc[~hit]
            shard = mix(code, shards)
            order = np.argsort(shard << np.uint64(32) | code, kind="stable") if bits == 16 else np.lexsort((code, shard))
            code, doc, shard = code[order], doc[order], shard[order]
            edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            home = numbers[0] % shards
            out = []
            for s in range(shards):
                own = slice(edges[s], edges[s + 1])
                if edges[s] == edges[s + 1] and s != home:
                    continue
                starts = np.flatnonzero(np.r_[True, code[own][1:] != code[own][:-1]]) if edges[s] < edges[s + 1] else np.empty(0, np.int64)
                runs = np.diff(np.r_[starts, edges[s + 1] - edges[s]]).astype(np.uint32)
                keys = np.diff(code[own][starts], prepend=kind(0)).astype(kind)
                header = zstandard.compress(np.array(numbers, np.int64).tobytes() + np.array(sizes, np.int64).tobytes() + value.tobytes()) if s == home else None
                out.append((s, numbers[0], packed(keys), packed(runs), packed(doc[own]), header))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "block", "pairs", "runs", "docs", "header"])

        for batch in batches:
            for row, text in zip(batch.column(ROW).to_pylist(), batch.column("text"), strict=True):
                split = (text.as_py() or "").split()
                ids = np.fromiter(map(known.get, split, repeat(UNKNOWN)), np.int64, len(split))
                numbers.append(row)
                sizes.append(len(ids))
                if len(ids):
                    sums.append(float(alone[ids].sum() + gamma[ids[:-1]].sum() + gamma[START]))
                    codes.append(pairs(ids, bits).astype(kind))
                else:
                    sums.append(0.0)
                total += len(ids)
                if total >= BLOCK_WORDS or len(numbers) >= BLOCK_DOCS:
                    yield flush()
                    numbers, sizes, sums, codes, total = [], [], [], [], 0
        if numbers:
            yield flush()

    return rows.select(ROW, "text").mapInArrow(tidy(run), REQUEST)


def answer(left: pa.Table, right: pa.Table, kind: type) -> pa.Table:
    """Partial sums of one shard for each block."""
    code = right.column("code").to_numpy()
    order = np.argsort(code)
    code, value_of = code[order], right.column("gain").to_numpy()[order]
    out = []
    for k in range(left.num_rows):
        r = {c: left.column(c)[k].as_py() for c in ("block", "pairs", "runs", "docs", "header")}
        keys = np.cumsum(unpacked(r["pairs"], kind), dtype=np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(code, keys), max(0, len(code) - 1))
        value = np.where(code[at] == keys, value_of[at], 0.0) if len(code) else np.zeros(len(keys))
        weights = np.repeat(value, unpacked(r["runs"], np.uint32))
        docs = unpacked(r["docs"], np.uint16)
        out.append((r["block"], np.bincount(docs, weights=weights).astype(np.float64).tobytes(), r["header"]))
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "sums", "header"])


def add_up(block: pa.Table) -> pa.Table:
    """The documents of one block, with words and log probability."""
    header = next(x for x in block.column("header").to_pylist() if x is not None)
    raw = zstandard.decompress(header)
    n = len(raw) // 24
    numbers, sizes = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
    total = np.frombuffer(raw, np.float64, n, 16 * n).copy()
    # in a fixed order, so that sums come out alike each time
    for x in sorted(block.column("sums").to_pylist()):
        part = np.frombuffer(x, np.float64)
        total[: len(part)] += part
    return pa.table([pa.array(numbers), pa.array(sizes), pa.array(total)], names=[ROW, "n_words", "log_p"])


def score(rows: DataFrame, model: Unigrams, found: DataFrame, shards: int) -> DataFrame:
    """(row number, n_words, log_p) of whole texts."""
    asked, table = requests(rows, model, common_gains(found, model), shards), gains(found, model, shards)
    kind = np.uint32 if model.bits == 16 else np.uint64

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return answer(left, right, kind)
        finally:
            give_back()

    parts = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(answered, "block long, sums binary, header binary")
    return parts.groupBy("block").applyInArrow(add_up, f"{ROW} long, n_words long, log_p double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids of documents labelled as good, to be broadcast if they are few enough."""
    ids = materialize(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    return F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids


def small(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once, to be broadcast if it has few enough rows."""
    table = materialize(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS // 8 else table


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, vocabulary: int = VOCABULARY) -> DataFrame:
    """Perplexity of every document, and whether it stays.

    A document is rejected if its perplexity is beyond the threshold of its language and band of lengths (powers of four
    words), or if it has no words (null or empty text; perplexity is null then). A band without enough trusted documents
    takes its language's threshold; a language without enough, and a null one, that over all languages. Without any
    trusted text everything with words stays. A null doc_id is never trusted. Repeated rows are judged alike; an empty
    table gives an empty result; other columns are not looked at.

    Returns row number, doc_id, lang, n_words, perplexity, threshold and kept.
    """
    rows = numbered(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    trusted = trusted_ids(labels)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    texts = rows.filter(is_training(F.col("doc_id"))).join(trusted, "doc_id", "left_semi").select("text")
    trained = train(texts, vocabulary)
    if trained is None:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        return rows.select(ROW, "doc_id", "lang", n.alias("n_words"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (n > 0).alias("kept"))
    scored = score(rows, *trained, shards)
    scored = scored.withColumn("nats", F.when(F.col("n_words") > 0, -F.col("log_p") / F.greatest("n_words", F.lit(1))))
    scored = scored.withColumn("band", F.least(F.floor(F.log(4.0, F.greatest("n_words", F.lit(1)) + 0.5)), F.lit(5)))
    judged = materialize(rows.select(ROW, "doc_id", "lang").join(scored, ROW), "scored")
    held = judged.filter(~is_training(F.col("doc_id")) & F.col("nats").isNotNull()).join(trusted, "doc_id", "left_semi")
    cut = F.percentile_approx("nats", F.lit(quantile), F.lit(10_000))
    enough = F.col("n") >= LEAST_TRUSTED
    known = held.filter(F.col("lang").isNotNull())
    by_band = known.groupBy("lang", "band").agg(cut.alias("own"), F.count("*").alias("n")).filter(enough).drop("n")
    by_band = small(by_band, "by-band")
    by_lang = known.groupBy("lang").agg(cut.alias("whole"), F.count("*").alias("n")).filter(enough).drop("n")
    by_lang = small(by_lang, "by-lang")
    most = held.agg(cut).first()[0]
    limit = F.coalesce("own", "whole", F.lit(most).cast("double")) + SLACK
    inside = F.coalesce(F.col("nats") <= limit, F.col("nats").isNotNull())
    return judged.join(by_band, ["lang", "band"], "left").join(by_lang, "lang", "left").select(
        ROW, "doc_id", "lang", "n_words", F.exp("nats").alias("perplexity"), F.exp(limit).alias("threshold"), inside.alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that are rejected; all columns stay.

    Null and empty texts go; repeated rows are judged alike; a null lang takes the threshold over all languages; without any
    trusted text everything with words stays; an empty table stays empty (see ``judge``).
    """
    rows = numbered(docs)
    return without_rows(rows, judge(rows, labels).filter(~F.col("kept")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their perplexity and whether they stay."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop(ROW)
