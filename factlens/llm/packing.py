"""Packing tokenized documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows and one shorter rest. The histogram of piece lengths has at most one entry per
length, so its size does not depend on the input. Combinations of few lengths that fill a window are enumerated, their
repeat counts solved for against the histogram by non-negative least squares and rounded, and what is left is packed
greedily, again in terms of the histogram. The plan (which length goes into which windows, at which offset) is then a
short list of rank intervals per length; pieces get their rank within their length in parallel and look their place up.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm.common import ROW, SLICE, kept_in_task, materialize, numbered, read_table, sliced, tidy

WINDOW = 2048
END_ID = 1
#: A rank is counted within at most about so many pieces; lengths with more are dealt over several groups.
RANK_GROUP = 2_000
#: Bytes of pre-tokens and ids that a worker remembers, and bytes of text that are tokenized at once.
CACHE_BYTES, STRETCH = 4_000_000, 500_000

#: White space of the Unicode property; splitting words otherwise also cuts at U+001C to U+001F, which are not in it.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "[\x1c-\x1f]"
#: The tokenizer's own pre-tokens, and characters beyond plain Latin, whose words go through the whole tokenizer.
PRE_TOKEN, BEYOND = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", r"[^\x{0}-\x{24f}]|\x{130}"


class Remembered:
    """Ids of strings met before, in arrays (no object for each string); all are forgotten beyond ``most`` bytes."""

    def __init__(self, make: Callable[[list[str]], list[list[int]]], most: int):
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.known, self.table, self.lengths = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.empty(0, np.int32)

    def ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each of ``distinct`` start and how many they are."""
        if self.known.nbytes + self.table.nbytes + self.lengths.nbytes > self.most:
            self.forget()
        at = pc.index_in(distinct, value_set=self.known)
        if at.null_count:
            new = distinct.filter(at.is_null())
            made = self.make(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.table = np.concatenate([self.table, np.array(list(itertools.chain.from_iterable(made)), np.uint32)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int32, len(made))])
            at = pc.index_in(distinct, value_set=self.known)
        place = at.to_numpy(zero_copy_only=False)
        starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        return self.table, starts[place], self.lengths[place].astype(np.int64)


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``table`` numbered ``at``, one after the other, and where each ends."""
    n = lengths[at]
    ends = np.cumsum(n)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)], ends


def list_ends(lists: pa.Array) -> np.ndarray:
    """Zero, and where each list ends among the values of all."""
    return np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokens never reach over white space, each distinct string once.

    Texts are taken in stretches. The distinct words of a stretch are lower-cased and cut into pre-tokens, and the distinct
    pre-tokens that aren't remembered go through the merges; ids are put together by index, without a loop over words.
    Words beyond plain Latin go through the whole tokenizer, as do texts with one of its special tokens, which are found
    before words are. A worker keeps its encoder, and so what it remembers, from task to task.
    """

    kept: ClassVar[dict[str, WordEncoder]] = kept_in_task()

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.pre_tokens, self.words = Remembered(self.merge, most), Remembered(self.whole, most)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def merge(self, tokens: list[str]) -> list[list[int]]:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        texts = (t if t.isascii() and t.isprintable() else "".join(map(letters.__getitem__, t.encode())) for t in tokens)
        return [[x.id for x in tokenize(t)] if t else [] for t in texts]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct words, and where those of each start and how many they are."""
        beyond = pc.match_substring_regex(words, BEYOND)
        plain = pc.utf8_lower(words.filter(pc.invert(beyond)))
        cut = pc.split_pattern(pc.replace_substring_regex(plain, PRE_TOKEN, "\\0 "), " ")  # the last of each is empty
        tokens = cut.flatten().dictionary_encode()
        ids, ends = gather(*self.pre_tokens.ids(tokens.dictionary), tokens.indices.to_numpy(zero_copy_only=False))
        bounds = np.r_[0, ends][list_ends(cut)]
        rare, rare_starts, rare_lengths = self.words.ids(words.filter(beyond))
        beyond = beyond.to_numpy(zero_copy_only=False)
        starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[~beyond], lengths[~beyond] = bounds[:-1], np.diff(bounds)
        starts[beyond], lengths[beyond] = rare_starts + len(ids), rare_lengths
        return np.concatenate([ids, rare]) if len(rare_starts) else ids, starts, lengths

    def together(self, words: pa.Array) -> list[bytes]:
        """The ids of texts given as lists of words."""
        coded = words.flatten().dictionary_encode()
        ids, ends = gather(*self.of_words(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        bounds = np.r_[0, ends][list_ends(words)].tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out: list[bytes] = [b""] * len(texts)
        special = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special), pa.array(np.zeros(len(texts), bool)))
        split = pc.and_not(pc.match_substring_regex(texts, SEPARATORS), special)
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self.whole([texts[k].as_py()])[0], "<u4").tobytes()
        for k in np.flatnonzero(split.to_numpy(zero_copy_only=False)).tolist():
            words = [w for w in WHITE.split(texts[k].as_py()) if w]
            out[k] = self.together(pa.array([words], pa.large_list(pa.large_string())))[0]
        rest = np.flatnonzero(pc.invert(pc.or_(special, split)).to_numpy(zero_copy_only=False))
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)[rest]
        for at in np.split(rest, np.flatnonzero(np.diff(np.cumsum(sizes) // STRETCH)) + 1):
            if len(at):
                found = self.together(pc.utf8_split_whitespace(texts.take(pa.array(at))))
                for k, ids in zip(at.tolist(), found, strict=True):
                    out[k] = ids
        return out


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte: itself, or for the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut each at multiples of ``window``: doc_id, start, length, ids_crc32, doc_tokens."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches, SLICE // 2):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc_id, k, min(window, n - k), zlib.crc32(ids[4 * k : 4 * (k + window)]), n) for k in range(0, n, window)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def combinations(counts: dict[int, int], window: int, most: int = 20_000) -> np.ndarray:
    """Rows of up to three lengths (zero for none) that occur and add up to ``window`` exactly.

    Singles and pairs are all there. Triples are thinned to about ``most`` (a grid over their larger lengths): they only
    shape the plan, and whatever it leaves over is packed all the same.
    """
    have = np.zeros(window + 1, bool)
    have[[k for k in counts if k <= window]] = True
    lengths = np.flatnonzero(have[1:]) + 1
    rows = [np.array([[window, 0, 0]])] if have[window] else []
    low = lengths[(2 * lengths <= window) & have[window - lengths]]
    rows.append(np.stack([window - low, low, np.zeros_like(low)], axis=1))
    step = max(1, int(np.ceil(len(lengths) / np.sqrt(2 * most))))
    first, second = np.meshgrid(lengths[::step], lengths, indexing="ij")
    third = window - first - second
    fits = (second <= first) & (third >= 1) & (third <= second) & have[np.clip(third, 0, window)]
    rows.append(np.stack([first[fits], second[fits], third[fits]], axis=1)[:: max(1, int(fits.sum() / most))])
    return np.concatenate(rows)


def repeat_counts(shapes: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x so that sum of x over shapes matches ``counts``."""
    if not len(shapes):
        return np.zeros(0)
    width = len(counts)
    weight = 1.0 / np.maximum(counts, 1.0)  # relative errors count, so that rare lengths are matched as well

    def gather(v: np.ndarray) -> np.ndarray:
        return v[shapes].sum(axis=1)

    def spread(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(shapes[:, k], weights=x, minlength=width) for k in range(shapes.shape[1]))
        out[0] = 0
        return out

    target = counts * weight
    target[0] = 0
    goal = np.maximum(gather(target), 1e-12)
    x = np.full(len(shapes), counts[1:].sum() / max(1, shapes.astype(bool).sum()))
    for _ in range(rounds):
        x *= goal / np.maximum(gather(spread(x) * weight), 1e-12)
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to how often, repeats) that use up ``counts`` exactly."""
    left = np.zeros(window + 1, np.int64)
    for k, n in counts.items():
        left[k] += n
    out: list[tuple[dict[int, int], int]] = []
    shapes = combinations(counts, window)
    x = repeat_counts(shapes, left.astype(float))
    for k in np.argsort(-x, kind="stable"):
        n = int(np.rint(x[k]))
        if n < 1:
            break
        pattern = Counter(v for v in shapes[k].tolist() if v)
        n = min([n, *(int(left[v]) // m for v, m in pattern.items())])
        if n > 0:
            out.append((dict(pattern), n))
            for v, m in pattern.items():
                left[v] -= n * m
    while left.any():  # the longest that is left, then whatever fits; as often as the counts allow
        pattern, room = {}, window
        free = left.copy()
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            m = min(int(free[v]), room // v)
            pattern[v] = m
            free[v] = 0
            room -= m * v
        n = min(int(left[v]) // m for v, m in pattern.items())
        out.append((pattern, n))
        for v, m in pattern.items():
            left[v] -= n * m
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, how often in a window, first window, first offset), by first rank."""
    used: Counter[int] = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, n in patterns:
        at = 0
        for v, m in sorted(pattern.items(), reverse=True):
            out.setdefault(v, []).append((used[v], m, base, at))
            used[v] += n * m
            at += v * m
        base += n
    return {v: np.array(x, np.int64) for v, x in out.items()}


def ranked(found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``found`` (written, see ``numbered``) with the rank of each piece within its length, counted in groups of about RANK_GROUP.

    Groups are dealt by row number, so that pieces repeated in full do not meet in one of them.
    """
    spark = found.sparkSession
    groups = spark.createDataFrame([(k, max(1, -(-n // RANK_GROUP))) for k, n in counts.items()], "length long, groups long")
    dealt = numbered(found).join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64(ROW), "groups")).drop("groups")
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("size"))
    w = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "group", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "group").orderBy(ROW)) - 1
    return dealt.withColumn("place", place).join(before, ["length", "group"]).withColumn("rank", F.col("place") + F.col("before")).drop("place", "before", "group", ROW)


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Place pieces into windows: adds sequence_id and offset. Every piece comes back once; ``found`` may be empty."""
    found = materialize(found, "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most ``window`` rows
    places = slots(plan(counts, window))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    table = places[int(length[at[0]])]
                    row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                    nth, inside = np.divmod(rank[at] - row[:, 0], row[:, 1])
                    sequence[at], offset[at] = row[:, 2] + nth, row[:, 3] + inside * length[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    return ranked(found, counts).select(*columns, "rank").mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenize, cut and pack ``docs``.

    A null text is an empty one and has the end id alone; a null doc_id is carried along; repeated rows are packed as
    often as they are there; an empty table gives an empty result. Other columns of ``docs`` are not looked at.
    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, tokenizer, window), window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
