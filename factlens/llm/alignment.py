"""Alignment of two tokenizers over the same bytes, and how common each pair of aligned tokens is.

Both tokenizers cut the same string of bytes into tokens, so each has an incidence matrix of tokens by bytes. These are
built by hand as compressed sparse rows, and the product of A with B transposed, taken row by row (Gustavson), has an entry
for every two tokens whose byte ranges overlap. Where tokens of both end at the same byte a group ends; the product of the
matrices of tokens by groups has an entry for every two tokens of one group.

A's pattern ends a pre-token before a space that follows what isn't white space, and no piece of B holds a space after
another character, so a text falls apart at each single space between two characters that aren't white space: tokens, groups and links of such a unit depend on it alone. Each distinct unit of a stretch of texts is
encoded and multiplied out once, and what a text has is put together by index. Documents that hold a pair are counted by
a shuffle of the pairs of each document; the most common pairs are then looked up in a table of bounded size at each task, and
all others are joined by pair.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import ROW, materialize, read_table, sliced, tidy
from factlens.llm.packing import byte_letters

#: A single space between two other characters; what follows starts a unit.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts without this, within or at their ends, have units between all their spaces.
ODD = re.compile(r"\s | \s")
#: How A's byte-level pre-tokeniser cuts texts (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points beyond which a text is worked on in stretches.
STRETCH = 1 << 18
#: Units that a task remembers, and their mean length, at most.
UNITS, UNIT_LEN = 400_000, 32
#: Units that B encodes at once, and texts whose units are learnt together.
TOGETHER, SLICE = 64, 512
#: Entries of a product that are made at once, unless one row has more.
BLOCK = 1 << 20
#: The most common pairs, which every task looks up by itself; all others are joined.
COMMON = 1 << 18
#: Bits of a pair's key for the id of B.
ID_BITS = 32

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, times array<long>"


@dataclass(frozen=True)
class Rows:
    """Where the entries of a 0/1 matrix lie, by rows: those of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, columns: np.ndarray, lengths: np.ndarray) -> Rows:
        return cls(np.r_[0, np.cumsum(lengths, dtype=np.int64)], columns)

    def transposed(self, width: int) -> Rows:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Rows.of(rows[np.argsort(self.columns, kind="stable")], np.bincount(self.columns, minlength=width))


def product(left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of left times right, in order, a block of rows at a time.

    By Gustavson: a row of the product is the sum of those rows of ``right`` that the entries of the row of ``left`` name.
    """
    each = np.diff(right.starts)
    load = np.r_[0, np.cumsum(each[left.columns])][left.starts]  # entries to add up before each row
    first, n = 0, len(left.starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(load, load[first] + BLOCK, side="right")) - 1)
        at = left.columns[left.starts[first] : left.starts[last]]
        rows = np.repeat(np.arange(first, last), np.diff(left.starts[first : last + 1]))
        lengths = each[at]
        ends = np.cumsum(lengths)
        columns = right.columns[np.arange(ends[-1] if len(ends) else 0) + np.repeat(right.starts[at] - (ends - lengths), lengths)]
        rows = np.repeat(rows, lengths)
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])][: len(rows)])
        yield rows[new], columns[new], np.diff(np.r_[new, len(rows)])
        first = last


@dataclass(frozen=True)
class Aligned:
    """Tokens over one string of bytes: groups as numbers of tokens, links as pairs of positions with the bytes shared."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared_bytes: np.ndarray
    in_groups: Rows
    group_tokens: Rows

    @property
    def n_groups(self) -> int:
        return len(self.group_tokens.starts) - 1

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (a, b) of all tokens in one group, in blocks."""
        for a, b, _ in product(self.in_groups, self.group_tokens):
            yield a, b


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """The alignment of two ways to cut the same bytes, given the bytes of each token (none has zero)."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    tokens_a, tokens_b = Rows.of(np.arange(total), lengths_a), Rows.of(np.arange(total), lengths_b)
    found = list(product(tokens_a, tokens_b.transposed(total)))
    a, b, shared = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in range(3))
    ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
    in_a = Rows.of(group_a, np.ones(len(group_a), np.int64))
    in_b = Rows.of(group_b, np.ones(len(group_b), np.int64)).transposed(len(ends))
    return Aligned(group_a, group_b, a, b, shared, in_a, in_b)


class Tokens:
    """Ids and bytes of both tokenizers; A takes a string that starts with a space, B the same without that space."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        import tiktoken

        letters = {c: b for b, c in enumerate(byte_letters())}
        with open(byte_bpe, encoding="utf-8") as f:
            stored = json.load(f)
        special = {x["content"] for x in stored["added_tokens"]}
        ranks = {bytes(letters[c] for c in x): k for x, k in stored["model"]["vocab"].items() if x not in special}
        self.bytes_a = [b""] * (max(stored["model"]["vocab"].values()) + 1)
        for x, k in ranks.items():
            self.bytes_a[k] = x
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        found = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(found)]
        if any(re.search(rb"[^ ] ", x) for x in self.bytes_b):
            raise ValueError("a piece holds a space after another character, so texts don't fall apart at spaces")
        self.length_a, self.length_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))

    def encode(self, units: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of both for units, a space before each, one after the other; None if they don't give back the bytes or cross units."""
        text = " ".join(units)
        ids_a = self.a.encode_ordinary(" " + text)
        ids_b = list(itertools.chain.from_iterable(self.b.encode([" ".join(units[k : k + TOGETHER]) for k in range(0, len(units), TOGETHER)], num_threads=1)))
        wanted = (" " + text).encode()
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == wanted == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return None
        return ids_a, ids_b


class Units:
    """What each distinct unit has: counts, groups as text, pairs of ids; known ones are looked up."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.size = 0
        self.counts = np.empty((0, 6), np.int64)  # valid, tokens of A and B, groups, links, pairs that share a group
        self.groups: list[bytes] = []
        self.pairs, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)

    def trim(self) -> None:
        if len(self.at) > UNITS or self.size > UNITS * UNIT_LEN:
            self.forget()

    def learn(self, units: list[str]) -> None:
        """Units whose bytes come back are kept with what they have, the others as not valid.

        Units that neither start nor end with white space are encoded together: a text of theirs falls apart into them.
        """
        plain = [x for x in units if x and not (x[0].isspace() or x[-1].isspace())]
        ids = self.tokens.encode(plain) if plain else ([], [])
        single = {x for x in units if ids is None or not x or x[0].isspace() or x[-1].isspace()}
        order = ([] if ids is None else plain) + [x for x in units if x in single]
        ids_a, ids_b = ([], []) if ids is None else ids
        valid = [1] * len(order)
        for k, x in enumerate(order):
            if x in single:
                own = self.tokens.encode([x])
                if own is None:
                    valid[k] = 0
                else:
                    ids_a, ids_b = ids_a + own[0], ids_b + own[1]
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        counts = np.zeros((len(order), 6), np.int64)
        counts[:, 0] = valid
        length_a, length_b = self.tokens.length_a[a], self.tokens.length_b[b]
        fine = np.flatnonzero(counts[:, 0])
        ends = np.cumsum([1 + len(order[k].encode()) for k in fine])
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
        own_a, own_b = (fine[np.searchsorted(ends, x)] for x in (ends_a, ends_b))
        found = align(length_a, length_b)
        linked = own_a[found.link_a]
        own_group = np.empty(found.n_groups, np.int64)
        own_group[found.group_a] = own_a
        for column, of in ((1, own_a), (2, own_b), (3, own_group), (4, linked)):
            counts[:, column] = np.bincount(of, minlength=len(order))
        for at, _ in found.shared():
            counts[:, 5] += np.bincount(own_a[at], minlength=len(order))
        self.at.update(zip(order, range(len(self.groups), len(self.groups) + len(order)), strict=True))
        self.size += sum(map(len, order))
        texts = iter(written_groups(a, b, found, own_group))
        self.groups += [next(texts) if v else b"" for v in valid]
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, a[found.link_a] << ID_BITS | b[found.link_b]])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(counts[:, 4])]

    def meet(self, units: set[str]) -> None:
        """Learn those that aren't known."""
        if new := units.difference(self.at):
            self.learn(list(new))

    def of(self, units: list[str]) -> np.ndarray:
        """The numbers of units that are known."""
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        return self.pairs[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)]


def written_groups(a: np.ndarray, b: np.ndarray, found: Aligned, unit: np.ndarray) -> list[bytes]:
    """The groups of each unit as text: ids of A, of B, and the next group's."""
    group = np.concatenate([found.group_a, found.group_b])
    of_b = np.r_[np.zeros(len(a), bool), np.ones(len(b), bool)]
    order = np.lexsort((of_b, group))
    group, of_b = group[order], of_b[order]
    new_group = np.r_[True, group[1:] != group[:-1]][: len(group)]
    new_unit = np.r_[True, unit[group[1:]] != unit[group[:-1]]][: len(group)]
    turns = np.r_[False, of_b[1:] & ~of_b[:-1]][: len(group)]
    before = np.where(new_unit, "\n", np.where(new_group, ";", np.where(turns, "|", ","))).tolist()
    ids = map(str, np.concatenate([a, b])[order].tolist())
    return "".join(itertools.chain.from_iterable(zip(before, ids, strict=True))).encode().split(b"\n")[1:]


def units_of(text: str) -> list[str]:
    """The units of a text, without the space before each."""
    if ODD.search(text) or text[:1].isspace() or text[-1:].isspace():
        return CUT.split(text)
    return text.split(" ")


def stretches(text: str) -> Iterator[str]:
    """A text in stretches that end where a unit does; the space between them is left out."""
    start = 0
    while start < len(text):
        cut = CUT.search(text, start + STRETCH)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end + 1


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([np.empty(0), *times]), len(distinct)).astype(np.int64)


NOTHING = np.zeros(6, np.int64), "", np.empty(0, np.int64), np.empty(0, np.int64)


def measured(parts: Iterable[list[str]], known: Units) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """Counts, digest of the groups, distinct pairs and how often each is linked, of a whole text in lists of known units."""
    counts, digest = np.zeros(6, np.int64), hashlib.sha256()
    keys, times, before = [], [], b""
    for units in parts:
        at = known.of(units)
        sums = known.counts[at].sum(axis=0)
        if sums[0] < len(at):
            return NOTHING
        counts += sums
        digest.update(before + b";".join(map(known.groups.__getitem__, at.tolist())))
        before = b";"
        distinct, n = np.unique(known.pairs_of(at), return_counts=True)
        keys.append(distinct)
        times.append(n)
    if not keys:
        return NOTHING
    distinct, n = (keys[0], times[0]) if len(keys) == 1 else summed(keys, times)
    return counts, digest.hexdigest(), distinct, n


def measured_texts(texts: list[str], known: Units) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
    """``measured`` of each text; units of short texts are learnt together, those of a long one stretch by stretch."""
    cut = [units_of(x) if x and len(x) <= STRETCH else None for x in texts]
    known.meet(set().union(*filter(None, cut)))

    def pieces(text: str) -> Iterator[list[str]]:
        for x in stretches(text):
            units = units_of(x)
            known.trim()
            known.meet(set(units))
            yield units

    short = [measured([x], known) if x else None for x in cut]
    return [done or measured(pieces(text), known) for done, text in zip(short, texts, strict=True)]


def documents_aligned(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """RESULT of every document: counts, digest of groups, distinct pairs of linked ids (A's id in the upper bits) with the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(Tokens(byte_bpe, pieces))
        for batch in sliced(batches, SLICE):
            known.trim()
            rows = measured_texts([x or "" for x in batch.column("text").to_pylist()], known)
            counts = np.array([x[0] for x in rows]).reshape(-1, 6)
            lists = [pa.array([x[k] for x in rows], pa.list_(pa.int64())) for k in (2, 3)]
            columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(1, 6)), pa.array([x[1] for x in rows], pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), RESULT)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n documents that hold the pair linked, best: no pair of the same id of A is in more)."""
    counts = materialize(aligned.select(F.explode("pairs").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "pairs")
    counts = counts.withColumn("a", F.shiftright("key", ID_BITS))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def looked_up(rows: DataFrame, counts: DataFrame, common: int) -> DataFrame:
    """``rows`` with the sums over those of their pairs that are among the ``common`` most frequent, and the other pairs as they are."""
    top = counts.orderBy(F.desc("n"), "key").limit(common).toArrow().sort_by("key")
    table = rows.sparkSession.sparkContext.broadcast([top.column(c).to_numpy() for c in ("key", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in sliced(batches):
            pairs, times = (batch.column(c) for c in ("pairs", "times"))
            key, links = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.searchsorted(keys, key)
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], own[hit], links[hit] * best[at[hit]])
            np.add.at(sums[1], own[hit], links[hit] * n[at[hit]])
            ends = np.r_[0, np.cumsum(np.bincount(own[~hit], minlength=batch.num_rows))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (key, links)]
            kept = [batch.column(c) for c in kept_columns]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *rest], names=[*kept_columns, "n_best", "count_sum", "pairs", "times"])

    kept_columns = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c in kept_columns), "n_best long, count_sum long, pairs array<long>, times array<long>"])
    return rows.mapInArrow(tidy(run), schema)


def alignments(docs: DataFrame, byte_bpe: str, pieces: str, common: int = COMMON) -> DataFrame:
    """How two tokenizers align on each whole text of ``docs``, and how common its pairs of linked ids are among all documents.

    n_a, n_b: tokens; n_groups: runs of bytes at whose end tokens of both end; n_links: pairs of token occurrences whose
    bytes overlap; n_shared: pairs that lie in one group; n_best: links whose pair is in as many documents as any pair of its
    id of A; count_sum: over links, the documents that hold the link's pair; groups_sha256: of the groups' ids as text.

    Null and empty texts, and texts whose tokens don't give back their bytes, have no tokens: zeros, and no digest. Repeated
    rows count as documents of their own, null doc_ids are carried along, an empty table gives an empty result and other
    columns aren't looked at.
    """
    aligned = materialize(documents_aligned(docs, byte_bpe, pieces).withColumn(ROW, F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = materialize(pair_counts(aligned), "counts")
    found = materialize(looked_up(aligned, counts, common), "looked-up", compression="zstd")
    rest = found.select(ROW, F.inline(F.arrays_zip("pairs", "times")).alias("key", "times")).join(counts.hint("merge"), "key")
    rest = rest.groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    sums = [(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_best", "best"), ("count_sum", "more"))]
    return found.join(rest, ROW, "left").select(*own, *sums, "groups_sha256", "n_shared")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the byte-level and the piece tokenizer on every document."""
    import public_tokenizers

    return alignments(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
