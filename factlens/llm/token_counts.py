"""Token counts that follow edits.

A document's pre-tokens are grouped into leaves; a segment tree over the leaves keeps code points and tokens of every
subtree. Trees are written with the texts and read again when a new version comes: building them and applying edits are two
steps, and only the first one encodes whole texts. An edit changes the leaves that it touches and, as the pattern looks
ahead, may change the one just before; from that leaf's start pre-tokens are matched anew until a boundary past the edit
coincides with an old leaf boundary. Only that stretch is encoded, grouped into leaves again, and the sums above are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import kept_in_task, materialize, read_table, sliced, tidy

#: Pre-tokens of a leaf.
LEAF = 16
#: Code points before an edit that a match may have looked at.
CONTEXT = 4
CACHE_TOKENS, CACHE_LEN = 300_000, 64

EDITS = "array<struct<start:int,length:int,text:string>>"


class Counter:
    """Tokens of pre-tokens, with a cache; a worker keeps its counter from task to task."""

    kept: ClassVar[dict[tuple[str, str], Counter]] = kept_in_task()

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Counter:
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
        self.seen: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        seen = self.seen
        try:
            return list(map(seen.__getitem__, tokens))
        except KeyError:
            pass
        out = []
        for t in tokens:
            n = seen.get(t)
            if n is None:
                n = len(self.encoding.encode_ordinary(t))
                if len(t) <= CACHE_LEN:
                    if len(seen) >= CACHE_TOKENS:
                        seen.clear()
                    seen[t] = n
            out.append(n)
        return out

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each leaf of a whole text."""
        return self.grouped(self.find.findall(text))

    def grouped(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each leaf of pre-tokens; one empty leaf if there are none."""
        if not tokens:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        starts = np.arange(0, len(tokens), LEAF)
        return tuple(np.add.reduceat(np.array(x, np.int64), starts) for x in (list(map(len, tokens)), self.counts(tokens)))


def tree(leaves: np.ndarray) -> np.ndarray:
    """Sums of a complete binary tree over the leaves: the root at 1, the children of k at 2k and 2k + 1."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * width, np.int64)
    out[width : width + len(leaves)] = leaves
    level = width
    while level > 1:
        out[level // 2 : level] = out[level : 2 * level : 2] + out[level + 1 : 2 * level : 2]
        level //= 2
    return out


def set_leaf(sums: np.ndarray, leaf: int, value: int) -> None:
    k = len(sums) // 2 + leaf
    change = value - sums[k]
    while change and k:
        sums[k] += change
        k //= 2


def leaf_at(chars: np.ndarray, position: int) -> tuple[int, int]:
    """The leaf that holds a code point (past the end: the last with any), and where it starts."""
    k, before = 1, 0
    position = min(position, int(chars[1]) - 1)
    while k < len(chars) // 2:
        k *= 2
        if position >= before + chars[k]:
            before += int(chars[k])
            k += 1
    return k - len(chars) // 2, before


def with_leaves(sums: np.ndarray, n: int, first: int, last: int, new: np.ndarray) -> np.ndarray:
    """The tree of ``n`` leaves with ``new`` in place of leaves ``first`` to ``last``; sums alone change where as many replace them."""
    if len(new) == last - first + 1:
        for k, value in enumerate(new.tolist()):
            set_leaf(sums, first + k, value)
        return sums
    width = len(sums) // 2
    return tree(np.concatenate([sums[width : width + first], new, sums[width + last + 1 : width + n]]))


def apply(text: str, trees: tuple[np.ndarray, np.ndarray], n: int, start: int, length: int, new: str, counter: Counter) -> tuple[str, tuple[np.ndarray, np.ndarray], int, int]:
    """Replace ``length`` code points at ``start``. Returns the text, both trees, their number of leaves and what was matched anew."""
    chars, tokens = trees
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    first, at = leaf_at(chars, max(0, start - CONTEXT)) if len(text) else (0, 0)
    whole = text[:start] + new + text[start + length :]
    shift = len(new) - length
    width = len(chars) // 2
    last, end = first, at + int(chars[width + first])  # an old leaf and its end
    while end < start + length and last + 1 < n:
        last += 1
        end += int(chars[width + last])
    matched, position = [], at
    for m in counter.find.finditer(whole, at):
        while end + shift < position and last + 1 < n:
            last += 1
            end += int(chars[width + last])
        if position >= start + len(new) and position == end + shift and position > at:
            break
        matched.append(m[0])
        position = m.end()
    else:
        last, position = n - 1, len(whole)
    fresh = counter.grouped(matched)
    trees = with_leaves(chars, n, first, last, fresh[0]), with_leaves(tokens, n, first, last, fresh[1])
    return whole, trees, n - (last - first + 1) + len(fresh[0]), position - at


TREES = "char_tree array<long>, token_tree array<long>, leaves int"


def build_trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) with the segment trees over code points and tokens of its whole texts, and how many leaves they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(ranks, pattern)
        for batch in sliced(batches):
            leaves = [counter.leaves(t.as_py() or "") for t in batch.column("text")]
            arrays = [pa.array([tree(x[k]) for x in leaves], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, pa.array([len(x[0]) for x in leaves], pa.int32())], names=["doc_id", "text", "char_tree", "token_tree", "leaves"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), f"doc_id long, text string, {TREES}")


def apply_edits(stored: DataFrame, edits: Column, ranks: str, pattern: str) -> DataFrame:
    """Apply ``edits`` to each stored document, from the last to the first so that positions hold, and bring its trees up to date.

    ``stored`` has doc_id, text and the trees, as ``build_trees`` gives them and as they were written. Returns doc_id, the new
    text and trees (to be stored in turn), n_chars, n_tokens, edited_chars, edited_tokens and rematched_chars (code points
    encoded anew).
    """
    names = ["doc_id", "text", "char_tree", "token_tree", "leaves", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "rematched_chars"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(ranks, pattern)
        for batch in sliced(batches):
            rows = []
            for doc_id, text, chars, tokens, n, changes in zip(*batch.columns, strict=True):
                text, n, anew = text.as_py() or "", n.as_py(), 0
                trees = tuple(x.values.to_numpy(zero_copy_only=False).copy() for x in (chars, tokens))
                before = [int(x[1]) for x in trees]
                usable = [e for e in changes.as_py() or [] if e and e["start"] is not None]
                for e in sorted(usable, key=lambda e: -e["start"]):
                    text, trees, n, matched = apply(text, trees, n, e["start"], e["length"] or 0, e["text"] or "", counter)
                    anew += matched
                rows.append((doc_id.as_py(), text, *trees, n, *before, int(trees[0][1]), int(trees[1][1]), anew))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    fields = f"doc_id long, text string, {TREES}, " + ", ".join(f"{c} long" for c in names[5:])
    return stored.select("doc_id", "text", "char_tree", "token_tree", "leaves", edits.cast(EDITS).alias("edits")).mapInArrow(tidy(run), fields)


def count_edited(docs: DataFrame, edits: Column, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Count the tokens of whole texts, and again after ``edits`` (start, length, text; positions in the text, not overlapping).

    The trees of the first count are written; the second one reads them. ``edits`` is a column over doc_id and text. A null
    text is an empty one; null edits change nothing; positions past the end count as the end. A null doc_id is carried
    along, repeated rows come back as often as they are there, and an empty table gives an empty result.

    Returns doc_id, n_chars, n_tokens, edited_chars, edited_tokens and rematched_chars.
    """
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    stored = materialize(build_trees(docs, ranks, pattern), "token-trees", compression="zstd")
    return apply_edits(stored, edits, ranks, pattern).drop("text", "char_tree", "token_tree", "leaves")


def sample_edits() -> Column:
    """Three edits of each text: a deletion near its start, an insertion of its end, and an eighth replaced by its start."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)

    def at(share: int) -> Column:
        return F.floor(n / share).cast("int")

    def edit(start: Column, length: Column, new: Column) -> Column:
        return F.struct(start.alias("start"), length.alias("length"), new.alias("text"))

    return F.array(
        edit(at(10), F.least(at(20), F.lit(64)), F.lit("")),
        edit(at(5), F.lit(0), F.right(text, F.lit(16))),
        edit(at(2), at(8), F.substring(text, F.lit(1), at(8))),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, counted before and after edits."""
    return count_edited(read_table(spark, sf_dir, "documents"), sample_edits())
