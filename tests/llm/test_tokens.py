import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from factlens.llm import bpe, packing, token_counts


def encoding(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 500])
def test_bpe_as_the_library(docs, chunk):
    own = encoding("byte_bpe_multi_50k.tiktoken")
    want = sorted(
        (str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in docs.collect()
        for ids in [own.encode_ordinary(r.text or "")]
    )
    found = bpe.encode_documents(docs, chunk=chunk, overlap=min(chunk // 2, bpe.OVERLAP)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_stitching_random_texts():
    codec, rng = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "'ll", "9", "!", "é", "　", "字"]) for _ in range(rng.randrange(1, 300)))
        chunk = rng.randrange(5, 40)
        parts = bpe.cut(text, chunk, rng.randrange(1, 20))
        ends = (np.fromiter(codec.ends(p), np.int32) for p in parts)
        tokens = [t for group in bpe.stitch(zip(parts, ends, strict=True), codec, chunk) for t in group]
        assert tokens == codec.find.findall(text)


def test_packing(docs):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [(r.doc_id, np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in docs.collect()]
    found = packing.pack_documents(docs).collect()
    want = sorted((str(d), k, min(2048, len(x) - k), zlib.crc32(x[k : k + 2048].tobytes()), len(x)) for d, x in texts for k in range(0, len(x), 2048))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_words_encode_as_the_tokenizer_does():
    own, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(3)
    texts = [None, "", "   ", "end <|endoftext|> of <|startoftext|> x", "a\x1cb <|endoftext|>c", "<|EndOfText|>", "İstanbul ǅx ΑΣ 北京 💡", "x²³ ª 12'345 don''t 'll'll y\x85z", "ŉ ß ẞ", "a\u0301e"]
    for letters in ("aAzZéÉßİıǅ'’.,19²\t \n \x1c\x0b<|>stl", "".join(map(chr, range(0x250)))):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(2000)]
    encoder = packing.WordEncoder(P.path("word_bpe_49k.json"), 10_000)
    for k in range(0, len(texts), 300):
        found = encoder.encode(packing.pa.array(texts[k : k + 300], packing.pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [own.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 300]]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1.2, 30_000).astype(int), 1, 2048)
    values, counts = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), counts.tolist(), strict=True))
    patterns = packing.plan(counts)
    used, windows = {}, 0
    for pattern, n in patterns:
        assert n > 0 and sum(v * m for v, m in pattern.items()) <= 2048
        windows += n
        for v, m in pattern.items():
            used[v] = used.get(v, 0) + n * m
    assert used == counts
    assert windows * 2048 <= 1.02 * lengths.sum() + 2048


def test_plan_edge_cases():
    assert packing.plan({}) == []
    assert packing.plan({1: 5000}) and packing.plan({2048: 3}) == [({2048: 3 // 3}, 3)]


def edits_of(text, rng):
    n = len(text)
    cuts = sorted(rng.randrange(0, n + 1) for _ in range(4))
    words = ["", " ", "x", "'ll go", "\n\n", "12 34", "é" * 9]
    return [(cuts[0], cuts[1] - cuts[0], rng.choice(words)), (cuts[2], cuts[3] - cuts[2], rng.choice(words))]


def test_edits_against_a_full_recount():
    own, rng = encoding("byte_bpe_50k.tiktoken"), random.Random(8)
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " cd", " ", "\n", "'s", "42", "?!", "ö"]) for _ in range(rng.randrange(0, 400)))
        leaves = counter.leaves(text)
        trees, n = tuple(map(token_counts.tree, leaves)), len(leaves[0])
        for start, length, new in reversed(edits_of(text, rng)):
            text, trees, n, _ = token_counts.apply(text, trees, n, start, length, new, counter)
            assert (trees[0][1], trees[1][1]) == (len(text), len(own.encode_ordinary(text)))
            assert all(len(x) == 2 << max(0, (n - 1).bit_length()) for x in trees)
            assert (trees[0] == token_counts.tree(trees[0][len(trees[0]) // 2 :][:n])).all()


def test_a_large_insertion_is_split_into_leaves():
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "a few words here " * 50
    leaves = counter.leaves(text)
    text, trees, n, anew = token_counts.apply(text, tuple(map(token_counts.tree, leaves)), len(leaves[0]), 100, 0, "some more of them " * 5000, counter)
    assert anew >= 90_000
    text, trees, n, anew = token_counts.apply(text, trees, n, 50_000, 3, "x", counter)
    assert anew < 400 and trees[0][1] == len(text) and trees[1][1] == len(counter.encoding.encode_ordinary(text))


def test_stored_trees_are_read_and_only_touched_leaves_change(spark, docs, tmp_path):
    """What a stored tree says of leaves that no edit touches goes into the new count, right or wrong."""
    ranks, whole = P.path("byte_bpe_50k.tiktoken"), docs.filter("doc_id = 100")
    token_counts.build_trees(whole, ranks, P.PATTERN).write.parquet(str(tmp_path / "trees"))
    stored = spark.read.parquet(str(tmp_path / "trees"))
    edits = token_counts.F.expr("array(struct(5 AS start, 2 AS length, 'zz' AS text))")
    right = token_counts.apply_edits(stored, edits, ranks, P.PATTERN).first()
    own = encoding("byte_bpe_50k.tiktoken")
    assert right.edited_tokens == len(own.encode_ordinary(right.text)) and right.rematched_chars < 300
    last = token_counts.F.expr("transform(token_tree, (x, k) -> x + IF(k IN (1, 3, size(token_tree) - 1), 1000, 0))")
    wrong = token_counts.apply_edits(stored.withColumn("token_tree", last), edits, ranks, P.PATTERN).first()
    assert wrong.edited_tokens == right.edited_tokens + 1000
    again = token_counts.apply_edits(token_counts.apply_edits(stored, edits, ranks, P.PATTERN), edits, ranks, P.PATTERN).first()
    assert (again.n_tokens, again.edited_tokens) == (right.edited_tokens, len(own.encode_ordinary(again.text)))


def test_edited_counts(docs, empty):
    own = encoding("byte_bpe_50k.tiktoken")
    found = token_counts.count_edited(docs, token_counts.sample_edits()).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in found) == sorted((str(r.doc_id), len(r.text or ""), len(own.encode_ordinary(r.text or ""))) for r in docs.collect())
    want = []
    for r in docs.select("doc_id", "text", token_counts.sample_edits().alias("edits")).collect():
        text = r.text or ""
        for e in sorted(r.edits, key=lambda e: -e.start):
            text = text[: e.start] + e.text + text[e.start + e.length :]
        want.append((str(r.doc_id), len(text), len(own.encode_ordinary(text))))
    assert sorted((str(r.doc_id), r.edited_chars, r.edited_tokens) for r in found) == sorted(want)
    assert token_counts.count_edited(empty, token_counts.sample_edits()).count() == 0
    assert bpe.encode_documents(empty).count() == 0 and packing.pack_documents(empty).count() == 0
