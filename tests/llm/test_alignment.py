import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factlens.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(texts: list) -> list[tuple]:
    """The contract by loops over whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    own |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if chr(x) not in own)}
    rows, links, seen = [], [], collections.Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(own[c] for c in a.id_to_token(k)) for k in ids_a]
        names = [b.id_to_piece(k) for k in ids_b]
        bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        if not text or not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts, groups, shared = sorted({*ends_a} & {*ends_b}), [], 0
        for low, high in zip([0, *cuts], cuts, strict=False):
            x = [str(i) for i, e in zip(ids_a, ends_a, strict=True) if low < e <= high]
            y = [str(i) for i, e in zip(ids_b, ends_b, strict=True) if low < e <= high]
            groups.append(f"{','.join(x)}|{','.join(y)}")
            shared += len(x) * len(y)
        found = [
            (i, j)
            for i, e, x in zip(ids_a, ends_a, bytes_a, strict=True)
            for j, f, y in zip(ids_b, ends_b, bytes_b, strict=True)
            if e - len(x) < f and f - len(y) < e
        ]
        seen.update(set(found))
        links.append(found)
        rows.append((len(ids_a), len(ids_b), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", shared))
    most = collections.defaultdict(int)
    for (i, _), n in seen.items():
        most[i] = max(most[i], n)
    return [(*r[:4], sum(seen[x] == most[x[0]] for x in f), sum(seen[x] for x in f), *r[4:]) for r, f in zip(rows, links, strict=True)]


TEXTS = ["a  b", "  a ", " ", "\n", "a\tb\n\n c", "ﬁ ｆｕｌｌ é é", "▁x", "x ▁ y", "a b c  d", "a\x00b \x1c c\x85 d", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we'll  it's", "字字字 字字", "💡💡 💡", "1234 56 7", "word " * 40]


@pytest.mark.parametrize("common", [alignment.COMMON, 3, 0])
def test_alignment_as_plain_loops(spark, docs, common):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    rng = random.Random(3)
    texts += [(1000 + k, x) for k, x in enumerate(TEXTS)]
    texts += [(2000 + k, "".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "'ll", "9", "!", "é", "　", "字", "▂", "ing"]) for _ in range(rng.randrange(60)))) for k in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    found = alignment.alignments(table, A, B, common).collect()
    want = [(d, *r) for (d, _), r in zip(texts, plain([t for _, t in texts]), strict=True)]
    assert sorted((str(x[0]), *x[1:]) for x in found) == sorted((str(x[0]), *x[1:]) for x in want)


def test_alignment_of_empty_and_long_texts(spark, docs, empty, monkeypatch):
    assert alignment.alignments(empty, A, B).count() == 0
    long = spark.createDataFrame([(1, "so it goes on and on, " * 30_000), (2, "x" * 60_000), (3, None)], "doc_id long, text string")
    whole = {r.doc_id: r for r in alignment.alignments(long, A, B).collect()}
    assert whole[3].n_links == 0 and whole[3].groups_sha256 == ""
    ids = Tokenizer.from_file(A).encode(" " + "so it goes on and on, " * 30_000, add_special_tokens=False).ids
    assert whole[1].n_a == len(ids)


def test_products_as_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, k, m = rng.integers(1, 12, 3)
        left, right = rng.random((n, k)) < 0.4, rng.random((k, m)) < 0.4
        rows = [alignment.Rows.of(np.nonzero(x)[1], x.sum(axis=1)) for x in (left, right)]
        out = np.zeros((n, m), np.int64)
        for i, j, value in alignment.product(*rows):
            out[i, j] = value
        assert (out == left.astype(int) @ right.astype(int)).all()
        back = rows[0].transposed(int(k))
        assert (back.columns == np.nonzero(left.T)[1]).all() and (np.diff(back.starts) == left.sum(axis=0)).all()
