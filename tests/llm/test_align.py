"""Alignment of two tokenizers against a version that walks the texts token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import align
from tests.llm.test_operators import DOCS, clashing, docs, empty, rows  # noqa: F401

ODD = ["a", "B", "the", " ", "  ", "\n", "\x1c", "\x85", "é", "日本", "😀", "'s", "<|endoftext|>", "<s>", "<0x41>", "▁", "123", "x" * 40, "\x00", "é", "don't", " word", "ß"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = align.public_tokenizers_ab()
    made = Tokenizer.from_str(a)
    made.encode_special_tokens = True
    return made, SentencePieceProcessor(model_proto=b), align.Aligner((a, b))


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, by whole texts."""
    a, b, known = libraries
    grouped, linked = [], []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(known.bytes_a[i] for i in ids_a) != raw or b"".join(known.bytes_b[i] for i in ids_b) != raw:
            ids_a, ids_b = [], []
        groups, i, j, end_a, end_b = [], 0, 0, 0, 0
        own_a, own_b = [], []
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                own_a.append(ids_a[i])
                end_a += len(known.bytes_a[ids_a[i]])
                i += 1
            else:
                own_b.append(ids_b[j])
                end_b += len(known.bytes_b[ids_b[j]])
                j += 1
            if end_a == end_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        grouped.append((len(ids_a), len(ids_b), groups))
        linked.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    count = Counter(p for links in linked for p in links)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (n_a, n_b, groups), links in zip(grouped, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), links.total(), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_union_find_gives_components():
    rng = np.random.default_rng(1)
    for n, edges in ((1, 0), (50, 30), (400, 399), (400, 600)):
        a, b = rng.integers(0, n, edges), rng.integers(0, n, edges)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        assert align.united(n, a, b).tolist() == label
    chain = np.arange(4999)
    assert not align.united(5000, chain, chain + 1).any()


@pytest.mark.parametrize("block", [align.BLOCK, 200])
def test_operator(spark, rows, libraries, block):  # noqa: F811
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = [*rows, *((1000 + i, t, "en", "a", 1) for i, t in enumerate(texts)), (2000, "ab" * 3000, None, None, None)]
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], libraries)))
    got = align.align(clashing(spark.createDataFrame(rows, DOCS).repartition(3)), block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_empty_tables(empty, docs):  # noqa: F811
    assert align.align(empty).count() == 0
    assert align.align(docs.where("text is null or text = ''")).where("n_a + n_b + n_groups + n_links + n_best + count_sum = 0 and groups_sha256 = ''").count() == 3
