"""BPE with word ends against the tokenizers library, and the check of pairs against exact merging."""

import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import wordbpe
from tests.llm.test_operators import clashing, docs, empty, rows  # noqa: F401

ODD = ["a", "B", "the", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "Σ", "İ", "日本", "😀", "'s", "'LL", "<|startoftext|>", "<|endoftext|>", "<|", "</w>", "1", "½", "Ᲊ", "\U000107bb", "​", "_", "!!", "ß", "가", "x" * 70, "\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    return wordbpe.Vocabulary(wordbpe.public_tokenizer())


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary.source)


def test_texts_equal_the_library(vocabulary, library):
    rng = random.Random(1)
    latin = [chr(c) for c in range(1, 0x250)]
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["ab" * 5000, "xyzzy" * 3000, ""]
    got = wordbpe.Encoder(vocabulary, cache=500).encode([t.encode() for t in texts])
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [w.ids for w in want]


def test_only_failing_words_are_merged(vocabulary, monkeypatch):
    rng = random.Random(2)
    words = list({bytes(rng.choice(b"abcdefghiotnsr") for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    exact = [vocabulary.merged(w) for w in words]
    failing = [w for w, ids in zip(words, exact) if vocabulary.proposed(w) != ids]
    called, merge = [], vocabulary.merged
    monkeypatch.setattr(vocabulary, "merged", lambda w, ends=True: called.append(w) or merge(w, ends))
    assert [np.frombuffer(x, "<i4").tolist() for x in vocabulary.encode_words(words)] == exact
    assert 0 < len(failing) < len(words) and sorted(called) == sorted(failing)


def test_long_words_merge_as_short_ones(vocabulary):
    for word in (b"a" * 200, b"banana" * 30, b"thethethe" * 20 + b"x"):
        ids = [vocabulary.first[b] for b in word[:-1]] + [vocabulary.last[word[-1]]]
        assert vocabulary._merged_short(list(ids)) == vocabulary._merged_long(list(ids))


def test_operator(docs, rows, empty, library):  # noqa: F811
    got = wordbpe.round_trip(clashing(docs)).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0], *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    back = wordbpe.decode(wordbpe.encode(docs)).collect()
    assert sorted((len(r["ids"]), r["text"]) for r in back) == sorted((len(i), library.decode(i, skip_special_tokens=False)) for i in (library.encode(r[1] or "", add_special_tokens=False).ids for r in rows))
    assert wordbpe.round_trip(empty).count() == 0 == wordbpe.decode(wordbpe.encode(empty)).count()
