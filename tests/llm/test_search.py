"""Ranked search against brute force, and the stop by bounds."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import search
from tests.llm.test_operators import DOCS, clashing, docs, empty, rows  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    counts = [(r[0], Counter(terms_of(r[1]))) for r in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms_of(text))
    out = set()
    for i, ts in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out |= {(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])}
    return out


ITEMS = [(1, "The of über NAÏVE oser3"), (1, "blehe x"), (2, None), (3, ""), (None, "tion ers7 ing"), (4, "日本語 e'll a"), (5, "nowhere at all"), (6, "the " * 400)]


def test_search(spark, docs, rows, empty):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(rows, ITEMS, 5)
    got = search.search(clashing(docs).repartition(3), items.withColumn("doc_id", F.lit(1)), k=5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in search.search(docs, items, k=5, pairs=4).collect()} == want  # several passes
    assert search.search(empty, items).count() == 0 == search.search(docs, items.limit(0)).count()


def test_ties_and_stops_are_exact():
    """Groups of copies, and blocks where the bounds end the walk early."""
    rng = np.random.default_rng(5)
    weights = np.array([0, 900, 2000, 4000, 6000, 7000])
    size = 3000
    sizes = rng.integers(0, 6, size)
    terms = np.concatenate([np.sort(rng.choice(6, s, replace=False)) for s in sizes]).astype(np.int64)
    tfs, n = rng.integers(1, 9, len(terms)), rng.integers(5, 400, size)
    total = int(n.sum())
    block = search.Block(n, sizes, terms, tfs, weights, size, total)
    owner = np.repeat(np.arange(size), sizes)
    early = 0
    for own in ([1, 2], [3, 5], [0, 1, 2, 3, 4, 5], [0], []):
        asked = np.zeros(6, bool)
        asked[own] = True
        whole = np.bincount(owner, np.where(asked[terms], block.impact, 0), size).astype(np.int64)
        least = max(1, int(np.sort(whole)[-10]))
        found, scores, read = block.best(np.array(own, np.int64), asked, 10, 0)
        assert set(np.flatnonzero(whole >= least)) <= set(found.tolist()) and (scores == whole[found]).all()
        early += read < int((asked[terms] & (block.impact > 0)).sum())
    assert early


def test_small_blocks(spark, docs, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(search.blocks_of, "__defaults__", (3,))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {tuple(r) for r in search.search(docs, items, k=3).collect()} == brute(rows, ITEMS, 3)
