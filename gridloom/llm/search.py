"""Ranked lexical search: impact-ordered, score at a time.

Every document is read once: its length and its counts of the terms that some item asks for become one row of a
forward index, a checkpointed table. Corpus counts come from it. Then each block of the index is ranked for all
items: postings of a term are sorted by their exact impact (its whole share of a score, an integer) and grouped
where impacts are equal; groups of all terms of an item are taken in descending impact, level by level, into
accumulators. What is left of each term can add its next group's impact at most. Once the sum of these bounds is below
the k-th score that is already certain, no untouched document can enter; those that still can are the candidates,
and their scores are completed from the index. Blocks leave at most k rows an item, and a tree of two ranks
merges them: of every ``SALTS``-th task, then of all.

Items are few against documents: their (item, term) pairs are broadcast, ``QUERY_PAIRS`` at a time; more take
several passes over the documents.

Defined cases: a null or empty text has no terms, so the document is no part of N and L, and the item no rows;
rows that share an item_id are one item with the terms of all; repeated documents are ranked each, equal scores by
ascending doc_id, null last; documents that score 0 have no rank; very long texts are counted whole, in pieces; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, checkpointed, text_slices

#: Characters between terms: all of ASCII but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to themselves, A-Z to a-z, the above to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
QUERY_PAIRS = 500_000  # (item, term) pairs of a pass
POSTINGS = 4_000_000  # postings of a block
SALTS = 256  # runs of tasks whose rows of an item are ranked first
TOP = 50


def item_terms(items: DataFrame, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each pair once."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), BREAKS), lambda w: w != "")
    return items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(F.array_distinct(words)).alias("term")).distinct()


def forward_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term; n counts all terms, the arrays hold those asked for."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind, shared = dict(rows.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = shared.value.get
        for b in batches:
            for k, some in text_slices(b.column(1)):
                n, ends, ids, tfs = [], [0], [], []
                for raw in some:
                    found = Counter(map(number, (raw or b"").translate(FOLD).split()))
                    n.append(found.total())
                    found.pop(None, None)
                    ids += found.keys()
                    tfs += found.values()
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(some)), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>").where("n > 0")


class Block:
    """Postings of some documents: by document, and by term in descending impact, grouped where impacts are equal."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int):
        m = 100 - 50 + (50 * n * documents) // total
        owner = np.repeat(np.arange(len(n)), sizes)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
        self.size, self.starts = len(n), np.append(0, np.cumsum(sizes))
        self.terms, self.impact = terms, impact
        some = np.flatnonzero(impact)
        order = some[np.lexsort((-impact[some], terms[some]))]
        self.docs, t, i = owner[order], terms[order], impact[order]
        new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]))) if len(order) else np.zeros(0, np.int64)
        self.group_impact, self.group_start = i[new], np.append(new, len(order))
        self.term_groups = np.searchsorted(t[new], np.arange(len(weights) + 1))

    def complete(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The whole scores of documents; asked tells an item's terms."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - self.starts[docs], sizes)
        running = np.append(0, np.cumsum(np.where(asked[self.terms[at]], self.impact[at], 0)))
        ends = np.cumsum(sizes)
        return running[ends] - running[ends - sizes]

    def best(self, terms: np.ndarray, asked: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): all documents that can be among the k best and reach floor."""
        at, end = self.term_groups[terms], self.term_groups[terms + 1]
        gain, read = np.zeros(self.size, np.int64), 0
        while True:
            left = np.where(at < end, self.group_impact[np.minimum(at, len(self.group_impact) - 1)], 0) if len(self.group_impact) else np.zeros(len(at), np.int64)
            bound, level = int(left.sum()), int(left.max(initial=0))
            if self.size >= k:
                floor = max(floor, int(np.partition(gain, self.size - k)[self.size - k]))
            if bound < max(floor, 1):
                found = np.flatnonzero(gain + bound >= max(floor, 1))
                if not bound:
                    return found, gain[found], read
                if len(found) <= 16 * k:
                    return found, self.complete(found, asked), read
            for j in np.flatnonzero(4 * left >= 3 * level).tolist():  # the next level: whole groups from three quarters of the highest impact on
                own = self.group_impact[at[j] : end[j]]
                stop = at[j] + int(np.searchsorted(-own, -(3 * level / 4), "right"))
                a, b = self.group_start[at[j]], self.group_start[stop]
                gain[self.docs[a:b]] += np.repeat(self.group_impact[at[j] : stop], np.diff(self.group_start[at[j] : stop + 1]))
                at[j], read = stop, read + int(b - a)


def blocks_of(batch, most: int = POSTINGS):
    """A batch of the index in runs of rows with about ``most`` postings: (first row, n, sizes, terms, tfs)."""
    column = batch.column(2)
    ends = np.asarray(column.offsets)
    n, terms, tfs = batch.column(1).to_numpy(), np.asarray(column.values), np.asarray(batch.column(3).values)
    k = 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
        stop = min(stop, len(n))
        a, b = ends[k], ends[stop]
        yield k, n[k:stop], np.diff(ends[k : stop + 1]).astype(np.int64), terms[a:b].astype(np.int64), tfs[a:b].astype(np.int64)
        k = stop


def ranked(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item int, doc_id, score) from every block: the k best of each item (by its number), or more where a task's
    later blocks improve on earlier ones."""
    kind = dict(index.dtypes)["doc_id"]
    shared = index.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches):
        items, w = shared.value
        tops = [np.zeros(0, np.int64)] * len(items)
        flags = np.zeros(len(w), bool)
        for batch in batches:
            for first, n, sizes, terms, tfs in blocks_of(batch):
                block = Block(n, sizes, terms, tfs, w, documents, total)
                ids = batch.column(0).slice(first, len(n))
                place = np.empty(len(n), np.int64)
                place[pc.sort_indices(ids).to_numpy()] = np.arange(len(n))
                numbers, rows, scores = [], [], []
                for item, own in enumerate(items):
                    flags[own] = True
                    top = tops[item]
                    docs, got, _ = block.best(own, flags, k, int(top[k - 1]) if len(top) >= k else 0)
                    flags[own] = False
                    order = np.lexsort((place[docs], -got))[:k]
                    order = order[got[order] > 0]
                    rows.append(docs[order])
                    scores.append(got[order])
                    numbers.append(np.full(len(order), item, np.int32))
                    tops[item] = -np.sort(-np.concatenate([top, got[order]]))[:k]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", pairs: int = QUERY_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    wanted = checkpointed(item_terms(items, item_col, item_text))
    passes = max(1, math.ceil(wanted.count() / pairs))
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    out = None
    for p in range(passes):
        found = _search(docs, wanted.where(part == p), k, id_col, text)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    listed = wanted.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()  # at most ``pairs`` terms in all
    terms = {t: i for i, t in enumerate(sorted({t for r in listed for t in r["terms"]}))}
    asked = [np.array(sorted(terms[t] for t in r["terms"]), np.int64) for r in listed]
    index = checkpointed(forward_index(docs, {t.encode(): i for t, i in terms.items()}, id_col, text))
    documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = {r[0]: r[1] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # one row a term asked for
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holders.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    tops = ranked(index, asked, weights, documents, total, k)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    tops = tops.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= k)
    tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(listed)], f"item int, item_id {dict(wanted.dtypes)['item_id']}")
    return tops.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
