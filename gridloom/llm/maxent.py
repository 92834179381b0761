"""Language-model scores of a hashed maximum-entropy model.

Tokens are the lower-cased words of a text and one end. The probability of a token is
P(class | history) * P(slot | class, history), times the token's share of its slot. The ``FREQUENT`` most
frequent tokens form 32 head classes of 32 slots with one token each; all others, unseen ones included,
fall in 32 rare classes by a hash of their last bytes and there in one of 32 slots by a hash of the whole
word. Both softmaxes are log-linear in hashed features of the two words before. Classes see a bias, the
previous word, the two previous words, and the word before the previous one (a skip); slots see a bias
and, together with the class, the previous word and the skip. Inside a rare slot a token has its
additively smoothed unigram share, so the model is a proper distribution over all words.

Training passes over every training text once, in ``ROUNDS`` parts. In each round every task starts from
the shared weights and takes Adagrad steps on its texts; a row of weights then becomes the mean of the
tasks' rows, weighted by how often each updated it. A task learns from about ``TASK_BYTES`` of text, however
many there are. Weights are added up block by block by a shuffle, so what reaches the driver is one model of
fixed size. Unigram counts cover all training texts exactly.

Scoring runs in sparse numpy batches. Counts of the most frequent ``HEAD`` tokens are broadcast (a
bounded table); rarer tokens are joined with their counts. Batches are cut by bytes, and a long text is
split in words a piece at a time.

Defined cases: null and empty texts are one end token; rows with the same or no id are scored one by
one; a null id hashes as the text ``null`` when texts are held out; without training texts every count is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed, crc_mod, most_frequent, partitions, pieces_of_text, text_slices

END = b""  # no word is empty
HELD_OUT = (10, 0)
ADD = 0.1
HEAD = 262_144
CLASSES, SLOTS = 32, 32
FREQUENT = CLASSES * SLOTS
OUT = 2 * CLASSES
CLASS_ROWS, WORD_ROWS = 8_192, 32_768
ROUNDS = 2
TASK_BYTES = 1 << 24
TOP_LOGIT = 80.0  # exp of it is finite in single precision
RATE = 0.25
BLOCK_ROWS = 16
STEP = 8_192
MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def rare_place(token: bytes) -> int:
    """The rare class of a token times SLOTS, plus its slot there."""
    return zlib.crc32(token[-3:]) % CLASSES * SLOTS + (zlib.crc32(token) >> 8) % SLOTS


# ------------------------------------------------------------------ counts


def _count(flush: int = 400_000):
    def run(batches):
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            rows = [pa.array(keys, pa.binary()), pa.array([rare_place(k) for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(rows, names=["token", "rare", "n"])

        for b in batches:
            for _, texts in text_slices(b.column(0)):
                for text in texts:
                    for piece in pieces_of_text(text or b""):
                        counts.update(piece.lower().split())
                    counts[END] += 1
                    if len(counts) > flush:
                        yield out()
        yield out()

    return run


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, rare, n) of all texts of docs (text): exact counts; rare is the token's rare place."""
    rows = docs.select("text").mapInArrow(_count(), "token binary, rare int, n long")
    return rows.groupBy("token", "rare").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast part of the counts: the most frequent tokens, the end first, and totals by rare place."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, by_place: dict[int, tuple[int, int]]):
        self.tokens, self.counts = tokens, counts.astype(np.float64)
        self.total = sum(n for n, _ in by_place.values())
        self.distinct = sum(v for _, v in by_place.values())
        self.rare_total, self.rare_distinct = np.zeros(FREQUENT), np.zeros(FREQUENT)
        for k, (n, v) in by_place.items():
            self.rare_total[k], self.rare_distinct[k] = n, v
        for t, n in zip(tokens[:FREQUENT], counts):  # the frequent tokens have places of their own
            k = rare_place(t)
            self.rare_total[k] -= n
            self.rare_distinct[k] -= n > 0
        known = len(tokens)
        self.places = np.array([i if i < FREQUENT else FREQUENT + rare_place(t) for i, t in enumerate(tokens)], np.int64).reshape(known)
        self.log_base = np.log10(ADD + self.counts)
        self.denominator = np.log10(self.total + ADD * (self.distinct + 1))
        self.rare_denominator = np.log10(self.rare_mass())
        self.index = {t: i for i, t in enumerate(tokens)}

    def rare_mass(self) -> np.ndarray:
        return self.rare_total + ADD * (self.rare_distinct + 1)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """(ids, places, ends, others) of all tokens: ids below len(tokens) are known ones, others are hashes
        above; a place is class * SLOTS + slot; ends holds one past each text's last token; others maps
        positions to tokens outside."""
        known, flat, ends, parts, others, done = len(self.tokens), [], [], [], {}, 0

        def close():
            nonlocal flat, done
            ids = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
            at = np.flatnonzero(ids < 0)
            places = self.places.take(ids, mode="clip")
            if len(at):
                words = [flat[i] for i in at.tolist()]
                others.update(zip((done + at).tolist(), words))
                whole, tail = (np.fromiter(map(zlib.crc32, x), np.int64, len(words)) for x in (words, [w[-3:] for w in words]))
                ids[at] = known + whole
                places[at] = FREQUENT + tail % CLASSES * SLOTS + (whole >> 8) % SLOTS
            parts.append((ids, places))
            done += len(flat)
            flat = []

        for text in texts:
            for piece in pieces_of_text(text or b""):
                if len(flat) > 1 << 19:
                    close()
                flat += piece.lower().split()
            flat.append(END)
            ends.append(done + len(flat))
        close()
        ids, places = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        return ids, places, np.array(ends, np.int64), others


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """counts (token, rare, n), checkpointed, to the part that is broadcast: at most ``head`` tokens and the end."""
    rows = most_frequent(counts, head).select("token", "n").toArrow()
    found = dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist()))
    ends = counts.where(F.length("token") == 0).agg(F.sum("n")).first()[0]
    found.pop(END, None)
    tokens = [END, *sorted(found, key=lambda t: (-found[t], t))]
    sums = counts.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    return Vocabulary(tokens, np.array([ends or 0, *(found[t] for t in tokens[1:])]), {r["rare"]: (r["n"], r["v"]) for r in sums})


# ------------------------------------------------------------------ model


def first_weights(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Biases are the logarithms of the corpus shares; everything else starts at 0. Empty slots are shut out."""
    top, words = np.zeros((CLASS_ROWS, OUT), np.float32), np.zeros((WORD_ROWS, SLOTS), np.float32)
    n = np.zeros(FREQUENT)
    used = min(FREQUENT, len(v.tokens))
    n[:used] = v.counts[:used] + ADD
    mass = np.concatenate([n, v.rare_mass()]).reshape(OUT, SLOTS)
    with np.errstate(divide="ignore", invalid="ignore"):
        top[0] = np.maximum(np.log(mass.sum(1) / mass.sum()), -60)
        words[:OUT] = np.maximum(np.nan_to_num(np.log(mass / mass.sum(1, keepdims=True)), nan=0.0), -60)
    return top, words


def features(ids: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the class weights and of the slot weights for each token, but for the biases."""
    one = np.concatenate([[-1], ids[:-1]])
    starts = np.concatenate([[0], ends[:-1]])
    one[starts] = -1
    two = np.concatenate([[-1], one[:-1]])
    two[starts] = -1
    p, q, k = (x.astype(np.uint64) for x in (one, two, places // SLOTS))

    def row(x, rows: int, first: int):
        x = (x ^ (x >> np.uint64(29))) * MIXERS[2]
        return (first + (x >> np.uint64(33)) % np.uint64(rows - first)).astype(np.int64)

    bigram, trigram, skip = p * MIXERS[0], p * MIXERS[0] + q * MIXERS[1], q * MIXERS[1] + np.uint64(7)
    top = [row(x, CLASS_ROWS, 1) for x in (bigram, trigram, skip)]
    salt = (k + np.uint64(1)) * MIXERS[2]
    return top, [row(x + salt, WORD_ROWS, OUT) for x in (bigram, skip)]


class Buffers:
    """Scratch arrays of one step, kept because large arrays are costly to take anew."""

    def __init__(self, rows: int = STEP):
        self.z, self.more = ({w: np.empty((rows, w), np.float32) for w in (OUT, SLOTS)} for _ in range(2))
        self.ones = {w: np.ones(w, np.float32) for w in (OUT, SLOTS)}

    def logits(self, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """The sum of the given rows of weights for each token, at most TOP_LOGIT."""
        n, width = len(rows[0]), weights.shape[1]
        z, more = self.z[width][:n], self.more[width][:n]
        weights.take(rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            weights.take(r, axis=0, out=more, mode="clip")
            z += more
        return np.clip(z, -TOP_LOGIT, TOP_LOGIT, out=z)

    def row_sums(self, z: np.ndarray) -> np.ndarray:
        return z @ self.ones[z.shape[1]]


def log_probabilities(ids, places, ends, v: Vocabulary, top: np.ndarray, words: np.ndarray, scratch: Buffers | None = None) -> np.ndarray:
    """log10 P of each token; for rare tokens without log10(count + 0.1), which their counts add."""
    scratch = scratch or Buffers()
    out = np.empty(len(ids))
    f, g = features(ids, places, ends)
    classes, slots = places // SLOTS, places % SLOTS
    at = np.arange(STEP)
    for lo in range(0, len(ids), STEP):
        s = slice(lo, lo + STEP)
        c, k = classes[s], slots[s]
        here = at[: len(c)]
        lp = np.zeros(len(c))
        for weights, rows, picked in ((top, [x[s] for x in f], c), (words, [c, *(x[s] for x in g)], k)):
            z = scratch.logits(weights, rows)
            if weights is top:
                z += top[0]
            lp += z[here, picked]
            lp -= np.log(scratch.row_sums(np.exp(z, out=z)))
        out[s] = lp
    out /= np.log(10)
    rare = np.flatnonzero(places >= FREQUENT)
    out[rare] -= v.rare_denominator[places[rare] - FREQUENT]
    return out


def _step(weights, squares, seen, at, total, times) -> None:
    """One Adagrad step, with a rate per row, of distinct rows."""
    sq = squares[at] + np.einsum("ij,ij->i", total, total) / total.shape[1]
    squares[at] = sq
    seen[at] += times
    total *= (RATE / np.sqrt(sq + 1))[:, None]
    weights[at] = weights.take(at, axis=0) - total


def _descend(weights, squares, seen, features, grad, often: int = 16) -> None:
    """A step from gradients of rows that may repeat; each of the features has a row for every token. With the rows
    ordered by how often they occur, the k-th occurrences of all rows are added at once; what remains of the most
    frequent rows is added row by row."""
    rows = np.concatenate(features)
    order = np.argsort(rows)
    by_row = rows[order]
    order %= len(grad)
    first = np.flatnonzero(np.append(True, by_row[1:] != by_row[:-1]))
    times = np.diff(first, append=len(rows))
    down = np.argsort(-times)
    first, times = first[down], times[down]
    total = grad.take(order[first], axis=0)
    rarer = np.searchsorted(-times, -np.arange(often + 1), "left")  # rows that occur more than k times
    for k in range(1, min(int(times[0]), often)):
        total[: rarer[k]] += grad.take(order[first[: rarer[k]] + k], axis=0)
    for i in range(rarer[often]):
        total[i] += grad.take(order[first[i] + often : first[i] + times[i]], axis=0).sum(0)
    _step(weights, squares, seen, by_row[first], total, times)


def train_step(places, f, g, top, words, sq_top, sq_words, n_top, n_words, scratch: Buffers) -> None:
    """A step of both softmaxes for at most STEP tokens; f and g are their rows of features."""
    at, classes, slots = np.arange(len(places)), places // SLOTS, places % SLOTS
    z = scratch.logits(top, f)
    z += top[0]
    np.exp(z, out=z)
    z /= scratch.row_sums(z)[:, None]
    z[at, classes] -= 1
    _descend(top, sq_top, n_top, f, z)
    _step(top, sq_top, n_top, np.zeros(1, np.int64), z.sum(0, keepdims=True), len(places))
    z = scratch.logits(words, [classes, *g])
    np.exp(z, out=z)
    z /= scratch.row_sums(z)[:, None]
    z[at, slots] -= 1
    _descend(words, sq_words, n_words, [classes, *g], z)


def _train(shared):
    """text -> changed blocks of rows (block, weighted deltas, times updated)."""

    def run(batches):
        v, top0, words0 = shared.value
        top, words, scratch = top0.copy(), words0.copy(), Buffers()
        state = [np.zeros(len(x), np.float32) for x in (top, words)] + [np.zeros(len(x)) for x in (top, words)]
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                ids, places, ends, _ = v.encode(texts)
                f, g = features(ids, places, ends)
                for lo in range(0, len(ids), STEP):
                    s = slice(lo, lo + STEP)
                    train_step(places[s], [x[s] for x in f], [x[s] for x in g], top, words, *state, scratch)
        for part, (new, old, seen) in enumerate(((top, top0, state[2]), (words, words0, state[3]))):
            rows = len(new) // BLOCK_ROWS
            used = np.flatnonzero(seen.reshape(rows, BLOCK_ROWS).any(1))
            delta = ((new - old) * seen[:, None]).astype(np.float32).reshape(rows, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used + part * CLASS_ROWS), pa.array([delta[i].tobytes() for i in used], pa.binary()),
                    pa.array([seen.reshape(rows, -1)[i].tobytes() for i in used], pa.binary()),
                ],
                names=["block", "delta", "seen"],
            )

    return run


def _add_blocks(batches):
    """Sums the rows of each block; rows come sorted by block, one block is held at a time."""
    at, delta, seen = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([delta.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["block", "delta", "seen"])

    for b in batches:
        for block, d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if block != at:
                if at is not None:
                    yield out()
                at, delta, seen = block, np.zeros(len(d) // 4), np.zeros(len(s) // 8)
            delta += np.frombuffer(d, np.float32)
            seen += np.frombuffer(s, np.float64)
    if at is not None:
        yield out()


def train(docs: DataFrame, v: Vocabulary, size: int, rounds: int = ROUNDS, task_bytes: int = TASK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The weights after one pass over docs (text, part), part being 0 to rounds - 1.

    size is the number of bytes of all texts. A task learns from about task_bytes (from less where that
    would leave cores idle, and from no less than a partition of docs).
    """
    spark = docs.sparkSession
    top, words = first_weights(v)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // (rounds * task_bytes)))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((v, top, words))
        texts = docs.where(F.col("part") == r).select("text").coalesce(tasks)
        moved = texts.mapInArrow(_train(shared), "block long, delta binary, seen binary")
        summed = moved.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_add_blocks, "block long, delta binary, seen binary")
        for row in summed.toLocalIterator():  # at most one row per block of a model of fixed size
            part, block = divmod(row["block"], CLASS_ROWS)
            seen = np.frombuffer(row["seen"], np.float64)
            delta = np.frombuffer(row["delta"], np.float64).reshape(BLOCK_ROWS, -1) / np.maximum(seen, 1)[:, None]
            target = words if part else top
            target[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS] += delta.astype(np.float32)
        shared.unpersist()
    return top, words


# ------------------------------------------------------------------ scores


def _score(shared):
    def run(batches):
        from pyspark import TaskContext

        v, top, words = shared.value
        row, scratch = TaskContext.get().partitionId() << 40, Buffers()
        known = len(v.tokens)
        for b in batches:
            for k, texts in text_slices(b.column(1)):
                ids, places, ends, others = v.encode(texts)
                lp = log_probabilities(ids, places, ends, v, top, words, scratch)
                inside = ids < known
                base = np.where(inside, v.log_base[np.minimum(ids, known - 1)], 0.0)
                lp += np.where(places >= FREQUENT, base, 0.0)
                starts = np.concatenate([[0], ends[:-1]])
                n = ends - starts
                found = inside & (v.counts[np.minimum(ids, known - 1)] > 0)
                tails: list[Counter] = [Counter() for _ in ends]
                text_of = np.searchsorted(ends, np.fromiter(others, np.int64, len(others)), "right")
                for i, w in zip(text_of.tolist(), others.values()):
                    tails[i][w] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(ends))), b.column(0).slice(k, len(ends)), pa.array(n), pa.array(np.add.reduceat(found.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(base, starts) - n * v.denominator), pa.array(np.add.reduceat(lp, starts)),
                        pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "words", "times"],
                )
                row += len(ends)

    return run


def fit(docs: DataFrame, head: int = HEAD) -> tuple[DataFrame, Vocabulary, np.ndarray, np.ndarray]:
    """(counts, vocabulary, class weights, slot weights) learned from docs (text, part)."""
    counts = checkpointed(token_counts(docs))
    v = vocabulary(counts, head)
    size = counts.agg(F.sum(F.col("n") * (F.length("token") + 1))).first()[0] or 0
    return counts, v, *train(docs, v, int(size))


def training_texts(docs: DataFrame) -> DataFrame:
    """(text, part) of the rows of docs (doc_id, text) that are not held out."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    kept = docs.where(crc_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    return kept.select("text", ((code / HELD_OUT[0]).cast("long") % ROUNDS).alias("part"))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", head: int = HEAD, model=None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is what ``fit`` returns; without one it is fitted on the rows of docs that are not held out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts, v, top, words = model or fit(training_texts(rows), head)
    shared = spark.sparkContext.broadcast((v, top, words))
    kind = dict(rows.dtypes)["doc_id"]
    scored = checkpointed(rows.mapInArrow(
        _score(shared), f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<long>"))
    tails = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("token"), F.col("w.times").alias("times"))
    joined = tails.join(counts.select("token", "n"), "token", "left")
    n = F.coalesce("n", F.lit(0))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(n + F.lit(ADD))).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.drop("words", "times").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
