"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of about ``PASSAGE`` bytes. A passage is described by the square roots of its
shares of byte-class bigrams and by a few measures of variety, and encoded by one tanh layer. Gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the weighted sum of encodings
goes to a logistic output. All weights are learned together from document labels by Adam.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled documents of each class, those of
lowest hash, with all their passages. Training runs in ``ROUNDS`` rounds: every task starts from the shared weights,
takes ``EPOCHS`` epochs of Adam steps on its documents, and the new weights are the mean of the tasks' weights. A bag
of more than ``BLOCK`` passages gives its gradient block by block. Only weights reach the driver. Every text is scored
whole in the same blocks, so long texts need no more memory than their encodings.

Defined cases: null and empty texts are one passage without bigrams and get the score the model gives
it; without labelled documents of both classes every score is 0.5, with a warning; documents whose labels disagree, and null labels, are
not learned from; where an id has several texts, the one of smallest hash is learned from. Only the text is an input;
repeated rows score alike, an empty table has no scores, and other columns, of any name, are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed, crc_mod, text_slices, with_text

PASSAGE = 512
PER_CLASS = 2_048
BLOCK = 1_024
HIDDEN, GATE = 32, 16
ROUNDS, EPOCHS, BATCH, STEP, DECAY = 6, 8, 64, 0.01, 1e-4
TASK_DOCUMENTS = 512
FOLDS, HELD = 3, 1
EXTRA = 4

#: byte classes: white space, line feed, digits, vowels, other lower case, upper case, the signs one by one, other ASCII, leading and continuing bytes
GROUPS = (b" \t\r\x0b\x0c", b"\n", b"0123456789", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *(bytes([c]) for c in b".,!?|*#$%&<>-:"))
CLASSES = len(GROUPS) + 3
WIDTH = CLASSES * CLASSES + EXTRA


def byte_classes() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)
    for i, group in enumerate(GROUPS):
        out[list(group)] = i
    out[0xC0:] = len(GROUPS) + 1
    out[0x80:0xC0] = len(GROUPS) + 2
    return out


def passages(text: bytes, classes: np.ndarray, first: int = 0, most: int | None = None) -> np.ndarray:
    """Features of passages ``first`` to ``first + most`` of a text: (passages, WIDTH)."""
    total = max(1, round(len(text) / PASSAGE))
    last = total if most is None else min(total, first + most)
    n = last - first
    end = len(text) if last == total else last * PASSAGE + 1
    c = classes[np.frombuffer(text[first * PASSAGE : end], np.uint8)]
    out = np.zeros((n, WIDTH), np.float32)
    if len(c) > 1:
        pair = c[:-1] * CLASSES + c[1:]
        at = np.minimum(np.arange(len(pair)) // PASSAGE, n - 1)
        hist = np.bincount(at * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1)
        size = np.maximum(hist.sum(1, keepdims=True), 1)
        share = hist / size
        out[:, :-EXTRA] = np.sqrt(share)
        out[:, -EXTRA] = (hist > 0).sum(1) / 100
        out[:, -EXTRA + 1] = share.max(1)
        out[:, -EXTRA + 2] = -(share * np.log(np.maximum(share, 1e-9))).sum(1) / 5
        out[:, -EXTRA + 3] = size[:, 0] / PASSAGE
    return out


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    return {
        "W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
        "w": draw(GATE, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32),
    }


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def encode(x: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    return np.tanh(x @ m["W"] + m["b"])


def attend(h: np.ndarray, starts: np.ndarray, m: dict[str, np.ndarray]):
    """Attention weights of the rows of each bag, and what the gradient needs of them."""
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    sizes = np.diff(np.append(starts, len(h)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    return e / np.repeat(np.add.reduceat(e, starts), sizes), t, g, sizes


def forward(h: np.ndarray, starts: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    a = attend(h, starts, m)[0]
    return _sigmoid(np.add.reduceat(a[:, None] * h, starts, axis=0) @ m["c"] + m["d"])


def gradient(x: np.ndarray, starts: np.ndarray, y: np.ndarray, m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean gradient of the log loss over the bags."""
    h = encode(x, m)
    a, t, g, sizes = attend(h, starts, m)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    dl = (_sigmoid(z @ m["c"] + m["d"]) - y) / len(y)
    dz = np.repeat(dl[:, None] * m["c"], sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dq = de[:, None] * m["w"]
    dt, dg = dq * g * (1 - t * t), dq * t * g * (1 - g)
    dh = a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T
    du = dh * (1 - h * h)
    return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def encode_text(text: bytes, classes: np.ndarray, m: dict[str, np.ndarray], block: int = BLOCK) -> np.ndarray:
    total = max(1, round(len(text) / PASSAGE))
    return np.concatenate([encode(passages(text, classes, k, block), m) for k in range(0, total, block)])


def long_gradient(text: bytes, classes: np.ndarray, y: float, m: dict[str, np.ndarray], block: int = BLOCK) -> dict[str, np.ndarray]:
    """``gradient`` of one bag, with the features of one block of passages at a time."""
    h = encode_text(text, classes, m, block)
    a, t, g, _ = attend(h, np.zeros(1, np.int64), m)
    z = a @ h
    dl = _sigmoid(z @ m["c"] + m["d"]) - y
    dz = dl * m["c"]
    de = a * (h @ dz - z @ dz)
    out = {"W": np.zeros_like(m["W"]), "b": np.zeros_like(m["b"]), "V": np.zeros_like(m["V"]), "U": np.zeros_like(m["U"]), "w": (t * g).T @ de, "c": z * dl, "d": dl}
    for k in range(0, len(h), block):
        s = slice(k, k + block)
        dq = de[s, None] * m["w"]
        dt, dg = dq * g[s] * (1 - t[s] * t[s]), dq * t[s] * g[s] * (1 - g[s])
        du = (a[s, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h[s] * h[s])
        out["W"] += passages(text, classes, k, block).T @ du
        out["b"] += du.sum(0)
        out["V"] += h[s].T @ dt
        out["U"] += h[s].T @ dg
    return out


def train(texts: list[bytes], y: np.ndarray, m: dict[str, np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """The weights after some epochs of Adam from m. Features of texts beyond BLOCK passages are made anew each time."""
    classes, rng = byte_classes(), np.random.default_rng(seed)
    short = [passages(t, classes).astype(np.float16) if len(t) < BLOCK * PASSAGE else None for t in texts]
    one, two = ({n: np.zeros_like(v) for n, v in m.items()} for _ in range(2))
    m, k = dict(m), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            bags = [i for i in pick if short[i] is not None]
            sums = {n: np.zeros_like(v) for n, v in m.items()}
            if bags:
                x = np.concatenate([short[i] for i in bags]).astype(np.float32)
                starts = np.cumsum([0, *(len(short[i]) for i in bags[:-1])])
                sums = {n: len(bags) * v for n, v in gradient(x, starts, y[bags], m).items()}
            for i in (i for i in pick if short[i] is None):
                sums = {n: sums[n] + v for n, v in long_gradient(texts[i], classes, y[i], m).items()}
            k += 1
            for n in m:
                v = (sums[n] / len(pick)).astype(np.float32) + DECAY * m[n]
                one[n] = 0.9 * one[n] + 0.1 * v
                two[n] = 0.999 * two[n] + 0.001 * v * v
                m[n] = m[n] - STEP * (one[n] / (1 - 0.9**k)) / (np.sqrt(two[n] / (1 - 0.999**k)) + 1e-8)
    return m


def score_text(text: bytes, classes: np.ndarray, m: dict[str, np.ndarray], block: int = BLOCK) -> float:
    return float(forward(encode_text(text, classes, m, block), np.zeros(1, np.int64), m)[0])


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, quality: the labelled rows learned from, at most ``per_class`` of each class, by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a document take no place
    by = (F.xxhash64("doc_id"), F.col("doc_id"))
    return known.where("quality = 0").orderBy(*by).limit(per_class).unionByName(known.where("quality = 1").orderBy(*by).limit(per_class))


def pack(m: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(m[n], np.float32).tobytes() for n in sorted(m))


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> dict[str, np.ndarray] | None:
    """The model; None if there is nothing to learn from. docs (doc_id, text), labels (doc_id, quality)."""
    spark = docs.sparkSession
    sample = F.broadcast(checkpointed(training_sample(docs, labels, per_class)))  # at most 2 * per_class rows
    rows = docs.join(sample, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").cast("long").alias("quality"))
    rows = checkpointed(rows)
    sizes = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        warnings.warn(f"quality classifier: nothing is learned, labelled documents of classes {sorted(sizes)} only", stacklevel=2)
        return None
    dealt = rows.repartition(max(1, round(sum(sizes.values()) / TASK_DOCUMENTS)), F.xxhash64("doc_id", F.lit(1))).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    dealt = checkpointed(dealt.select("text", "quality"))
    model = new_model()
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared, seed=r):
            texts, y = [], []
            for b in batches:
                texts += [x or b"" for _, some in text_slices(b.column(0)) for x in some]
                y += b.column(1).to_pylist()
            if texts:
                m = train(texts, np.array(y, np.float32), shared.value, seed=seed)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([pack(m)], pa.binary())], names=["n", "weights"])

        got = sorted((r["n"], bytes(r["weights"])) for r in dealt.mapInArrow(run, "n long, weights binary").collect())  # one row of fixed size per TASK_DOCUMENTS rows of a bounded sample
        whole = sum(n for n, _ in got)
        model = {n: sum(k / whole * part[n] for k, part in ((k, unpack(w, model)) for k, w in got)).astype(np.float32) for n in model}
        shared.unpersist()
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``score`` in (0, 1) for each row of docs."""
    types = dict(docs.dtypes)
    rows, at = with_text(docs, carry, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classes, m = byte_classes(), shared.value
        for b in batches:
            texts = (x for _, some in text_slices(b.column(at)) for x in some)
            out = [0.5 if m is None else score_text(x or b"", classes, m) for x in texts]
            n = len(carry)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.float64())], names=[*b.schema.names[:n], "score"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "score double"])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    rows = score(docs, fit(docs.select("doc_id", "text"), labels))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the classifier predicts as good, with their own columns.

    It is fitted on the labelled rows of learn_from (docs if not given): docs that went through a filter
    may hold no poor ones.
    """
    model = fit((docs if learn_from is None else learn_from).select("doc_id", "text"), labels)
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index("text")
    rows = score(renamed, model, f"c{at}", tuple(renamed.columns)).where("score >= 0.5")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
