"""Byte-level BPE encoding and decoding.

Ranked merges are folded over the byte array of each distinct word (a match of the tokenizer's pattern):
the adjacent pair of lowest rank is merged, leftmost first, until no pair has a rank. A task remembers
the ids of the chunks it has seen, so a word that is frequent is folded once a task. Decoding
concatenates the binary pieces of the ids.

The fold exists twice. ``fold_merges`` is a Spark expression: higher-order functions over pieces held as
hex digits, with ranks from one literal, an array of 65,536 small maps addressed by a hash of the piece.
``fold_word`` is the same fold in the Python workers, by a heap of pairs where a word is longer than ``SHORT``
bytes. Texts are encoded by the latter, because the expression takes over a hundred microseconds a word (see
the README); tests hold them equal.

Defined cases: null and empty texts have no ids (the hashes are those of no bytes); ids are those of a
text's UTF-8 bytes; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_slices

VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKETS = 65_536
NEVER = 2**31 - 1
CACHE = 300_000  # chunks, and words, a task remembers
LONGEST = 64  # characters of those
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank a line. It belongs to the tokenizer and is read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines) if piece}


def public_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<hex piece, rank>>, addressed by the low bits of the piece's xxhash64."""
    from xxhash import xxh64_intdigest

    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def let(value: Column, body) -> Column:
    """body(value) with value computed once (lambdas share no common subexpressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column) -> Column:
    """The ids of one word (binary), each four bytes, little end first, as one binary."""
    rank = lambda piece: F.coalesce(F.element_at(F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece), F.lit(NEVER))
    none_i, one = F.array().cast("array<int>"), F.lit(1)

    def start(digits: Column) -> Column:
        n = (F.length(digits) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: rank(F.substring(digits, 2 * i + 1, F.lit(4))))).otherwise(none_i)
        return F.struct(pieces.alias("p"), pairs.alias("r"))

    def merged(s: Column, i: Column, m: Column) -> Column:
        p, r = s["p"], s["r"]
        before = F.when(i > 1, F.concat(F.slice(r, one, i - 2), F.array(rank(F.concat(F.element_at(p, i - 1), m))))).otherwise(none_i)
        after = F.when(i + 1 < F.size(p), F.concat(F.array(rank(F.concat(m, F.element_at(p, i + 2)))), F.slice(r, i + 2, F.size(r)))).otherwise(none_i)
        return F.struct(F.concat(F.slice(p, one, i - 1), F.array(m), F.slice(p, i + 2, F.size(p))).alias("p"), F.concat(before, after).alias("r"))

    def step(s: Column, _) -> Column:
        low = F.coalesce(F.array_min(s["r"]), F.lit(NEVER))
        at = F.array_position(s["r"], F.array_min(s["r"])).cast("int")
        go = let(at, lambda i: let(F.concat(F.element_at(s["p"], i), F.element_at(s["p"], i + 1)), lambda m: merged(s, i, m)))
        return F.when(low == NEVER, s).otherwise(go)

    def little(piece: Column) -> Column:
        return let(F.lpad(F.hex(rank(piece)), 8, "0"), lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))

    def fold(digits: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest((F.length(digits) / 2).cast("int") - 1, F.lit(1)))
        return F.unhex(F.array_join(F.aggregate(steps, start(digits), step, lambda s: F.transform(s["p"], little)), ""))

    return F.when(F.length(word) > 0, let(F.hex(word), fold)).otherwise(F.lit(b""))


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word. The ranks of the adjacent pairs are kept, so a merge looks up two of them."""
    get = ranks.get
    if (whole := get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return fold_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != NEVER:
        i = pairs.index(low)
        merged = pieces[i] + pieces.pop(i + 1)
        pieces[i] = merged
        del pairs[i]
        if i:
            pairs[i - 1] = get(pieces[i - 1] + merged, NEVER)
        if i < len(pairs):
            pairs[i] = get(merged + pieces[i + 1], NEVER)
    return [ranks[p] for p in pieces]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n steps: a heap of (rank, start, end) of adjacent pairs over a linked list of pieces.

    A pair is out of date when a piece at its start no longer reaches, with its neighbour, the same end.
    """
    from heapq import heapify, heappop, heappush

    get, n = ranks.get, len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # by a piece's start: where it ends, and the start of the piece before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encoder(ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
    """A function from a text's bytes (or null) to its ids, four bytes each, little end first.

    A single space with a non-space on either side always starts a word, so the chunks between such spaces
    are encoded on their own and remembered, as are the words of those that have several; longer ones than LONGEST
    are not. A text with other white space around its spaces is encoded as a whole.
    """
    from struct import pack

    import regex

    find = regex.compile(pattern).findall
    words: dict[str, bytes] = {}
    known: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        out, found = [], find(text)
        for w in found:
            got = words.get(w)
            if got is None:
                ids = fold_word(w.encode(), ranks)
                got = pack(f"<{len(ids)}I", *ids)
                if len(found) > 1 and len(w) <= LONGEST and len(words) < cache:
                    words[w] = got
            out.append(got)
        return b"".join(out)

    def encode_text(raw: bytes | None) -> bytes:
        text = raw.decode("utf-8", "replace") if raw else ""
        first, *chunks = text.split(" ")
        last = chunks.pop() if chunks else ""
        if not last or last[0].isspace() or first[-1:].isspace():
            return encode(text)
        parts = list(map(known.get, chunks))
        if None in parts:
            for i, got in enumerate(parts):
                if got is None:
                    c = chunks[i]
                    if not c or c[0].isspace() or c[-1].isspace():
                        return encode(text)
                    parts[i] = got = encode(" " + c)
                    if len(c) <= LONGEST and len(known) < cache:
                        known[c] = got
        return b"".join([encode(first), *parts, encode(" " + last)])

    return encode_text


def _with_text(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows, dict(rows.dtypes)["doc_id"]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: tuple[dict[bytes, int], str] | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, four bytes each, little end first."""
    rows, kind = _with_text(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or public_vocabulary())

    def run(batches):
        made = encoder(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids for _, some in text_slices(b.column(1)) for ids in map(made, some)], pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_ids(ids: bytes, pieces: list[bytes]) -> bytes:
    """The text's bytes: the pieces of the ids, one after another."""
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I") if sys.byteorder == "little" else array_of(ids)))


def array_of(ids: bytes) -> list[int]:
    return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids) with ``text``, the decoded bytes."""
    pieces = encoded.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def run(batches):
        for b in batches:
            out = [decode_ids(x, pieces.value) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: tuple[dict[bytes, int], str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids and decoded bytes stay in their task."""
    rows, kind = _with_text(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or public_vocabulary())

    def run(batches):
        ranks, pattern = shared.value
        made, pieces = encoder(ranks, pattern), pieces_of(ranks)
        for b in batches:
            n, coded, decoded = [], [], []
            for _, some in text_slices(b.column(1)):
                for ids in map(made, some):
                    n.append(len(ids) // 4)
                    coded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(ids, pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
