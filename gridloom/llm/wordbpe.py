"""BPE with word ends: encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of each new word. A proposal is what the ranked merges give exactly if
each token is its own encoding and no two neighbours would have merged across their border, so one numpy pass
tests every adjacent pair of all new words of a batch: it takes back the later of the two tokens' last merges, again
and again, and looks for a rule across the border that would have come before. Only words with a failing pair
are merged exactly. That each token has one rule, whose parts come from earlier rules, is checked when the
vocabulary is read.

A text is cut at ASCII white space. Tokens never hold white space and the normaliser does not look past it, so
the chunks are encoded alone and remembered, up to ``CACHE`` of them. Chunks of Latin letters are lower-cased and split here, all
others by the tokenizer's own normaliser and splitter. A special token's string inside a text is that token, as the
tokenizers library has it.

Defined cases: null and empty texts, and those of white space only, have no ids (the hashes are those of no
bytes); a text without white space is one chunk, whose long words are merged by a heap; repeated rows are encoded
alike, null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_slices

VOCABULARY = "word_bpe_49k.json"
CACHE = 500_000  # chunks, and words, a task remembers
SHORT = 64
NEVER = 2**31 - 1
END = "</w>"
#: Up to this letter no composition applies, and letters and digits are the same in all versions of Unicode.
LATIN = "\u024f"
#: The splitter's pattern on lower-cased ASCII bytes.
ASCII_WORDS = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


def public_tokenizer() -> str:
    """The tokenizer's JSON, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, all
    other bytes, in order, for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens by their bytes, the rule that makes each, and the ranks of pairs."""

    def __init__(self, source: str):
        read = json.loads(source)
        model, letters = read["model"], byte_letters()
        if model.get("end_of_word_suffix") != END or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary with word ends and without unknown tokens is expected")
        self.source = source
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        names: dict[str, int] = model["vocab"]
        self.n = max(names.values(), default=-1) + 1
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.names = [""] * (max([self.n - 1, *self.special.values()]) + 1)
        for name, i in (names | self.special).items():
            self.names[i] = name
        self.left, self.right, self.rank = (np.full(self.n, -1, np.int64) for _ in range(3))
        self.made_by = [names[a + b] for a, b in rules]
        for r, (a, b) in enumerate(rules):
            a, b, made = names[a], names[b], names[a + b]
            if self.rank[made] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError(f"rule {r} makes a token again, or from a later one")
            self.left[made], self.right[made], self.rank[made] = a, b, r
        keys = self.left[self.made_by] * self.n + self.right[self.made_by]
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order
        self.pairs = dict(zip(keys.tolist(), range(len(rules)), strict=True))
        self.first = [names.get(c, -1) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.last = [names.get(c + END, -1) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        if min(self.first + self.last) < 0:
            raise ValueError("some bytes have no token")
        self.inner, self.final = {}, {}
        for name, i in names.items():
            ends = name.endswith(END) and len(name) > len(END)
            raw = bytes(letters[c] for c in (name[: -len(END)] if ends else name))
            if self.merged(raw, ends) == [i]:  # greedy proposals use only tokens that are their own encoding
                (self.final if ends else self.inner)[raw] = i
        self.longest = max(map(len, self.final))
        self.root: dict = {}  # the inner tokens by their bytes, one level a byte; at "id" the token that ends there
        for raw, i in self.inner.items():
            node = self.root
            for byte in raw:
                node = node.setdefault(byte, {})
            node["id"] = i

    def merged(self, word: bytes, ends: bool = True) -> list[int]:
        """The ids of a word by exact merging: the lowest rank first, leftmost of equal ones."""
        ids = [self.first[b] for b in word]
        if ends:
            ids[-1] = self.last[word[-1]]
        return self._merged_short(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get, n, made = self.pairs.get, self.n, self.made_by
        ranks = [get(a * n + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * n + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] * n + ids[i + 1], NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of (rank, place) over a linked list; an entry whose pair has changed is passed over."""
        get, n, size = self.pairs.get, self.n, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size))
        heap = [(r, i) for i in range(size - 1) if (r := get(ids[i] * n + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= size or get(ids[i] * n + ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.made_by[r], -1, after[j]
            before[after[j]] = i
            if after[i] < size and (r := get(ids[i] * n + ids[after[i]])) is not None:
                heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] * n + ids[i])) is not None:
                heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match. The last byte belongs to a token that ends a word, all others do not."""
        final, root, last, at, out = self.final.get, self.root, len(word) - 1, 0, []
        while True:
            if last - at < self.longest and (got := final(word[at:])) is not None:
                out.append(got)
                return out
            node, i = root, at
            while i < last and (node := node.get(word[i])) is not None:
                i += 1
                if "id" in node:
                    got, at = node["id"], i
            out.append(got)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of neighbours stay apart: no rule joins a right part of a with a left part of b while both exist.

        Rules apply in the order of rank, then from left to right. So of two tokens the one of the later rank was made
        last (of one rank the right one), and taking back these merges in turn meets every two parts that stood
        side by side, with the rank up to which they did.
        """
        good = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NEVER, np.int64)
        while len(at):
            key = a * self.n + b
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joins = (self.keys[found] == key) & (self.key_ranks[found] < limit)
            good[at[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, four bytes each: speculate, verify all adjacent pairs at once, merge exactly what fails."""
        made = list(map(self.proposed, words))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(made)), sizes)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[border] * self.n + flat[border + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)[back]
        packed, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.unique(owner[border[~good]]).tolist():
            ids = self.merged(words[k])
            out[k] = pack(f"<{len(ids)}i", *ids)
        return out


class Encoder:
    """Encodes texts, batch by batch, and remembers chunks and words."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary, self.cache = vocabulary, cache
        library = Tokenizer.from_str(vocabulary.source)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        self.ascii = re.compile(ASCII_WORDS)
        self.latin = regex.compile(next(p["pattern"]["Regex"] for p in json.loads(vocabulary.source)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.marks = {s.encode()[:2] for s in vocabulary.special}
        self.words: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def parts(self, chunk: bytes) -> list[bytes]:
        """The words of a chunk. A special token comes as its string, which is no word."""
        for m in self.marks:
            if m in chunk:
                out = []
                for k, part in enumerate(self.specials.split(chunk.decode("utf-8", "replace"))):
                    out += [b" " + part.encode()] if k % 2 else self.plain(part.encode())
                return out
        return self.plain(chunk)

    def plain(self, chunk: bytes) -> list[bytes]:
        if chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else self.ascii.findall(chunk.lower())
        text = chunk.decode("utf-8", "replace")
        if max(text) <= LATIN:
            return [w.encode() for w in self.latin.findall(text.lower())]
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in self.split(self.normal(text))]

    def learn(self, chunks: list[bytes]) -> None:
        parted = list(map(self.parts, chunks))
        words, known = self.words, self.known
        new = [w for w in set(chain.from_iterable(parted)) if w not in words]
        words.update(zip(new, self.vocabulary.encode_words(new), strict=True))
        for c, ws in zip(chunks, parted, strict=True):
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, four bytes each, little end first."""
        for held in (self.known, self.words):
            if len(held) > self.cache:
                held.clear()
        for name, i in self.vocabulary.special.items():
            self.words[b" " + name.encode()] = pack("<i", i)
        cut = [(t or b"").split() for t in texts]
        if new := set(chain.from_iterable(cut)).difference(self.known):
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


def _with_text(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows, dict(rows.dtypes)["doc_id"]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text. tokenizer: the JSON of a vocabulary with word ends."""
    rows, kind = _with_text(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer or public_tokenizer()))

    def run(batches):
        made = Encoder(shared.value)
        for b in batches:
            for k, some in text_slices(b.column(1)):
                ids = made.encode(some)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(some)), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids) with ``text``: the tokens' names joined by spaces, as a tokenizer without a decoder gives them."""
    names = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer or public_tokenizer()).names)

    def run(batches):
        for b in batches:
            out = [" ".join(map(names.value.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids and decoded texts stay in their task."""
    rows, kind = _with_text(docs, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer or public_tokenizer()))

    def run(batches):
        made = Encoder(shared.value)
        names = [n.encode() for n in shared.value.names]
        digits = [str(i).encode() for i in range(len(names))]
        for b in batches:
            n, coded, decoded = [], [], []
            for _, some in text_slices(b.column(1)):
                for raw in made.encode(some):
                    ids = np.frombuffer(raw, "<i4").tolist()
                    n.append(len(ids))
                    coded.append(hashlib.sha256(b" ".join(map(digits.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
