"""Each operator against a brute-force version, and its defined cases on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, jaccard, lattice, licenses, maxent, mil, mixing, quality, shards, simhash, urlfilter
from gridloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)
WORDS = ["the", "of", "and", "Oser", "blehe", "ande", "thst", "tion", "ers", "ing", "über", "naïve", "x", "rent", "mor", "ka"]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sentence(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(0, 40)) if rng.random() < 0.5 else "") for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space."""
    base = sentence(300, 1)
    out = [
        (1, base, "en", "a", 5), (2, base, None, "b", None), (3, base + " end", "en", None, 1), (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "   \n\t ", None, None, None),
        (7, "one", "en", "a", 3), (7, "one", "en", "a", 3), (None, sentence(80, 2), "en", "c", 1), (None, None, None, None, None), (8, sentence(60, 3) + "\n" + sentence(60, 3), "en", "c", 1),
        (9, sentence(20_000, 4), "en", "a", 1), (10, "a  b\u00a0c \n d\r\n  e'll don't \u2028 ok  ", "en", "b", 1), (11, "Ärger €5 日本語 😀 naïve", "de", "b", 1), (12, sentence(90, 5).upper(), "en", "c", 1),
    ]
    return out + [(20 + i, sentence(60 + i, 100 + i), "en", "abc"[i % 3], 1) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """docs with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("fp", "group", "size", "rank", "score", "key", "failures", "n_words", "ids", "row", "copies", "copy", "__n", "__id", "__hash", "__text", "__source", "__carry0", "n", "id", "hash", "c1", "u", "v", "n.m", "edge")})


# ------------------------------------------------------------------ SimHash


def brute_fingerprint(text, width):
    import xxhash

    words = [w.lower() for w in words_of(text)]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints_and_components(docs, rows):
    got = simhash.near_duplicates(clashing(docs)).collect()
    fps = [brute_fingerprint(r[1], 4) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fps))
    near = [[(a ^ b).bit_count() <= 4 for b in fps] for a in fps]
    label = list(range(len(fps)))
    for _ in fps:
        label = [min(label[j] for j in range(len(fps)) if near[i][j]) for i in range(len(fps))]
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(label[i], []).append(r[0])
    low = {k: min([x for x in v if x is not None], default=None) for k, v in want.items()}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((rows[i][0], low[label[i]]) for i in range(len(rows)))


def planted(n_groups, size, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_groups):
        centre = int(rng.integers(0, 2**63))
        for _ in range(size):
            x = centre
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64).view(np.int64))


@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_covering_loses_no_link(spark, cell):
    fps = np.concatenate([planted(40, 4, 1), planted(1, 60, 2)])
    links = simhash.link(spark.createDataFrame([(int(f),) for f in fps], "fp long"), cell=cell)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    bits = fps.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(40):
        label = np.where(near, label[None, :], len(fps)).min(1)
    for k in set(label):
        group = [int(f) for f in fps[label == k]]
        assert len({got.get(f, f) for f in group}) == 1 and (len(group) == 1) == (group[0] not in got)


def test_every_pair_within_the_threshold_shares_a_cell():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 300).astype(np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(63, 4, replace=False):
            y[i] ^= 1 << int(b)
    cx, hx, rx = simhash.cover(x)
    cy, _, ry = simhash.cover(y)
    homes = {(int(c), int(r)) for c, h, r in zip(cx, hx, rx) if h}
    reached = {(int(c), int(r)) for c, r in zip(cy, ry)}
    assert {r for _, r in homes & reached} == set(range(300))


def test_dense_cells_give_a_forest():
    fp = planted(1, 80, 7)
    links = simhash.spanning_links(fp, np.ones(len(fp), bool))
    assert len(links) < len(fp)


def test_one_of_each_group_stays(docs, empty):
    kept = simhash.keep_one(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(7) == 1 and 1 in ids and 2 not in ids and simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    other = simhash.keep_one(clashing(docs))
    assert other.columns == clashing(docs).columns and sorted(map(str, (r["doc_id"] for r in other.collect()))) == sorted(map(str, ids))


def brute_groups(texts, width, similarity):
    """The smallest place of each text's group, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_similar_texts_share_a_group(spark):
    texts = [sentence(150, 900 + i) for i in range(30)]
    for i in range(30):  # 1 to 4 changed words out of 150: similarities from 0.76 to 0.93
        words = texts[i].split()
        for k in range(1 + i % 4):
            words[10 + 30 * k] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(texts[0].split()[: 150 - 12 * k]) for k in range(1, 6)] + ["one two", "One  two", "", None]  # a chain whose ends are far apart
    want = brute_groups(texts, 5, 0.8)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert 5 < len(texts) - len(set(want)) < 40
    assert sorted(r["doc_id"] for r in simhash.keep_one(rows).collect()) == sorted(set(want))


@pytest.mark.parametrize("block", [jaccard.BLOCK, 1_500])
def test_a_large_group_of_near_copies_is_one_group(spark, block):
    rng = np.random.default_rng(33)
    base, texts = sentence(120, 4_000).split(), []
    for i in range(150):  # three of twelve blocks changed: pairs lie on both sides of 0.8
        words = list(base)
        for at in rng.choice(12, 2, replace=False):
            words[at * 10 + 5] = f"other{rng.integers(0, 3)}"
        texts.append(" ".join(words))
    texts += [sentence(120, 5_000 + i) for i in range(20)]
    want = brute_groups(texts, 5, 0.8)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = jaccard.groups(rows, "doc_id", "text", 5, 0.8, block).groupBy("group").agg(F.min("doc_id").alias("least"))
    assert sorted(r["least"] for r in found.collect()) == sorted(set(want)) and len(set(want)) < 40


def test_a_forest_connects_home_rows_as_all_pairs_do():
    rng = np.random.default_rng(8)
    for trial in range(40):
        sets = [np.sort(rng.choice(14, rng.integers(1, 14), replace=False)) for _ in range(30)]
        role = rng.choice(3, 30, p=[0.4, 0.2, 0.4])
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])

        def labels(pairs):
            group = np.where(role == 1, 100, np.arange(30))
            for a, b in pairs:
                group[group == group[a]] = group[b]
            return [list(group).index(g) for g in group]

        alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))
        want = [(a, b) for a in range(30) for b in range(a) if (role[a] == 0 or role[b] == 0) and alike(a, b)]
        got = jaccard.forest(role, np.concatenate(sets), ends, 0.6, chunk=3).tolist()
        assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want} and labels(got) == labels(want)


# ------------------------------------------------------------------ license scans


def test_license_scan(spark, empty):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "This work is\nlicensed under the GNU General  Public License!", "Licensed under CC BY-NC 4.0. And the MIT-License", None, "", "gnu general public", "mit licenses",
        "Permission is hereby granted, free of charge, to any person getting a copy of this software and its documentation files", "cc by cc by", "the license version 2.0 under",
        "...MIT", " mit license", "CC BY", "A\u212aache license", "x gnu general public license y gnu general public license",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(8, "cc by cc by"), (None, "mit license")], "doc_id long, text string")
    scanned = licenses.scan(clashing_license(rows)).collect()
    got = {r["doc_id"]: r for r in scanned}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (8, 1, 3, "apache", 1.0)
    assert got[1]["base_labels"] == "gpl" and got[1]["first_word"] == 6
    assert got[2]["base_labels"] == "cc-by,mit" and got[2]["labels"] == "cc-by,cc-by-nc,mit"
    for i in (3, 4, 5, 6, 9, 10, 13):
        assert (got[i]["n_base"], got[i]["labels"], got[i]["first_word"], got[i]["score"]) == (0, "", None, 0)
    assert got[3]["n_words"] == 0 and got[7]["labels"] == "mit" and got[7]["base_labels"] == "" and 0.75 <= got[7]["score"] < 1
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (2, 0, 2)
    assert [got[i]["n_words"] for i in (10, 11, 12, 13, 14)] == [1, 2, 2, 2, 10]
    assert (got[14]["n_base"], got[14]["first_word"], got[14]["last_word"]) == (2, 1, 6) and got[11]["first_word"] == 0
    assert len(scanned) == 17 and licenses.scan(empty).count() == 0


def clashing_license(rows):
    from pyspark.sql import functions as F

    return rows.withColumns({c: F.lit(1) for c in ("key", "label", "words", "word", "line", "n", "row", "pairs", "m", "n_words", "found")})


def brute_blocks(text):
    """template -> {(at, stop, overlap)} of the maximal blocks, by trying every window."""
    ws, out = licenses.words_of(text), {}
    places = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    for i, label, pairs, need, block in licenses.template_sets(licenses.TEMPLATES):
        found, own = [], set(pairs)
        for at in range(len(places)):
            firsts = {}
            for j in range(at, min(at + block - 1, len(places))):
                if places[j] in own:
                    firsts.setdefault(places[j], j)
            if len(firsts) >= need and places[at] in own:
                last = max(firsts.values())
                if places[at] not in places[at + 1 : last + 1]:
                    found.append((at, last + 2, len(firsts)))
        best = {x for x in found if not any(y[2] > x[2] and y[0] < x[1] and x[0] < y[1] for y in found)}
        if best:
            out[i] = best
    return out


def altered(text, rng, share):
    ws = licenses.words_of(text)
    for i in rng.choice(len(ws), int(share * len(ws)), replace=False):
        ws[i] = "other"
    return " ".join(ws)


def test_similarity_join_against_all_windows(spark):
    rng = np.random.default_rng(21)
    lines = [" ".join(rng.choice(["of", "the", "to", "in", "copy", "software", "license", "x"], 80)) for _ in range(10)]
    for _, t in licenses.TEMPLATES:
        lines += ["some words before " + altered(t, rng, share) + " and after of the software" for share in (0, 0.05, 0.1, 0.2)]
        lines += [altered(t, rng, 0.02) + " x" * 9 + " " + altered(t, rng, 0.05) + " x" * 400 + " " + t]
    rows = licenses.known_pairs(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string"), licenses.vocabulary(licenses.TEMPLATES))
    ids = {r["row"]: r["doc_id"] for r in rows.collect()}
    got = {(ids[r["row"]], r["template"], r["at"], r["stop"], r["overlap"]) for r in licenses.similar_blocks(rows).collect()}
    want = {(i, k, *b) for i, line in enumerate(lines) for k, bs in brute_blocks(line).items() for b in bs}
    assert got == want and len({x[:2] for x in want}) > 40 and any(len(bs) > 1 for line in lines for bs in brute_blocks(line).values())


def test_a_second_notice_keeps_its_label(spark):
    rng = np.random.default_rng(4)
    texts = dict(licenses.TEMPLATES)
    lgpl, gap = altered(texts["lgpl"], rng, 0.03), " plain words" * 150
    rows = [(0, texts["agpl"] + gap + " " + lgpl), (1, lgpl + gap + " " + texts["agpl"]), (2, texts["agpl"] + " end of it. " + lgpl), (3, lgpl + " end of it. " + texts["agpl"]), (4, texts["agpl"]), (5, lgpl)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({"agpl", "lgpl"} <= got[i] for i in range(4)) and "lgpl" not in got[4] and "agpl" not in got[5] and "lgpl" in got[5]


def test_a_phrase_that_fills_a_text(spark):
    import time

    rows = spark.createDataFrame([(1, "gnu general public license " * 8_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = licenses.scan(rows).first()
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (8_000, 0, 4 * 7_999, "gpl")
    assert time.perf_counter() - began < 30


def test_notices_are_found_whatever_their_lines(spark):
    import textwrap

    rows, want = [], []
    for i, (label, notice) in enumerate(licenses.TEMPLATES):
        for width in (20, 40, 72):
            before = "plain words stand here " * (i + width % 7)
            wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(notice, width))
            rows.append((len(rows), f"{before}\n{wrapped}\nand some more words after it"))
            want.append(label)
    notice = dict(licenses.TEMPLATES)["bsd"].split()
    reversed_ = " ".join(notice[::-1])
    scattered = " ".join(w + " x" * 9 for w in notice)
    filled = " ".join(f"{w} filler" for w in dict(licenses.TEMPLATES[:2])["apache"].split())
    rows += [(997, reversed_), (998, scattered), (999, filled)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1 for i, label in enumerate(want))
    assert all((got[i]["labels"], got[i]["score"]) == ("", 0) for i in (997, 998, 999))
    sisters = {i: set(got[i]["labels"].split(",")) for i in range(len(want)) if want[i] in ("lgpl", "agpl", "cc-by-nc", "cc-by-sa")}
    assert all("gpl" not in s and not {"lgpl", "agpl"} <= s and not {"cc-by-nc", "cc-by-sa"} <= s for s in sisters.values())


# ------------------------------------------------------------------ language model


def test_unigram_scores_and_model(docs, rows, empty):
    got = maxent.score(clashing(docs), head=20).collect()
    tokens = lambda t: [w.lower() for w in words_of(t)] + [b""]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(k := tokens(r[1])), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k), 4)) for r in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(r["score"] < 0 for r in got)
    assert maxent.score(empty).count() == 0


def test_model_is_a_distribution(docs):
    counts = maxent.checkpointed(maxent.token_counts(docs))
    v = maxent.vocabulary(counts, 40)
    top, words = maxent.first_weights(v)
    top[1:] += RNG.normal(size=top[1:].shape).astype(np.float32) / 3
    text = b"the of and"
    every = [r["token"] for r in counts.select("token").collect()]
    known = {bytes(r["token"]): r["n"] for r in counts.collect()}
    total = 0.0
    for w in every:
        if w == b"":
            continue
        ids, places, ends, _ = v.encode([text + b" " + bytes(w)])
        lp = maxent.log_probabilities(ids, places, ends, v, top, words)[-2]
        total += 10 ** (lp + (math.log10(known[bytes(w)] + maxent.ADD) if places[-2] >= maxent.FREQUENT else 0))
    ids, places, ends, _ = v.encode([text])
    total += 10 ** maxent.log_probabilities(ids, places, ends, v, top, words)[-1]
    # unseen words have a share of 0.1 counts in each rare slot, and random weights move whole slots
    assert 0.7 < total <= 1 + 1e-6


def brute_log10(text, counts, v, top, words):
    """log10 P of a text, word by word, from the weights and the exact counts."""
    mix = [int(m) for m in maxent.MIXERS]

    def row(x, rows, first):
        x %= 1 << 64
        x = (x ^ x >> 29) * mix[2] % (1 << 64)
        return first + (x >> 33) % (rows - first)

    def soft(z, i):
        z = [float(x) for x in z]
        return z[i] - math.log(sum(math.exp(x) for x in z))

    place = {t: i for i, t in enumerate(v.tokens)}
    shares = Counter()
    distinct = Counter()
    for t, n in counts.items():
        if place.get(t, maxent.FREQUENT) >= maxent.FREQUENT:
            shares[maxent.rare_place(t)] += n
            distinct[maxent.rare_place(t)] += 1
    total, before = 0.0, [-1, -1]
    for w in [*(x.lower() for x in words_of(text)), b""]:
        i = place.get(w, len(v.tokens) + zlib.crc32(w))
        code = i if i < maxent.FREQUENT else maxent.FREQUENT + maxent.rare_place(w)
        k, slot = divmod(code, maxent.SLOTS)
        one, two = (x % (1 << 64) for x in before)
        bi, tri, skip = one * mix[0], one * mix[0] + two * mix[1], two * mix[1] + 7
        z = top[0].astype(float) + sum(top[row(x, maxent.CLASS_ROWS, 1)].astype(float) for x in (bi, tri, skip))
        total += soft(z, k)
        salt = (k + 1) * mix[2]
        z = words[k].astype(float) + sum(words[row(x + salt, maxent.WORD_ROWS, maxent.OUT)].astype(float) for x in (bi, skip))
        total += soft(z, slot)
        if code >= maxent.FREQUENT:
            r = code - maxent.FREQUENT
            total += math.log((counts.get(w, 0) + 0.1) / (shares[r] + 0.1 * (distinct[r] + 1)))
        before = [i, before[0]]
    return total / math.log(10)


def test_scores_by_brute_force(spark, docs, rows):
    model = maxent.fit(maxent.training_texts(docs.select("doc_id", "text")), 1_100)
    got = maxent.score(docs, model=model).collect()
    _, v, top, words = model
    counts = Counter(w for r in rows if zlib.crc32(("null" if r[0] is None else str(r[0])).encode()) % 10 for w in [*(x.lower() for x in words_of(r[1])), b""])
    assert (top[1:] != 0).any() and (words[maxent.OUT :] != 0).any()
    want = sorted((str(r[0]), brute_log10(r[1], counts, v, top, words)) for r in rows)
    have = sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want] and [x for _, x in have] == pytest.approx([x for _, x in want], rel=1e-4)


def test_long_texts_are_cut_at_white_space():
    from gridloom.llm.common import pieces_of_text, text_slices
    import pyarrow as pa

    text = b"  ".join(b"w%d" % i for i in range(5_000)) + b"x" * 3_000 + b" end"
    parts = list(pieces_of_text(text, 1_000))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split() and len(parts) > 20
    column = pa.array([None, "", "a" * 50, "b" * 500, "c", None], pa.string()).slice(1)
    got = list(text_slices(column, 2, 100))
    assert [x for _, some in got for x in some] == [b"", b"a" * 50, b"b" * 500, b"c", None] and [k for k, _ in got] == [0, 2, 3]
    v = maxent.Vocabulary([b"", b"w1"], np.array([1, 1]), {0: (2, 2)})
    whole, cut = v.encode([text * 200]), v.encode([text])
    assert len(whole[0]) == 200 * (len(cut[0]) - 1) + 1 - 199 and max(whole[3]) == len(whole[0]) - 2


def test_model_learns_from_the_two_words_before_and_skips():
    rng = np.random.default_rng(8)
    # "same" follows two equal words and "other" two different ones; "left" and "right" repeat the word two places before
    texts = []
    for _ in range(3_000):
        a, b = rng.integers(0, 2, 2)
        texts.append(f"{'pq'[a]} {'pq'[b]} {'same' if a == b else 'other'}".encode())
    for _ in range(3_000):
        texts.append(f"{('left', 'right')[c := int(rng.integers(0, 2))]} mid {('left', 'right')[c]}".encode())
    n = Counter(w for t in texts for w in [*t.split(), b""])
    # "same" and "other" stand in classes of their own, "left" and "right" share one
    spread = [b"", *(b"f%d" % i for i in range(maxent.FREQUENT - 1))]
    for place, w in enumerate((b"p", b"q", b"mid", b"left", b"right", b"same")):
        spread[1 + place] = w
    spread[maxent.SLOTS + 1] = b"other"
    v = maxent.Vocabulary(spread, np.array([n.get(w, 1) for w in spread]), {k: (20_000, 1_000) for k in range(maxent.FREQUENT)})
    top, words = maxent.first_weights(v)
    state, scratch = [np.zeros(len(x), np.float32) for x in (top, words)] + [np.zeros(len(x)) for x in (top, words)], maxent.Buffers()
    for k in range(0, len(texts) * 3, 200):
        ids, places, ends, _ = v.encode([texts[i] for i in rng.integers(0, len(texts), 200)])
        f, g = maxent.features(ids, places, ends)
        assert len(f) == 3 and len(g) == 2
        maxent.train_step(places, f, g, top, words, *state, scratch)
    def p(text):
        ids, places, ends, _ = v.encode([text])
        return 10 ** maxent.log_probabilities(ids, places, ends, v, top, words)[2]
    assert min(p(b"p p same"), p(b"q q same"), p(b"p q other"), p(b"q p other")) > 0.8  # needs both words together
    assert min(p(b"left mid left"), p(b"right mid right")) > 0.8  # needs the skip inside the class


# ------------------------------------------------------------------ training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1_000])
def test_permutations(n):
    a = shards.permute(np.arange(n), n)
    assert sorted(a.tolist()) == list(range(n)) and (n < 17 or (a != shards.permute(np.arange(n), n, key=9)).any())


def test_shards_hold_every_token_once(spark, docs, empty, tmp_path):
    path, length, per = str(tmp_path / "s"), 64, 50
    frame = clashing(docs.coalesce(2))
    got = shards.training_order(frame, path, length=length, per_shard=per).collect()
    ranks, pattern = shards.public_vocabulary()
    import tiktoken

    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter(i for r in docs.collect() for i in [*encode(r["text"] or ""), len(ranks)])
    read = shards.read_slots(spark, path, 0, length=length, per_shard=per).collect()
    have = Counter(i for r in read for i in np.frombuffer(r["ids"], "<u2").tolist())
    assert all(have[i] == n for i, n in want.items() if i != len(ranks)) and have[len(ranks)] >= want[len(ranks)]
    assert sorted(r["slot"] for r in read) == list(range(len(got))) and sum(r["n_tokens"] for r in got) == sum(want.values())
    assert {r["slot"]: hashlib.sha256(r["ids"]).hexdigest() for r in read} == {r["slot"]: r["ids_sha256"] for r in got}
    later = shards.read_slots(spark, path, 70, length=length, per_shard=per).collect()
    assert sorted(r["slot"] for r in later) == list(range(70, len(got)))
    sizes = {r["shard"]: len(r["content"]) for r in shards.shard_files(spark, path).collect()}
    assert all(s % (2 * length + 1) == 0 for s in sizes.values())
    assert shards.training_order(empty, str(tmp_path / "e")).count() == 0


def test_shards_are_numbered_by_their_files_alone(spark, docs, tmp_path):
    frame, length, per = docs.select("doc_id", "text"), 64, 8
    key = lambda rows: sorted((r["slot"], r["shard"], r["ids_sha256"]) for r in rows)
    plain = shards.training_order(frame, str(tmp_path / "plain"), length=length, per_shard=per).collect()
    path = tmp_path / "part-2" / "x"
    assert key(plain) == key(shards.training_order(frame, str(path), length=length, per_shard=per).collect())
    next(f for f in path.iterdir() if f.name.startswith("part-00001")).unlink()
    with pytest.raises(ValueError, match="shards"):
        shards.read_slots(spark, str(path), length=length, per_shard=per)


def test_slots_and_documents_by_brute_force(spark, docs, tmp_path):
    from collections import defaultdict

    import tiktoken
    from pyspark.sql import functions as F

    length, per, frame = 64, 10, docs.repartition(3)
    ranks, pattern = shards.public_vocabulary()
    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tasks = defaultdict(list)
    for r in frame.select("doc_id", "text", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        tasks[r["task"]].append(r)
    sequences = []
    for task in sorted(tasks):
        ids, owners = [], []
        for r in tasks[task]:
            new = [*encode(r["text"] or ""), len(ranks)]
            owners += [(r["at"], r["doc_id"])] * len(new)
            ids += new
        for k in range(0, len(ids), length):
            part, own = ids[k : k + length], owners[k : k + length]
            docs_here = sorted((d for _, d in dict.fromkeys(own)), key=lambda d: (d is None, d or 0))
            sequences.append((hashlib.sha256(np.array(part + [len(ranks)] * (length - len(part)), "<u2").tobytes()).hexdigest(), [d for d in docs_here], len(part)))
    slots = shards.permute(np.arange(len(sequences)), len(sequences)).tolist()
    want = {s: (s // per, s % per, n, sorted(map(str, (d for d in ds if d is not None))), digest) for s, (digest, ds, n) in zip(slots, sequences)}
    got = {r["slot"]: (r["shard"], r["record"], r["n_tokens"], sorted(map(str, r["doc_ids"])), r["ids_sha256"]) for r in shards.training_order(frame, str(tmp_path / "b"), length=length, per_shard=per).collect()}
    assert got == want


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    monkeypatch.setattr(shards, "PIECE", 200)
    encoder = shards.Encoder(*shards.public_vocabulary())
    text = sentence(600, 77) + "  two  spaces \n and\ttabs " + "x" * 900 + " end"
    assert np.frombuffer(encoder.text(text.encode()), "<u2").tolist() == [*encoder.encode(text), encoder.end]


def test_a_driver_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from gridloom.llm.common import shared_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc))


# ------------------------------------------------------------------ byte-level BPE


def test_bpe_round_trip(docs, rows, empty):
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for r in rows:
        ids, raw = encode(r[1] or ""), (r[1] or "").encode()
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(clashing(docs)).collect()) == want
    back = bpe.decode(bpe.encode(docs), ranks).collect()
    assert Counter(r["text"] for r in back) == Counter((r[1] or "").encode() for r in rows)
    assert bpe.round_trip(empty).count() == 0


def test_long_words_fold_as_the_library_does():
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEF"))
    long = ["".join(rng.choice(letters, n)) for n in (65, 66, 500, 100_000)] + ["a" * 3_000, "ab" * 999, "ü" * 500, "=" * 1_000, "thethere" * 200]
    made = bpe.encoder(ranks, pattern)
    for w in long:
        for text in (w, f"some words {w} and  {w}"):
            assert np.frombuffer(made(text.encode()), "<u4").tolist() == encode(text)
    for w in long[:3] + long[4:6]:
        assert bpe.fold_long(w.encode(), ranks) == bpe.fold_word(w.encode(), ranks)
    short = ["".join(rng.choice(letters, n)) for n in range(2, 60)]
    assert all(bpe.fold_long(w.encode(), ranks) == bpe.fold_word(w.encode(), ranks) for w in short)


def test_both_folds_agree(spark):
    from pyspark.sql import functions as F

    ranks, _ = bpe.public_vocabulary()
    words = [" theronion", "x", "", " Ünbër", "日本", "aaaaaaaaaaaa", " antidisestablishmentarianism", "\n\n", "zqxj"]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_merges(F.col("w").cast("binary"), bpe.rank_literal(ranks)).alias("ids"))
    for r in frame.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == (bpe.fold_word(r["w"].encode(), ranks) if r["w"] else [])


# ------------------------------------------------------------------ URL filters


def brute_verdict(url, rules=None):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m.group(2)) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules or RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else ("block" if host == "" else "allow")


RULES = [*urlfilter.RULES, ("block", "a.example.net", "/en/x"), ("allow", "b", "/"), ("block", "c.b", "/q")]


def test_url_rules(spark):
    urls = [
        "http://a.net/", "https://www.Example.NET/en/1?x", "http://example.net/de", "http://a.example.net/en/xyz#t", "http://b.a.example.net/en/x", "http://example.com/de/", "http://x.org/fr/", "http://xorg/fr/", "http://net",
        "http://net/", "nothing", None, "", "://", "http:///p", "http://example.net./en/", "x://c.b/q://b", "http://b/", "http://cb/q", "http://d.c.b/qq", "http://.net/", "a://net?/", "http://n-et/", "http://net0/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, *urls])], "page_id long, url string, key string")
    got = {(r["page_id"],) + tuple(r)[1:] for r in urlfilter.judge(pages, RULES, parts=3).collect()}
    assert got == {(i, *brute_verdict(u)) for i, u in enumerate([*urls, *urls])}
    assert urlfilter.judge(pages.where("page_id < 0")).count() == 0 and urlfilter.judge(pages, []).count() == len(urls) * 2


@pytest.mark.parametrize("parts", [1, 7])
def test_nested_rules_cross_ranges(spark, parts):
    """Random rules, nested up to five deep, as a table; a host with a third of the urls; stacks are carried over the ranges' borders."""
    rng = np.random.default_rng(31)
    name = lambda n: ".".join(rng.choice(list("abc"), n))
    rules = list({(h, p): (str(rng.choice(["block", "allow"])), h, p) for h, p in ((name(rng.integers(1, 6)), "/" + name(rng.integers(0, 2)).replace(".", "/")) for _ in range(150))}.values())
    urls = [f"http://{name(rng.integers(1, 8))}/{name(rng.integers(1, 4)).replace('.', '/')}" for _ in range(300)] + ["https://a.b.c/" + "abc"[i % 3] for i in range(150)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, key int, open int")
    table = spark.createDataFrame([*rules, ("allow", None, "/"), ("allow", "b", None)], "action string, host string, path string")
    for given in (table, rules):
        got = Counter(tuple(r) for r in urlfilter.judge(pages, given, parts=parts).collect())
        assert got == Counter((i if i % 50 else None, *brute_verdict(u, rules)) for i, u in enumerate(urls))


def test_many_rules_are_planned_at_once(spark):
    import time

    rules = spark.range(100_000).select(F.lit("block").alias("action"), F.concat(F.lit("h"), F.col("id"), F.lit(".example")).alias("host"), F.lit("/").alias("path"))
    pages = spark.createDataFrame([(i, f"http://x.h{i * 37}.example/{i}") for i in range(3_000)], "page_id long, url string")
    began = time.perf_counter()
    assert urlfilter.judge(pages, rules).where("verdict = 'block'").count() == sum(i * 37 < 100_000 for i in range(3_000))
    assert time.perf_counter() - began < 60


# ------------------------------------------------------------------ embeddings


def near_copies(base, cosine, rng):
    """A vector at the given cosine of each row."""
    z = rng.normal(size=base.shape)
    z -= (z * base).sum(1, keepdims=True) * base
    return cosine * base + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def unit_rows(n, dim, rng):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_links(v, cosine=0.95):
    a = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = a @ a.T >= cosine
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("dim", [32, 64, 256])
def test_recall_of_planted_unequal_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    base = unit_rows(1_000, dim, rng)
    v = np.concatenate([base, near_copies(base, 0.9505, rng)]).astype(np.float32)
    want = brute_links(v)
    got = lattice.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    found = sum(r["n_links"] for r in got)
    assert want.sum() >= 1_900 and 0.95 * want.sum() <= found <= want.sum()
    assert all(r["n_links"] <= want[r["vec_id"]].sum() for r in got)


def test_embedding_links(spark):
    rng = np.random.default_rng(11)
    n = 400
    base = unit_rows(n, 64, rng)
    near = [near_copies(base[:100], c, rng) for c in (0.952, 0.97, 0.999)]
    v = np.concatenate([base, *near, np.repeat(base[:1], 50, 0), 3 * base[5:6]]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1.0, None], [1.0, 2.0]]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(len(v) + i, x, None) for i, x in enumerate(odd)] + [(None, base[1].astype(np.float32).tolist(), 2)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")).collect()
    by = {r["vec_id"]: r for r in got}
    link = brute_links(v)
    true = link.sum() + 2 * link[1].sum() + 2
    assert len(got) == len(rows) and 0.95 * true <= sum(r["n_links"] for r in got) <= true
    for i in range(len(odd)):
        assert tuple(by[len(v) + i]) == (len(v) + i, 0, len(v) + i, True)
    assert by[n + 300]["n_links"] >= 50 and by[n + 300]["component_id"] == 0 and not by[n + 300]["kept"]
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("cell", [lattice.CELL, 40])
def test_dense_groups_of_unequal_vectors(spark, cell):
    """Groups whose members are all alike: found whole whether cells are dealt as blocks or not."""
    rng = np.random.default_rng(12)
    centres = unit_rows(3, 64, rng)
    v = np.concatenate([near_copies(np.repeat(centres[:1], 150, 0), 0.99, rng), near_copies(np.repeat(centres[1:2], 60, 0), 0.985, rng), unit_rows(100, 64, rng)]).astype(np.float32)
    link = brute_links(v)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1_000, v[3].tolist())]
    got = {r["vec_id"]: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=cell).collect()}
    want = {i: int(link[i].sum() + link[i, 3] + (i == 3)) for i in range(len(v))}
    assert sum(got[i]["n_links"] for i in want) >= 0.99 * sum(want.values()) and all(got[i]["n_links"] <= want[i] for i in want)
    assert {got[i]["component_id"] for i in range(150)} == {0} and got[1_000]["component_id"] == 0
    assert {got[i]["component_id"] for i in range(150, 210)} == {150} and all(got[i]["component_id"] == i for i in range(210, 310))


@pytest.mark.parametrize("cell", [lattice.CELL, 100])
def test_a_dense_group_leaves_rows_in_its_size(spark, cell):
    """What a dense group writes grows with its members, not with its pairs, and every pair is counted once."""
    rng = np.random.default_rng(13)
    written = {}
    for n in (150, 300):
        v = near_copies(np.repeat(unit_rows(1, 48, rng), n, 0), 0.99, rng).astype(np.float32)
        link = brute_links(v)
        frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        classes = lattice.classes_of(frame.select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
        found = lattice.links(classes, cell=cell)
        written[n] = found.count()
        ids = {r["cid"]: r["low"] for r in classes.collect()}
        sums = {ids[r["a"]]: r["s"] for r in found.where("others is not null").groupBy("a").agg(F.sum("others").alias("s")).collect()}
        assert all(sums[i] <= link[i].sum() for i in sums) and sum(sums.values()) >= 0.99 * link.sum()
    blocks = (300 * 9 // cell + 2) ** 2 if cell < 4_096 else 1
    assert written[300] < 36 * 2 * 300 * blocks and (cell < 4_096 or written[300] < 3 * written[150])


def test_lattice_points_are_nearest():
    x = RNG.normal(size=(50, 8)) * 2
    near = lattice.decode(x)
    for p, q in zip(x, near):
        assert ((p - q) ** 2).sum() <= ((p - (q + lattice.shell())) ** 2).sum(1).min() + 1e-9


# ------------------------------------------------------------------ quality rules and classifier


def brute_measures(text):
    w = words_of(text)
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, empty):
    got = quality.apply_policy(quality.ledger(docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r[0], *brute_measures(r[1])) for r in rows)
    for r in got:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert base == bool(r["failures"] & quality.POLICIES["base"]) and not (base and r["kept"])
    kept = quality.quality_filter(clashing(docs))
    assert kept.columns == clashing(docs).columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality.quality_filter(empty).count() == 0


def test_ablations(docs):
    rows = quality.ledger(docs)
    bits = [r["failures"] for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        b = 1 << quality.BIT[r["rule"]]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x in (0, b) for x in bits))


def test_attention_gradient():
    m = {k: v.astype(float) for k, v in mil.new_model().items()}
    m["c"] = RNG.normal(size=mil.HIDDEN)
    x, starts, y = np.abs(RNG.normal(size=(7, mil.WIDTH))) / 10, np.array([0, 3, 4]), np.array([1.0, 0, 1])

    def loss():
        p = mil.forward(mil.encode(x, m), starts, m)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = mil.gradient(x, starts, y, m)
    for name, at in (("W", (5, 2)), ("V", (1, 1)), ("U", (0, 3)), ("w", (2,)), ("c", (4,)), ("d", (0,)), ("b", (1,))):
        h, old = 1e-5, m[name][at]
        m[name][at] = old + h
        up = loss()
        m[name][at] = old - h
        down = loss()
        m[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-7)


def brute_score(text, m):
    """One passage at a time, from the published formulas of gated attention."""
    table, raw = mil.byte_classes(), text.encode()
    total = max(1, round(len(raw) / mil.PASSAGE))
    hs, es = [], []
    for p in range(total):
        lo, hi = p * mil.PASSAGE, len(raw) if p == total - 1 else (p + 1) * mil.PASSAGE + 1
        pairs = Counter((int(table[a]), int(table[b])) for a, b in zip(raw[lo:hi], raw[lo + 1 : hi]))
        n = sum(pairs.values())
        x = np.zeros(mil.WIDTH)
        if n:
            for (a, b), k in pairs.items():
                x[a * mil.CLASSES + b] = math.sqrt(k / n)
            x[-4:] = len(pairs) / 100, max(pairs.values()) / n, -sum(k / n * math.log(k / n) for k in pairs.values()) / 5, n / mil.PASSAGE
        h = np.tanh(x @ m["W"] + m["b"])
        hs.append(h)
        es.append(float(sum(m["w"] * np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"]))))))
    a = np.exp(np.array(es) - max(es))
    z = (a / a.sum()) @ np.array(hs)
    return 1 / (1 + math.exp(-(float(z @ m["c"]) + float(m["d"][0]))))


def test_scores_of_passages_by_brute_force(spark, docs, rows):
    m = {k: v + RNG.normal(size=v.shape).astype(np.float32) / 5 for k, v in mil.new_model().items()}
    got = mil.score(docs, m).collect()
    have, want = sorted((str(r["doc_id"]), r["score"]) for r in got), sorted((str(r[0]), brute_score(r[1] or "", m)) for r in rows)
    assert [i for i, _ in have] == [i for i, _ in want] and [x for _, x in have] == pytest.approx([x for _, x in want], abs=1e-4)
    assert mil.score_text((rows[11][1]).encode(), mil.byte_classes(), m, 3) == pytest.approx(brute_score(rows[11][1], m), abs=1e-5)


def test_long_bags_have_the_same_gradient():
    m = {k: v.astype(float) for k, v in mil.new_model().items()}
    m["c"] = RNG.normal(size=mil.HIDDEN)
    text, table = sentence(900, 55).encode(), mil.byte_classes()
    want = mil.gradient(mil.passages(text, table).astype(float), np.zeros(1, np.int64), np.array([1.0]), m)
    got = mil.long_gradient(text, table, 1.0, m, block=3)
    assert all(got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-6) for k in want)


def test_a_poor_passage_anywhere_in_a_long_text_is_learned(monkeypatch):
    monkeypatch.setattr(mil, "BLOCK", 16)
    texts, y = [], []
    for i in range(60):
        words = sentence(900, 2_000 + i).split()
        if i % 2:
            at = int(np.random.default_rng(i).integers(0, 800))
            words[at : at + 90] = ["###|||$$$"] * 90
        texts.append(" ".join(words).encode())
        y.append(float(1 - i % 2))
    m = mil.new_model()
    for r in range(4):
        m = mil.train(texts[:40], np.array(y[:40], np.float32), m, seed=r)
    right = [(mil.score_text(t, mil.byte_classes(), m) >= 0.5) == (v == 1) for t, v in zip(texts[40:], y[40:])]
    assert sum(right) >= 18


def test_classifier(spark, docs, empty):
    good = [(i, sentence(120, 500 + i)) for i in range(60)]
    bad = [(100 + i, " | ".join(sentence(90, 700 + i).upper().split()) + "!!") for i in range(60)]
    table = spark.createDataFrame([*good, *bad, (300, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1, 0) for i, _ in good), *((i, 0, 0) for i, _ in bad), (300, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mil.classify(table, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) and 0 <= got[i]["score"] <= 1 for i in got)
    wrong = [i for i in held if i < 200 and got[i]["predicted"] != (i < 100)]
    assert len(wrong) <= 2
    assert mil.keep_good(clashing(docs), labels).columns == clashing(docs).columns
    assert all(r["score"] == 0.5 for r in mil.classify(table, labels.where("doc_id < 0")).collect()) and mil.classify(empty, labels).count() == 0


def test_classifier_learns_from_what_a_filter_took_away(spark):
    good = [(i, sentence(120, 500 + i)) for i in range(60)]
    bad = [(100 + i, " | ".join(sentence(90, 700 + i).upper().split()) + "!!") for i in range(70)]
    table = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*good, *bad] if i < 160], "doc_id long, quality int")
    kept = table.where("doc_id < 100 or doc_id >= 160")  # no labelled poor document is left
    got = {r["doc_id"] for r in mil.keep_good(kept, labels, table).collect()}
    assert not any(i >= 160 for i in got) and len(got) >= 58
    with pytest.warns(UserWarning, match="nothing is learned"):
        assert mil.keep_good(kept, labels).count() == 70


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(900, 1_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1_000)], "doc_id long, quality int")
    got = [r["quality"] for r in mil.training_sample(docs, labels, 10).collect()]
    assert (got.count(0), got.count(1)) == (10, 10)
    assert mil.training_sample(docs, labels, 10).join(docs, "doc_id").count() == 20


def test_ids_that_repeat_are_learned_from_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, f"x{i % 40}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "checkpointed", lambda df: seen.append(df.count()) or df)
    mil.fit(docs, labels, rounds=1)
    assert max(seen) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(20))


# ------------------------------------------------------------------ mixing


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(clashing(docs)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(words_of(r[1]))) for r in rows)
    by = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert sum(t for _, t in by) == pytest.approx(sum(sizes.values())) and all(t <= 3 * s + 1e-6 for s, t in by)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(clashing(docs)).collect()))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got if r["size"])
    other = mixing.mix_documents(clashing(docs))
    assert other.columns == clashing(docs).columns and Counter(r["doc_id"] for r in other.collect()) == Counter(r["doc_id"] for r in out.collect())
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_reruns_agree_in_any_order_of_rows(spark):
    rows = [(i if i % 4 else (7 if i % 8 else None), sentence(20 + i % 50, i % 300), "ab"[i % 3 == 0]) for i in range(800)]  # ids that repeat or are null, texts that repeat
    seen = set()
    for k, parts in ((0, 1), (1, 3), (2, 8), (3, 5)):
        frame = spark.createDataFrame([rows[i] for i in np.random.default_rng(k).permutation(800)], "doc_id long, text string, source string").repartition(parts)
        seen.add(tuple(sorted(map(str, mixing.mix(frame, bins=4).collect()))))
        seen.add(tuple(sorted(map(str, mixing.mix(frame, bins=4).collect()))))
    assert len(seen) == 1


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1_000), ("c", 500), (None, 4)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a (weight 5) stops at 30 and null (weight 5) at 12; b and c (2 and 1) share the rest
    assert got == pytest.approx({"a": 30, None: 12, "b": (1514 - 42) * 2 / 3, "c": (1514 - 42) / 3})


@pytest.mark.parametrize("bins", [2, 256])
def test_taken_words_come_near_the_target(spark, bins):
    rows = [(i, sentence(20 + i % 50, i), "abcd"[i % 4]) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), bins=bins).collect()
    for k in range(4):
        mine = [r for r in got if r["doc_id"] % 4 == k]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=40)


def test_short_documents_are_likelier(spark):
    """Within a source the share of documents taken falls with their size as the inclusion odds do."""
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 90)), "a") for i in range(3_000)] + [(5_000 + i, " ".join(["w"] * 50), "b") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = {size: np.mean([r["copies"] % 1 + (r["copies"] > r["target"] // r["source_size"]) for r in got if r["size"] == size and r["doc_id"] < 5_000]) for size in (10, 90)}
    mine = [r for r in got if r["doc_id"] < 5_000]
    assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=90)
    odds = lambda p: p / (1 - p)
    assert 0 < taken[90] < taken[10] < 1 and odds(taken[10]) / odds(taken[90]) == pytest.approx((50 + 90) / (50 + 10), rel=0.25)


# ------------------------------------------------------------------ components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)] + [(7, 3), (3, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
