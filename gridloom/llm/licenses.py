"""License scans by an exact set-similarity join (DataFrame functions only).

Texts and templates are sets of pairs of adjacent words, so that order counts. A text block is a window of consecutive
words, half as long again as the template; every window of a text counts, whatever its lines. A template is
found in a block when the block holds at least ``CONTAINMENT`` of the template's distinct pairs. All maximal blocks of
a template count, wherever they stand; of blocks of several templates that share words those with the largest
containment stay, which tells sister licenses apart place by place.

Texts are read once: what stays of a text are its number of words and the places of pairs that any template or phrase
has. Template pairs are ordered by how many texts of the whole corpus hold them, rarest first. A text with a block that
meets the threshold holds one of the first |T| - ceil(c |T|) + 1 pairs of that order (prefix filter), has
ceil(c |T|) of the pairs or more (length filter), and the template has as many left from the first shared one on
(positional filter). Texts that pass are verified by the exact overlap of their windows; a trimmed window begins
with a pair of the template, so no other is tried. No block that meets the threshold is lost.

Besides, four phrases are found at every place where their words stand consecutively.

Defined cases: a null text counts as empty; empty texts and texts without a license have no labels
(empty strings), null first and last word, and score 0. Every row is judged on its own, so repeated rows get equal
results and null or repeated ids do no harm; an empty table gives none; other columns, of any name, are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed
from gridloom.llm.license_texts import TEMPLATES

#: The phrases, their labels, and what parts words.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN, OTHER_SIGN = "K", "°"  # the only sign outside ASCII whose lower case is in it; it is no part of any pair

CONTAINMENT = 0.75  # a changed word costs two pairs; sister notices share fewer


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.lower()) if w]


def pairs_of(text: str) -> list[str]:
    """The distinct pairs of adjacent words, in order."""
    ws = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


def least_overlap(n: int, containment: float) -> int:
    return math.ceil(containment * n - 1e-9)


def template_sets(templates: Sequence[tuple[str, str]], containment: float = CONTAINMENT) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, pairs, least overlap, words of a block) of each template."""
    out = []
    for i, (label, text) in enumerate(templates):
        pairs = pairs_of(text)
        out.append((i, label, pairs, least_overlap(len(pairs), containment), math.ceil(1.5 * len(words_of(text)))))
    return out


def vocabulary(templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({p for text in (*(t for _, t in templates), *(p for p, _ in PHRASES)) for p in pairs_of(text)})


def known_pairs(docs: DataFrame, known: Sequence[str]) -> DataFrame:
    """(row, doc_id, n_words, pairs) of docs (doc_id, text): each row's pairs (at, pair) among the known ones, by place."""
    firsts = sorted({p.split()[0] for p in known})
    # lower() is one pass over bytes where translate() is a lookup per sign
    split = F.split(F.lower(F.replace(F.col("text"), F.lit(KELVIN), F.lit(OTHER_SIGN))), BREAKS)

    def of(words: Column) -> Column:
        blank = (F.get(words, F.lit(0)) == "").cast("int")  # an empty string before a leading break, and after a trailing one
        last = F.when(F.size(words) > 1, (F.get(words, F.size(words) - 1) == "").cast("int")).otherwise(F.lit(0))

        def pair(w: Column, i: Column) -> Column:
            both = F.concat(w, F.lit(" "), F.get(words, i + 1))
            return F.when(w.isin(firsts), F.when(both.isin(list(known)), F.struct((i - blank).cast("long").alias("at"), both.alias("pair"))))

        places = F.filter(F.transform(words, pair), lambda x: x.isNotNull())
        return F.struct((F.size(words) - blank - last).cast("long").alias("n_words"), places.alias("pairs"))

    bound = F.get(F.transform(F.array(split), of), F.lit(0)).alias("found")  # the words are bound once
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", bound)
    return checkpointed(rows.select("row", "doc_id", "found.n_words", "found.pairs"))


def phrase_places(pairs: Column) -> Column:
    """(at, label) of every place, counted in words from 0, where a phrase stands. Pairs come by place, each place once,
    so a pair's followers are the next entries, and the search is linear in the text."""

    def of(phrase: str, label: str) -> Column:
        parts = pairs_of(phrase)

        def stands(p: Column, i: Column) -> Column:
            here = p["pair"] == parts[0]
            for k, part in enumerate(parts[1:], 1):
                following = F.get(pairs, i + k)
                here = here & F.coalesce((following["pair"] == part) & (following["at"] == p["at"] + k), F.lit(False))
            return F.when(here, F.struct(p["at"].alias("at"), F.lit(label).alias("label")))

        return F.filter(F.transform(pairs, stands), lambda x: x.isNotNull())

    return F.flatten(F.array(*(of(phrase, label) for phrase, label in PHRASES)))


def template_order(rows: DataFrame, templates: Sequence[tuple[str, str]], containment: float) -> DataFrame:
    """template, label, need, block, order: each template's pairs, those that the fewest texts hold first."""
    counts = rows.select(F.explode(F.array_distinct("pairs.pair")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    fields = ("template", "label", "set", "need", "block")
    listed = F.from_json(F.lit(json.dumps([dict(zip(fields, t)) for t in template_sets(templates, containment)])), "array<struct<template:int,label:string,set:array<string>,need:int,block:int>>")
    each = rows.sparkSession.range(1).select(F.inline(listed)).select("template", "label", "need", "block", F.explode("set").alias("pair"))
    ranked = each.join(counts, "pair", "left").select("template", "label", "need", "block", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair").alias("o"))
    ordered = ranked.groupBy("template", "label", "need", "block").agg(F.sort_array(F.collect_list("o")).alias("o"))
    return ordered.select("template", "label", "need", "block", F.col("o.pair").alias("order"))


def similar_blocks(rows: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(row, template, label, at, stop, block, overlap, n_template): every maximal block of a text that meets a template's
    threshold. rows as ``known_pairs`` gives them.

    A block is trimmed to the words [at, stop) that give its overlap: its first pair does not come again, and its
    last pair is the last new one. It is maximal if no block of its template that shares a word with it
    holds more. So a text has one block of a template wherever a notice stands, several of equal overlap at most.
    """
    order = template_order(rows, templates, containment)
    prefix = order.select("*", F.posexplode("order").alias("place", "pair")).where(F.col("place") <= F.size("order") - F.col("need"))
    prefix = F.broadcast(checkpointed(prefix))  # one row per template pair at most, whatever the corpus
    sets = rows.select("row", "pairs", F.array_distinct("pairs.pair").alias("held")).where(F.size("held") >= min(t[3] for t in template_sets(templates, containment)))
    probes = sets.withColumn("pair", F.explode("held")).join(prefix, "pair").where(F.size("held") >= F.col("need"))
    # of the prefix pairs that a text shares with a template only the first one carries the text on
    probes = probes.where(~F.arrays_overlap("held", F.slice("order", F.lit(1), F.col("place"))))
    probes = probes.where((F.size("order") - F.col("place") >= F.col("need")) & (F.size(F.array_intersect("held", "order")) >= F.col("need")))
    hits = probes.withColumn("hits", F.filter("pairs", lambda p: F.array_contains("order", p["pair"])))
    reach = F.col("block") - 2  # a block of n words has n - 1 places of pairs

    def bound(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def measured(first: Column, held: Column) -> Column:
        names = F.transform(held, lambda p: p["pair"])

        def of(distinct: Column) -> Column:
            end = F.get(held, F.array_position(names, F.element_at(distinct, -1)).cast("int") - 1)["at"]
            again = F.exists(F.slice(held, 2, F.size(held)), lambda p: (p["pair"] == F.get(names, F.lit(0))) & (p["at"] <= end))
            return F.when((F.size(distinct) >= F.col("need")) & ~again, F.struct(first.alias("at"), (end + 2).alias("stop"), F.size(distinct).alias("overlap")))

        return bound(F.array_distinct(names), of)

    def block(h: Column, i: Column) -> Column:
        near = F.get("hits", i + F.col("need") - 1)["at"] <= h["at"] + reach
        held = F.filter(F.slice("hits", i + 1, F.col("block")), lambda p: p["at"] <= h["at"] + reach)
        return F.when(near, bound(held, lambda w: measured(h["at"], w)))

    found = hits.select("row", "template", "label", "block", F.size("order").alias("n_template"), F.inline(F.filter(F.transform("hits", block), lambda x: x.isNotNull())))
    found = checkpointed(found)
    return without(found, ("row", "template"), F.col("block"), lambda x, y: y["overlap"] > x["overlap"])


def without(blocks: DataFrame, keys: tuple[str, ...], width: Column, beats) -> DataFrame:
    """The blocks that no other block of the same keys, sharing a word with it, beats(block, other). None is wider than
    width, so a block meets those that start in its own stretch of that width, or one beside it."""
    x = blocks.withColumn("stretch", F.floor(F.col("at") / width)).alias("x")
    y = blocks.withColumn("stretch", F.explode(F.array(*(F.floor(F.col("at") / width) + k for k in (-1, 0, 1))))).alias("y")
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    same = F.lit(True)
    for k in (*keys, "stretch"):
        same = same & (a(k) == b(k))
    of = lambda c: {k: c(k) for k in blocks.columns}
    return x.join(y, same & (b("at") < a("stop")) & (a("at") < b("stop")) & beats(of(a), of(b)), "left_anti").drop("stretch")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of any template in any block, and 1 where a phrase stands.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = known_pairs(texts, vocabulary(templates))
    widest = F.lit(max((t[4] for t in template_sets(templates, containment)), default=1))
    share = lambda b: b["overlap"] / b["n_template"]
    stay = without(similar_blocks(rows, templates, containment), ("row",), widest, lambda x, y: share(y) > share(x))
    found = stay.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(share({c: F.col(c) for c in stay.columns})).alias("c"))
    out = rows.join(found, "row", "left").select("doc_id", "n_words", phrase_places(F.col("pairs")).alias("places"), "found", "c")
    at, empty = F.col("places.at"), F.array().cast("array<string>")
    n_base = F.size("places")
    labels = lambda *c: F.array_join(F.array_sort(F.array_union(*(F.coalesce(x, empty) for x in c))), ",")
    return out.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(F.col("places.label"), empty).alias("base_labels"), labels(F.col("places.label"), F.col("found")).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("c", F.lit(0.0))).alias("score"),
    )
