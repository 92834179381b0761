"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every text; the ledger keeps the measurements and one failure bit per
rule. Policies are versioned bit masks over that ledger: applying another policy, or asking what a
policy would keep without one of its rules, never reads a text again.

Defined cases: a null or empty text has no words and every measurement 0, so it fails ``few_words``.
Rows with a null id, repeated rows and further columns are judged like any other row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_slices, with_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_long_runs")
SYMBOLS, BANGS = b"#*$%&|<>", b"!"

#: name -> SQL over the measurements; a rule's bit is its place in this list. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    ("shouting", "10 * n_bangs > 5 * n_words"),
    ("word_runs", "10 * n_long_runs > 3 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


#: version -> bits of which any rejects a text.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask(*BIT),
}


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    raw = np.frombuffer(text, np.uint8)
    points = len(text) - int(np.count_nonzero((raw & 0xC0) == 0x80))
    blanks = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeat = 0
    if n > 3:
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * np.int64(len(known)) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeat = int(covered.sum())
    runs = int((ids[1:] == ids[:-1]).sum())
    return (
        n,
        points - blanks,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(text) - len(text.translate(None, BANGS)),
        runs,
    )


def _measure_batches(at: int, carried: int):
    """Measurements of the texts in column ``at``, behind the first ``carried`` columns."""

    def run(batches):
        for b in batches:
            rows = [measure(x or b"") for _, some in text_slices(b.column(at)) for x in some]
            cols = np.array(rows, np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:carried], *(pa.array(cols[:, i]) for i in range(len(MEASURES)))], names=[*b.schema.names[:carried], *MEASURES])

    return run


def rule_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, sql in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the carried columns, the measurements and ``failures``, a bit per failed rule."""
    clash = set(carry) & {*MEASURES, "failures"}
    if clash:
        raise ValueError(f"carried columns clash with measurements: {sorted(clash)}")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"{m} long" for m in MEASURES)])
    picked, at = with_text(docs, carry, text)
    return picked.mapInArrow(_measure_batches(at, len(carry)), schema).withColumn("failures", rule_bits())


def rejected_by(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return rows.withColumn("kept", ~rejected_by(policy))


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows failing it, rows only it rejects, and rows kept without it.

    Rows are first counted by failure mask, so at most 2^rules rows remain whatever the input.
    """
    chosen = POLICIES[policy]
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(chosen).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for n, i in BIT.items() if chosen >> i & 1))
    each = counts.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    none = F.col("bits") == 0
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return each.groupBy("rule").agg(add(fails).alias("n_failed"), add(alone).alias("n_only"), add(none | alone).alias("n_kept_without"))


def quality_filter(docs: DataFrame, text: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns and order of columns.

    The ledger's row carries all columns of docs, so nothing is joined back by a key that may repeat.
    """
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index(text)
    rows = ledger(renamed, f"c{at}", tuple(renamed.columns))
    return rows.where(~rejected_by(policy)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
