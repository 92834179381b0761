"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target size; every document of it is taken a certain whole number of times, and a
Pareto order sample takes the rest: documents are ranked by (u / (1 - u)) / odds, where u is a uniform number hashed
from the seed, the id and the text, and odds are the document's inclusion odds: p / (1 - p) for the fraction p of its source that is
left to take, times 2 m / (m + size), where m is the mean size of the source's documents with words. So a source's short
documents are likelier than its long ones, and the words that are left go to more documents. Documents are taken in that
order until the source's remaining target is met to within half a document.

No source is ever ordered as a whole. Ranks are counted in coarse bins per source, then the coarse bin in
which the target falls in fine ones (at most ``BINS`` rows a source each time); only the fine bin in which
the target falls is ordered row by row.

Defined cases: null texts and texts without words have size 0 and are taken 0 times; a null source is a
source of its own, placed last; a null id counts as the text ``null``. Rows that share u have the same id and
text, so which of them is taken makes no difference, and a rerun in another order of rows gives the same rows. An
empty table gives an empty mix; columns of any name are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, broadcast_if_small, checkpointed

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 256  # coarse ones, and fine ones in each


def uniform(seed: int, key: Column, digest: Column) -> Column:
    """A number in (0, 1) from the md5 of seed, key and the digest of a text; the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("null")), F.lit("-"), digest).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, source_docs, target) from (source, size): weighted shares of all sizes, each at most max_copies times its source.

    The excess of capped sources is shared again by weight. That is water-filling: with sources in
    order of cap / weight, the first level at which all further sources stay below their caps.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").asc_nulls_last()))
    pick = F.array(*(F.lit(int(w)) for w in weights))
    rows = total.select("source", "source_size", "source_docs", (place - 1).alias("place"))
    rows = rows.withColumn("weight", F.element_at(pick, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * max_copies)
    whole = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    rows = rows.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("at", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))
    return rows.select("source", "source_size", "source_docs", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _edges(rows: DataFrame, bin: Column) -> DataFrame:
    """(source, edge, before): the bin of each source in which the running size passes ``rest``, and the size of the bins before it.

    rows has source, rest, done (what was counted before these rows) and size.
    """
    binned = rows.groupBy("source", "rest", "done", bin.alias("edge")).agg(F.sum("size").alias("bin_size"))
    order = Window.partitionBy("source").orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("before", F.col("done") + F.coalesce(F.sum("bin_size").over(order), F.lit(0)))
    return checkpointed(binned.where("before <= rest and before + bin_size > rest").select("source", "edge", "before"))


def _by_source(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows with the columns of side, which has one row per source at most."""
    side = broadcast_if_small(side.withColumnRenamed("source", "__source"))
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _copies(docs: DataFrame, id_col: str, text: str, source: str, weights: Sequence[int], max_copies: int, seed: int, bins: int, carry: Sequence[str]) -> DataFrame:
    """doc_id, size, source_size, target, copies and the carried columns as __carry0, __carry1, ..., one row per row of docs."""
    name = lambda c: F.col(f"`{c}`")
    rows = docs.select(
        name(id_col).alias("doc_id"), name(source).alias("source"), uniform(seed, name(id_col), F.md5(F.coalesce(name(text), F.lit("")).cast("binary"))).alias("u"),
        F.coalesce(F.regexp_count(name(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *(name(c).alias(f"__carry{i}") for i, c in enumerate(carry)),
    )
    if not carry:  # three numbers and a name a row; the texts are read once
        rows = checkpointed(rows)
    both = _by_source(rows, checkpointed(source_targets(rows, weights, max_copies)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    both = both.withColumn("p", F.col("rate") - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    mean = F.col("source_size") / F.col("source_docs")
    odds = F.col("p") / (1 - F.col("p")) * (2 * mean / (mean + F.col("size")))
    both = both.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / odds))
    fine = F.when(F.col("rank").isNotNull(), F.floor(F.col("rank") / (1 + F.col("rank")) * (bins * bins)).cast("long"))
    both = both.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / bins))
    ranked = both.where("rank is not null").select("source", "rest", "coarse", "fine", "size")
    coarse = _edges(ranked.withColumn("done", F.lit(0).cast("long")), F.col("coarse"))
    inner = _by_source(ranked, coarse.withColumnRenamed("before", "done")).where("coarse = edge")
    placed = _by_source(both, _edges(inner, F.col("fine")))
    inside = F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("fine") < F.col("edge")))
    at_edge = F.coalesce(F.col("fine") == F.col("edge"), F.lit(False))
    running = F.sum("size").over(Window.partitionBy("source", "edge").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("at_edge", at_edge).withColumn("inside", inside)
    ordered = placed.where("at_edge").withColumn("sum_before", F.col("before") + F.coalesce(running, F.lit(0)))
    ordered = ordered.withColumn("extra", (F.col("sum_before") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("sum_before")
    plain = placed.where("not at_edge").withColumn("extra", F.coalesce(F.col("inside"), F.lit(False)).cast("long"))
    return ordered.unionByName(plain).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES, seed: int = 17, bins: int = BINS,
) -> DataFrame:
    """One row per row of docs: the id, size, source_size, target, copies and taken = copies * size."""
    out = _copies(docs, id_col, text, source, weights, max_copies, seed, bins, ())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES, seed: int = 17, bins: int = BINS,
) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with the columns of docs."""
    rows = _copies(docs, id_col, text, source, weights, max_copies, seed, bins, docs.columns)
    repeated = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*(F.col(f"__carry{i}").alias(c) for i, c in enumerate(docs.columns)))
