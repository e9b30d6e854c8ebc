"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, finishes at a virtual time: the words of its source up to it, divided by
the source's target. Sorting all documents by that time interleaves the sources in proportion to their targets; the
mix is what comes before the total budget is used up. Sources with targets above their size run through their
documents again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpoint, column, lookup
from tidemark.llm.totals import running_totals

#: Part of each source's size that a mix takes at most, in multiples.
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, number, target`` from the sizes of documents (``source, size``).

    Sources in code point order, null last, weigh ``weights`` in turn and share the total size; a target stops at
    ``most`` times its source's size and the rest is shared by weight, until none is above. That level of words per
    weight is found in one pass over the sources by the ratio at which each is full.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    s = running_totals(s, [F.col("source").asc_nulls_last()], ["one"]).withColumn("number", F.col("run_one") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", "number", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    s = running_totals(s, [F.col("cap") / F.col("weight"), F.col("number")], ["cap", "weight"])
    # the level if all sources that fill earlier are full; the true one is the highest of these
    totals = s.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("weight").alias("_weights"))
    left = (F.col("_all") - F.col("run_cap") + F.col("cap")) / (F.col("_weights") - F.col("run_weight") + F.col("weight"))
    level = s.crossJoin(F.broadcast(totals)).agg(F.greatest(F.max(left), F.lit(0.0)).alias("_level"))
    s = s.crossJoin(F.broadcast(level))  # both sides of one row
    return s.select("source", "source_size", "number", F.least("cap", F.col("_level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row, doc_id, source, key, size, source_size, target, copies, taken`` for every row.

    Sizes are numbers of words (null texts: 0). ``copies`` says how often the mix takes the document, ``taken`` the
    words that makes. The order within a source follows a hash of the id and the seed, so reruns agree. Rows that
    repeat an id are documents of their own; null ids and sources are values like others; rows without words take no
    part; no documents, no rows. ``key`` is a hash of the text.
    """
    size = F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(doc_id).alias("doc_id"), column(source).cast("string").alias("source"), F.xxhash64(column(text)).alias("key"), size.alias("size"))
    rows = checkpoint(rows)
    targets = checkpoint(source_targets(rows.select("source", "size"), weights))
    side = targets.withColumnRenamed("source", "_source")
    few = side.limit(10_001).count() <= 10_000
    known = rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.ceil(F.col("target") / F.col("source_size") - 1e-9).cast("int")
    copies = known.filter("size > 0").select("row", "number", "size", "source_size", "target", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("epoch"), F.col("doc_id").cast("string").alias("_id"), "key")
    copies = copies.withColumn("draw", F.xxhash64(F.lit(seed), "epoch", F.coalesce("_id", F.lit("")), "key")).drop("_id", "key")
    copies = running_totals(copies, [F.col("number"), F.col("epoch"), F.col("draw"), F.col("size"), F.col("row")], ["size"])
    before = targets.select("number", (F.when(F.col("source_size") > 0, F.greatest(F.ceil(F.col("target") / F.col("source_size") - 1e-9), F.lit(1))).otherwise(0) * F.col("source_size")).cast("long").alias("words"))
    before = running_totals(before, [F.col("number")], ["words"]).select("number", (F.col("run_words") - F.col("words")).alias("_first"))
    copies = lookup(copies, before, ["number"])
    finish = (F.col("run_size") - F.col("_first")).cast("double") / F.col("target")
    queue = copies.select("row", "number", "epoch", "draw", "size", finish.alias("finish"))
    queue = running_totals(queue, [F.col("finish"), F.col("number"), F.col("epoch"), F.col("draw"), F.col("row")], ["size"])
    total = targets.agg(F.sum("source_size").alias("_budget"))  # one row
    inside = queue.crossJoin(F.broadcast(total)).filter(F.col("run_size") - F.col("size") / 2 <= F.col("_budget"))
    taken = inside.groupBy("row").agg(F.count(F.lit(1)).alias("_copies"))
    out = known.join(taken, "row", "left").withColumn("copies", F.coalesce("_copies", F.lit(0)).cast("long"))
    return out.select("row", "doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents the mix takes, each as often as it takes it, with their columns.

    Rows equal in id, source and text are one document here, which takes the copies of all. See ``mix_plan``.
    """
    plan = mix_plan(docs, weights, seed, doc_id, text, source).filter("copies > 0")
    plan = plan.groupBy("doc_id", "source", "key").agg(F.sum("copies").cast("int").alias("copies"))
    d = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(doc_id).alias("_id"), column(source).cast("string").alias("_source"), F.xxhash64(column(text)).alias("_key"))
    d = d.join(plan, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_key") == F.col("key")))
    once = F.row_number().over(Window.partitionBy("_id", "_source", "_key").orderBy("_key"))
    d = d.withColumn("_nth", once).filter("_nth = 1")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")
