"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are put
in key order, the sizes before each are summed, and the source is cut at its
budget; whole epochs come first when the budget exceeds the source. The key's
leading bits are its range, so ranges are even whatever the source holds: sums
per range, prefix sums of those, and running sums inside a range replace a
sort of a whole source in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.tables import WORD, written

KEY_BITS = 60
ROWS_PER_RANGE = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Targets of (source, source_size): shares of all sizes by weight, capped.

    Sources in code point order (null last) weigh ``weights``, repeating. A
    share above ``max_epochs`` times the source is cut there and the rest goes
    to the others by weight until none is above. The capped sources are the
    first ones in the order of size per weight, so one pass over the sorted
    sources finds them. There is one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_epochs
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    ranked = ranked.withColumns({"__cap": cap, "__left": left, "__weights": weights_left})
    capped = F.col("__cap") * F.col("__weights") < F.col("weight") * F.col("__left")
    ranked = ranked.withColumn("__capped", capped)
    free = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(everything), F.lit(0)
    )
    free_weight = F.sum(F.when(~F.col("__capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(
        (F.col("weight") * free).cast("double") / free_weight
    )
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """What the mix takes of each document: (doc_id, source, size, source_size, target, epochs, extra, taken).

    Sizes are words. ``epochs`` whole copies and ``extra`` words of one more
    are taken, ``taken`` words in all; a source's taken words add up to its
    target, rounded down. A null text has size 0; a null source is a source.
    Documents are ordered by a hash of doc_id, then doc_id and size (nulls
    first): rows equal in those are interchangeable. An empty table gives no
    rows. Other columns are ignored.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "mix-sizes"
    )
    rows = sized.count()
    range_bits = max(0, math.ceil(math.log2(max(rows, 1) / ROWS_PER_RANGE))) if rows else 0
    # A null source must meet itself in joins: the name gets a prefix that null lacks.
    sized = sized.withColumns(
        {
            "name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "range": F.shiftright("key", KEY_BITS - range_bits),
        }
    )
    ranges = written(sized.groupBy("name", "source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sources, weights, max_epochs).withColumn(
        "name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    )
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .select("name", "range", "offset")
        .join(targets.drop("source", "weight"), "name")
    )
    inside = (
        Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["name", "range"]
    )
    budget = F.floor("target")
    # Sources without words have nothing to take.
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    placed = placed.withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("within")
    placed = placed.withColumn("extra", F.least(F.greatest(rest, F.lit(0)), F.col("size")).cast("long"))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), count.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The documents of the mix with their columns: each one ``epochs`` times and,
    where the budget ends inside an epoch, once more up to its last word taken.

    Documents of which nothing is taken (those without words among them) go.
    Rows equal in doc_id, source and size are matched to the plan one by one.
    """
    same = ["__id", "__name", "__size", "__copy"]

    def keyed(df: DataFrame, size: Column, order: Column) -> DataFrame:
        keys = {
            "__id": F.coalesce(F.col("c_doc_id").cast("string"), F.lit("")),
            "__name": F.coalesce(F.concat(F.lit("="), "c_source"), F.lit("")),
            "__size": size,
        }
        copies = Window.partitionBy("__id", "__name", "__size").orderBy(order)
        return df.withColumns(keys).withColumn("__copy", F.row_number().over(copies))

    # Columns of the documents get names that none of these clash with.
    given = docs.columns
    plan = mix_sources(docs, weights, max_epochs).withColumnsRenamed({"doc_id": "c_doc_id", "source": "c_source"})
    docs = docs.toDF(*[f"c_{c}" for c in given])
    plan = keyed(plan, F.col("size"), F.col("extra").desc())
    plan = plan.where("taken > 0").select(*same, F.col("epochs").alias("__epochs"), F.col("extra").alias("__extra"))
    joined = keyed(docs, word_count(F.col("c_text")), F.xxhash64("c_text")).join(plan, same)
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("__epochs").cast("int"))
    rest = F.when(F.col("__extra") > 0, F.array(F.col("__extra"))).otherwise(F.array().cast("array<long>"))
    taken = joined.withColumn("__words", F.explode(F.concat(whole, rest)))
    cut = (F.col("__words") >= 0) & (F.col("__words") < F.col("__size"))
    text = F.when(cut, first_words(F.col("c_text"), F.col("__words"))).otherwise(F.col("c_text"))
    return taken.withColumn("c_text", text).select(*[F.col(f"`c_{c}`").alias(c) for c in given])
