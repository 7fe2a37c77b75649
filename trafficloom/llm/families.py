"""Links inside families of near copies, from what each member has other than one of them.

Every class compared with others picks the one compared most often, its centre;
classes of one centre are a family. A member x is kept as its difference from the
centre c: what c has and x has not, and what x has and c has not. For members x
and y

    |x & y| = |x & c| + |y & c| - |c| + (elements that both differences hold),

so two members need not be compared by the elements they share with the centre,
which all members share. Pairs that link whatever their differences share are
linked through the member nearest to the centre. Any other pair must share
elements of its differences, and how many is known from the sizes. Differences
are small, and their elements are rare in the family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.tables import written


def families(compared: DataFrame) -> DataFrame:
    """(s1, fam, fam_size) of every class in pairs (a_s1, b_s1): the one of most pairs among
    the class and those it is paired with, ties to the larger number."""
    ends = compared.select(F.col("a_s1").alias("s1"), F.col("b_s1").alias("other"))
    ends = ends.unionAll(ends.select(F.col("other").alias("s1"), F.col("s1").alias("other")))
    pairs = ends.groupBy("s1").agg(F.count(F.lit(1)).alias("pairs"))
    others = ends.join(pairs.select(F.col("s1").alias("other"), "pairs"), "other")
    best = others.select("s1", F.struct("pairs", F.col("other").alias("s")).alias("x"))
    best = best.unionAll(pairs.select("s1", F.struct("pairs", F.col("s1").alias("s")).alias("x")))
    best = best.groupBy("s1").agg(F.max("x")["s"].alias("fam"))
    return best.join(best.groupBy("fam").agg(F.count(F.lit(1)).alias("fam_size")), "fam").select("s1", "fam", "fam_size")


def members(compared: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Members of families of two parts or more, from pairs (a, a_s1, b, b_s1, shared, only_a,
    only_b) and (doc_id, s1, part, fam). ``h`` tells how near the centre a member is: x and y link
    when the differences share at least ``base - x.h - y.h`` hundredths times 1 / (100 + percent);
    ``first`` is the member of the largest h, ``other`` that of the largest in another part."""
    sides = [("a", "b"), ("b", "a")]
    rows = [
        compared.select(
            F.col(x).alias("doc_id"), F.col(f"{x}_s1").alias("s1"), F.col(f"{c}_s1").alias("fam"), "shared",
            (F.col("shared") + F.size(f"only_{x}")).alias("n"), (F.col("shared") + F.size(f"only_{c}")).alias("centre_n"),
        )
        for x, c in sides
    ]
    of = rows[0].unionAll(rows[1]).join(known.select("doc_id", "s1", "fam", "part"), ["doc_id", "s1", "fam"])
    of = of.withColumn("h", (100 + percent) * F.col("shared") - percent * F.col("n"))
    of = of.withColumn("base", (100 + percent) * F.col("centre_n")).drop("shared", "n", "centre_n")
    of = written(of, "members")
    place = F.struct("h", "s1", "doc_id", "part")
    first = of.groupBy("fam").agg(F.max(place).alias("first"), F.min("part").alias("x"), F.max("part").alias("y"))
    first = first.where("x != y").select("fam", "first")
    other = of.join(first, "fam").where("part != first.part").groupBy("fam").agg(F.max(place).alias("other"))
    of = written(of.join(first.join(other, "fam"), "fam"), "members-of-parts")
    # The differences are sent once, to the members that need them.
    own = compared.select("a_s1", "b_s1", F.concat("only_a", "only_b").alias("own"))
    ends = [F.least("s1", "fam").alias("a_s1"), F.greatest("s1", "fam").alias("b_s1")]
    return of.select("*", *ends).join(own, ["a_s1", "b_s1"]).drop("a_s1", "b_s1")


def family_links(of: DataFrame, percent: int) -> DataFrame:
    """Links (a, a_s1, b, b_s1) between members of a family in different parts, given by ``members``:
    one at least of every two parts, or both linked to the same third, wherever any links."""
    of = written(of, "members-placed")
    sure = of.where("part != first.part and h + first.h >= base")
    sure = sure.select(F.col("doc_id").alias("a"), F.col("s1").alias("a_s1"), F.col("first.doc_id").alias("b"), F.col("first.s1").alias("b_s1"))

    unit = 100 + percent
    best = F.when(F.col("part") != F.col("first.part"), F.col("first.h")).otherwise(F.col("other.h"))
    least = F.greatest(F.lit(1), F.ceil((F.col("base") - F.col("h") - best) / unit))
    elements = of.withColumn("least", least).where("size(own) >= least")
    elements = elements.select("fam", "s1", "part", "h", "base", "least", F.explode("own").alias("element"))
    open_lists = elements.groupBy("fam", "element").agg(F.count(F.lit(1)).alias("times"), F.min("part").alias("x"), F.max("part").alias("y"))
    elements = elements.join(open_lists.where("x != y").select("fam", "element", "times"), ["fam", "element"])
    # Only elements in more than one part count, rare ones first; the last least - 1 need not be met first.
    one = Window.partitionBy("s1")
    elements = elements.withColumn("place", F.row_number().over(one.orderBy("times", "element"))).withColumn("size", F.count(F.lit(1)).over(one))
    elements = written(elements.where("place <= size - least + 1").drop("times", "least"), "differences")
    right = elements.select("fam", "element", *[F.col(c).alias(f"{c}2") for c in ("s1", "part", "h", "place", "size")])
    asked = "(base - h - h2)"
    near = [f"{unit} * ({size} - {place} + 1) >= {asked}" for size, place in (("size", "place"), ("size2", "place2"))]
    met = elements.join(right, ["fam", "element"]).where(f"part < part2 and {asked} > 0 and {near[0]} and {near[1]}")
    met = met.select("s1", "s12").distinct()

    kept = of.select("s1", "doc_id", "part", "h", "base", "own")
    both = met.join(kept, "s1").join(kept.toDF(*[f"{c}2" for c in kept.columns]), "s12")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch["own"], batch["own2"])):
                together = np.concatenate((x.values.to_numpy(), y.values.to_numpy()))
                together.sort()
                shared[i] = (together[1:] == together[:-1]).sum()
            asked = batch["base"].to_numpy() - batch["h"].to_numpy() - batch["h2"].to_numpy()
            found = batch.filter(pa.array(unit * shared >= asked)).select(["doc_id", "s1", "doc_id2", "s12", "part", "part2"])
            yield pa.RecordBatch.from_arrays(found.columns, ["a", "a_s1", "b", "b_s1", "p", "q"])

    links = both.select("doc_id", "s1", "doc_id2", "s12", "part", "part2", "h", "h2", "base", "own", "own2").mapInArrow(
        compare, "a bigint, a_s1 bigint, b bigint, b_s1 bigint, p bigint, q bigint"
    )
    pair = F.struct("a", "a_s1", "b", "b_s1")
    return links.groupBy("p", "q").agg(F.min(pair).alias("x")).select("x.*").unionAll(sure)
