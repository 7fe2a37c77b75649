"""Quality rules by hashed n-gram likelihood ratios. Column expressions only.

N-grams (n = 1, 2) of word shapes are hashed into a fixed number of slots. Two
multinomials over the slots, one of trusted documents and one of the whole
corpus, give each slot a log ratio. A document's score is the mean of the
ratios of its n-grams, and it is kept if that is not below a fixed threshold.
Before that come counting rules that need no model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.once import compute_once
from trafficloom.llm.tables import WORD, written

SLOTS = 1 << 14
# Added to each slot's count in both multinomials.
SMOOTHING = 1.0
# Mean log ratio (natural) below which a document is not like the trusted ones.
THRESHOLD = -0.05
# Trusted documents learned from, at most: those of smallest hash.
TRUSTED_ROWS = 20_000
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
_SPACE = r"[\x20\x09-\x0D]"


def shapes(text: Column) -> Column:
    """The words of a text by their looks: two or more capitals are AA, digits 9, runs of other letters a.

    What a ratio of such n-grams finds is how a text is written (signs, case,
    tables), which holds for words that no one has seen before.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Z]{2,}", "AA")
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), r"[a-z\x{80}-\x{10FFFF}]+", "a")
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def slots_of(shapes: Column) -> Column:
    """The slots of a text's shapes and of its pairs of shapes."""

    def slot(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")

    singles = F.transform(shapes, lambda s: slot(s))
    rest = F.slice(shapes, F.lit(2), F.greatest(F.size(shapes) - 1, F.lit(0)))
    pairs = F.zip_with(rest, F.slice(shapes, F.lit(1), F.size(rest)), lambda b, a: slot(a, b))
    return F.concat(singles, pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(slot, ratio) for every slot that the corpus has: log of trusted over corpus share.

    Without any trusted n-gram all ratios are 0.
    """
    chosen = trusted.select("doc_id").where("doc_id is not null").distinct()
    # At most TRUSTED_ROWS ids, so they can be broadcast.
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS).withColumn("chosen", F.lit(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
    texts = compute_once(texts, "shapes", shapes(F.col("text")))
    parts = texts.select(F.coalesce("chosen", F.lit(0)).alias("chosen"), F.explode(slots_of(F.col("shapes"))).alias("slot"))
    counts = parts.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("chosen").alias("t"))
    # One row per slot, SLOTS at most.
    counts = written(counts, "quality-slots")
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    if not total["t"]:
        return counts.select("slot", F.lit(0.0).alias("ratio"))
    share = (F.col("t") + SMOOTHING) / (total["t"] + SMOOTHING * SLOTS)
    return counts.select("slot", F.log(share / ((F.col("n") + SMOOTHING) / (total["n"] + SMOOTHING * SLOTS))).alias("ratio"))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = compute_once(docs, "words", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("words")
    # Windows of five words as one hash each; two of 64 bits meet by chance in no real text.
    window = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    df = compute_once(df, "windows", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # Only where some window repeats: windows in order of hash, each with its place.
    in_order = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<w:bigint,i:int>>")
    df = compute_once(df.withColumn("n_words", n.cast("long")), "ordered", F.when(repeats, in_order).otherwise(none))
    size = F.size("ordered")
    following = F.slice("ordered", F.lit(2), F.greatest(size - 1, F.lit(0)))
    like_next = F.zip_with("ordered", following, lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False)))
    df = compute_once(df, "like_next", like_next)
    like_last = F.concat(F.array(F.lit(False)), F.slice("like_next", F.lit(1), F.greatest(size - 1, F.lit(0))))
    twice = F.zip_with("like_next", F.when(size > 0, like_last).otherwise(F.array().cast("array<boolean>")), lambda a, b: a | b)
    places = F.zip_with("ordered", twice, lambda o, t: F.when(t, o["i"]))
    df = compute_once(df, "places", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    after = F.slice("places", F.lit(2), F.greatest(F.size("places") - 1, F.lit(0)))
    # A window adds the words up to the next repeated one, five at most.
    covered = F.zip_with("places", after, lambda p, q: F.coalesce(F.least(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = compute_once(df, "lines", lines)
    return df.select(
        *docs.columns,
        "n_words",
        (F.length(text) - F.regexp_count(text, F.lit(_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda total, c: total + c).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row.

    ``trusted`` has the doc_ids of documents to be like. ``base_failed`` is
    true below 10 words, or where more than 20 % of the words are in repeated
    windows; else the mean log ratio of the whole text's n-grams decides. A
    null text is empty, has score 0 and fails; repeated rows are judged alike;
    without trusted documents every score is 0. Other columns are ignored; an
    empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted)
    # One value: the ratio of every slot, in order.
    every = ratios.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(ratios, "slot", "left").select("slot", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    weights = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "ratio"))), lambda p: p["ratio"]).alias("w"))
    counted = base_counts(docs.select("doc_id", "text"))
    counted = compute_once(counted, "shapes", shapes(F.col("text")))
    counted = compute_once(counted, "slots", slots_of(F.col("shapes")))
    counted = counted.withColumn("weights", weights.scalar())
    total = F.aggregate("slots", F.lit(0.0), lambda s, i: s + F.get("weights", i))
    score = F.when(F.size("slots") > 0, total / F.size("slots")).otherwise(F.lit(0.0))
    judged = compute_once(counted, "score", score)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "score",
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
