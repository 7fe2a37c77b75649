"""Licence scan by canonical digest: entire texts are normalised, hashed and joined
to the digests of known licences. Column expressions only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.functions.once import compute_once
from trafficloom.llm.license_texts import EQUIVALENT, NOTICES, full_texts

# Words after "copyright" at which a sentence of a licence goes on; any other word is a year, a sign or a holder.
PROSE = (
    "also", "and", "are", "disclaimer", "doctrines", "holder", "holders", "if", "interest", "law", "laws", "license",
    "like", "line", "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "patent", "permission",
    "resulting", "statement", "those", "treaty",
)
_ASCII_SIGNS = r"\x00-/:-@\[-`{-\x7f"


def none_of(words: tuple[str, ...], start: bool = True) -> str:
    """A pattern, without lookahead, of a lower-case word that is none of the given ones."""
    first = "".join(sorted({w[0] for w in words if w}))
    parts = [f"[^{_ASCII_SIGNS}{first}][^{_ASCII_SIGNS}]*"]
    parts += [c + none_of(tuple(w[1:] for w in words if w[:1] == c), False) for c in first]
    return "(" + "|".join(parts if start or "" in words else [*parts, ""]) + ")"


# Lines that name a year or a copyright holder; they differ from copy to copy.
COPYRIGHT_LINE = rf"^[^a-z0-9]*(copyright[^a-z0-9]*{none_of(PROSE)}([^a-z0-9]|$)|\(c\)|©|all rights reserved)"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
SPELLING = {"licence": "license", "licenced": "licensed", **EQUIVALENT}
# A table of known licences is broadcast up to this many digests, else joined by shuffle.
BROADCAST_DIGESTS = 100_000


def respelled(words: Column) -> Column:
    """Equivalent spellings as one, word for word."""
    words = F.concat(F.lit(" "), words, F.lit(" "))
    for old, new in SPELLING.items():
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(words)


def word_lines(text: Column) -> Column:
    """The words of each line of a text, lower-case and one space apart; '' for copyright lines."""

    def words(line: Column) -> Column:
        spaced = F.trim(F.regexp_replace(line, NOT_WORD, " "))
        return F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(spaced)

    return F.transform(F.split(F.lower(text), "\n"), words)


def canonical_text(text: str) -> str:
    """The canonical form of one text, to make the table of known digests: words of all
    lines but copyright lines, respelled, one space apart."""
    lines = [x for x in text.lower().split("\n") if not re.search(COPYRIGHT_LINE, x)]
    spaced = f" {re.sub('[^a-z0-9\x80-\U0010ffff]+', ' ', chr(10).join(lines)).strip(' ')} "
    for old, new in SPELLING.items():
        spaced = spaced.replace(f" {old} ", f" {new} ")
    return spaced.strip(" ")


def known_digests(texts: Mapping[str, str] | None = None) -> list[tuple[str, str, int]]:
    """(digest, licence, number of words) of the given texts, or of the built-in ones and notices."""
    pairs = [(t, name) for name, t in texts.items()] if texts else full_texts()
    if texts is None:
        pairs += list(NOTICES.items())
    forms = {canonical_text(t): name for t, name in pairs}
    return sorted((hashlib.sha256(f.encode()).hexdigest(), name, f.count(" ") + 1) for f, name in forms.items())


def known_table(spark: SparkSession, texts: Mapping[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(known_digests(texts), "digest string, license string, words int")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Texts and single lines whose canonical form is a known licence: (doc_id, line, license).

    ``line`` is null where the whole text matched, else its number from 1. A
    text of one line that matches gives both rows. ``known`` is (digest,
    license, words), one row per digest; only parts with as many words as some
    known text are hashed, as no other can match. Null and empty texts, and
    lines without letters or digits, match nothing; repeated rows give
    repeated results. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", word_lines(F.col("text")).alias("lines"))
    texts = compute_once(texts.select("doc_id", "lines"), "parts", F.col("lines")).select("doc_id", "parts")
    whole = F.array_join(F.filter("parts", lambda words: words != ""), " ")
    parts = F.concat(F.array(whole), F.col("parts"))
    found = texts.select("doc_id", F.posexplode(parts).alias("line", "part")).where("part != ''")
    # One row per number of words: as many as the longest known text has at most.
    sizes = [r["words"] for r in known.select("words").distinct().collect()]
    count = F.length("part") - F.length(F.replace(F.col("part"), F.lit(" "), F.lit(""))) + 1
    found = found.where(count.isin(sizes))
    found = found.select(
        "doc_id",
        F.when(F.col("line") > 0, F.col("line")).alias("line"),
        F.sha2(respelled(F.col("part")), 256).alias("digest"),
    )
    if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        known = F.broadcast(known)
    return found.join(known, "digest").select("doc_id", "line", "license")
