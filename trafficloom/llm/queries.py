"""The registered queries of the operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from trafficloom.llm import (
    bloom_lm,
    chat,
    collocations,
    decontaminate,
    divergence,
    langid,
    licenses,
    line_chunks,
    mixing,
    quality,
    set_join,
    sharding,
    token_files,
)
from trafficloom.llm.tables import ship_package, table

# The vocabulary of the token files; its place is the library's, never a copy of ours.
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


MIX_SQL = r"""WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS rnd FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM weighed),
offered AS (SELECT a.source, a.source_size, a.weight,
    3 * a.source_size * (sum(b.weight) FILTER (b.place >= a.place))
      < a.weight * (sum(b.source_size) - 3 * coalesce(sum(b.source_size) FILTER (b.place < a.place), 0)) AS capped
  FROM ranked a CROSS JOIN ranked b GROUP BY a.source, a.source_size, a.weight, a.place),
shared AS (SELECT sum(source_size) - 3 * coalesce(sum(source_size) FILTER (capped), 0) AS free,
    sum(weight) FILTER (NOT capped) AS weights FROM offered),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * free AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM offered, shared),
placed AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.rnd, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(floor(t.target) AS BIGINT) AS budget
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CAST(budget // greatest(source_size, 1) AS BIGINT) AS epochs,
  CAST(least(greatest(budget - budget // greatest(source_size, 1) * source_size - before, 0), size) AS BIGINT) AS extra,
  CAST(budget // greatest(source_size, 1) * size
    + least(greatest(budget - budget // greatest(source_size, 1) * source_size - before, 0), size) AS BIGINT) AS taken
FROM placed"""


@query("op2_source_mix", MIX_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def _respelled_sql(words: str) -> str:
    words = f"' ' || {words} || ' '"
    for old, new in licenses.SPELLING.items():
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return f"trim({words})"


LICENSE_SQL = f"""WITH known(digest, license) AS (VALUES {', '.join(f"('{d}', '{n}')" for d, n, _ in licenses.known_digests())}),
split AS (SELECT doc_id, list_transform(string_split(lower("text"), chr(10)), lambda x:
    CASE WHEN regexp_matches(x, '{licenses.COPYRIGHT_LINE}') THEN ''
      ELSE trim(regexp_replace(x, '{licenses.NOT_WORD}', ' ', 'g')) END) AS lines FROM documents WHERE "text" IS NOT NULL),
parts AS (SELECT doc_id, CAST(NULL AS INTEGER) AS line, array_to_string(list_filter(lines, lambda x: x != ''), ' ') AS part FROM split
  UNION ALL SELECT doc_id, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER), unnest(lines) FROM split)
SELECT doc_id, line, license FROM (SELECT doc_id, line, {_respelled_sql("part")} AS words FROM parts WHERE part != '') p
JOIN known ON digest = sha256(words)"""


@query("op6_license_scan", LICENSE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_table(spark))


def id_fold(folds: int) -> Column:
    """The fold of a document: crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


@query("op10_language")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, id_fold(4) != 2)
    found = langid.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_token_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_digests(docs, public_tokenizers.path(VOCABULARY))


@query("op8_jaccard_join")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_benchmark_leaks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_bloom_scores")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bloom_lm.score_documents(docs, id_fold(5) != 1)
    return found.withColumn("held_out", id_fold(5) == 1)


@query("op3_quality_rules")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


@query("op4_line_chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_runs(table(spark, sf_dir, "documents"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns as raw transcript rows (conv_id, seq, text, role): each conversation has a style
    of markers, by hash, and about one turn in six has none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    named = {"system": ("System", "SYSTEM", "system", "Context"), "user": ("User", "HUMAN", "user", "Q")}
    marks = []
    for kind, shape in enumerate(("{}: ", "### {}:\n", "<|{}|>\n", "**{}:** ")):
        other = ("Assistant", "AI", "assistant", "A")[kind]
        speaker = F.when(F.col("role") == "system", named["system"][kind]).when(F.col("role") == "user", named["user"][kind])
        left, right = shape.split("{}")
        marks.append(F.concat(F.lit(left), speaker.otherwise(other), F.lit(right)))
    mark = F.get(F.array(*marks), style.cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0
    text = F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", F.col("turn").alias("seq"), text.alias("text"), "role")


@query("op1_chat_turns")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_transcripts(table(spark, sf_dir, "conversations"))
    return chat.format_transcripts(rows, chat.fit(rows))


# A byte at a time: eight steps of the polynomial for each of 256 bytes make the table.
CRC_TABLE_SQL = """SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"""

SHARD_SQL = f"""WITH steps AS ({CRC_TABLE_SQL}),
sized AS (SELECT doc_id, CAST(coalesce(strlen("text"), 0) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(coalesce("text", ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, steps),
placed AS (SELECT *, row_number() OVER w AS n, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER () AS total FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
sharded AS (SELECT *, CAST(8 * (2 * start + size) // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded"""


@query("op11_shards", SHARD_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "size",
        sharding.text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_LOWER_SQL = "translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

AUDIT_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counted USING (lang, source) GROUP BY lang, source),
lang_totals AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (CAST(total AS HUGEINT) + 2 * v) AS p
  FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (CAST(total AS HUGEINT) + 2 * v) AS q FROM lang_totals JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS "value"
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS "value" FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item) AS "rank" FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST("value" AS BIGINT) AS "value", CAST("rank" AS INTEGER) AS "rank" FROM ranked WHERE part = 'pair' OR "rank" <= 10"""


@query("op12_source_audit", AUDIT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


PHRASE_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(w) AS g, 1 AS size FROM split
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM split
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM split),
counts AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY lang, size, g),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, g, f, string_split(g, ' ') AS w FROM counts WHERE f >= 10),
cuts AS (SELECT lang, size, g, f, w, unnest(range(1, size)) AS k FROM often WHERE size > 1),
scored AS (SELECT c.lang, c.size, c.g, c.w, c.k, c.f AS a, x.f AS l, y.f AS r,
    CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g, f FROM often WHERE size = 3),
dropped AS (SELECT lang, g, max(f) AS f FROM longer GROUP BY lang, g),
alone AS (SELECT lowest.* FROM lowest LEFT JOIN dropped d ON d.lang = lowest.lang AND d.g = lowest.g AND size = 2
  WHERE d.f IS NULL OR 100 * d.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS "rank" FROM alone)
SELECT lang, "rank", g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE "rank" <= 2000"""


@query("op13_phrases", PHRASE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))
