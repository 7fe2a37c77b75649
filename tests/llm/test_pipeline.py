"""Every stage of the pipeline on odd rows, and the whole of it on a small table."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from trafficloom.llm import decontaminate, mixing
from trafficloom.llm.tables import BATCHES

STAGES = dict(corpus_pipeline.STAGES)
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word59", "other")
# Names used inside of stages and operators.
CLASHING = ["key", "row", "score", "lang_pred", "__row", "__key", "__id", "__name", "__size", "__copy", "__words", "c_text", "shard"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` bigint" for c in CLASHING)


def rows_of(*docs):
    return [(*d, len(d[1] or ""), *range(7, 7 + len(CLASHING))) for d in docs]


ODD = rows_of(
    (1, BASE, "en", "a"),
    (2, NEAR, "en", "a"),
    (2, "a quite different text that shares its id with another one", "en", "b"),
    (None, BASE.upper(), "en", "a"),
    (None, NEAR.replace("word0 ", "x "), "en", None),
    (None, "the text of a row without an id", None, "b"),
    (3, "the same row twice", "en", "b"),
    (3, "the same row twice", "en", "b"),
    (4, None, "de", None),
    (5, "", "de", None),
    (6, "", "de", "c"),
    (7, "Und die " * 20_000 + "Ende.", "de", "c"),
    (None, None, None, None),
)


@pytest.fixture(scope="module")
def odd(llm_spark):
    return llm_spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(llm_spark, sample, odd, nothing, name):
    for docs in (odd, nothing):
        found = STAGES[name](llm_spark, docs, sample)
        assert found.dtypes == docs.dtypes
        for r in found.collect():
            assert [r[c] for c in CLASHING] == list(range(7, 7 + len(CLASHING)))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_what_a_stage_returns_is_read_in_small_batches(llm_spark, sample, nothing, name):
    """A stage's frame is worked out after the stage has returned."""
    for setting in BATCHES:
        llm_spark.conf.unset(setting)
    found = STAGES[name](llm_spark, nothing, sample)
    assert {k: found.sparkSession.conf.get(k) for k in BATCHES} == BATCHES
    assert int(BATCHES["spark.sql.parquet.columnarReaderBatchSize"]) <= 512


def test_one_of_each_group_stays(llm_spark, sample, odd):
    found = STAGES["near_copies"](llm_spark, odd, sample)
    copies = {1, 3, 4, 7}  # a near copy, one with null id and upper case, a near copy with null id, an equal row
    assert counted(found.collect()) == counted(r for i, r in enumerate(ODD) if i not in copies)


def test_near_copies_of_the_small_table(llm_spark, sample):
    docs = llm_spark.read.parquet(f"{sample}/documents.parquet")
    groups = brute.components({r.doc_id: brute.shingles(r.text) for r in docs.collect()})
    found = STAGES["near_copies"](llm_spark, docs, sample)
    assert {r.doc_id for r in found.collect()} == set(groups.values()) and found.count() == len(set(groups.values()))


def test_only_the_leaking_text_goes(llm_spark, sample):
    items = llm_spark.read.parquet(f"{sample}/benchmark.parquet").where("text is not null").limit(1).collect()
    clean = "a text about nothing in particular that no test has asked for"
    docs = llm_spark.createDataFrame(rows_of((1, items[0].text, "en", "a"), (1, clean, "en", "a"), (None, clean, "en", "a"), (None, items[0].text, "en", "a"), (2, None, "en", "a")), SCHEMA)
    found = STAGES["decontamination"](llm_spark, docs, sample).collect()
    assert counted((r.doc_id, r.text) for r in found) == counted([(1, clean), (None, clean), (2, None)])


def test_leaks_do_not_depend_on_the_number_of_indexes(llm_spark, sample, monkeypatch):
    docs, items = (llm_spark.read.parquet(f"{sample}/{t}.parquet") for t in ("documents", "benchmark"))
    found = []
    for size in (50_000, 7):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", size)
        found.append(counted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(docs, items).collect()))
    assert found[0] and found[0] == found[1]


def test_mixing_takes_what_it_plans(llm_spark, sample, odd):
    found = STAGES["mixing"](llm_spark, odd, sample).collect()
    planned = mixing.mix_sources(odd).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    taken = collections.Counter()
    for r in found:
        taken[r.source] += len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert taken == collections.Counter({r.source: r.n for r in planned if r.n})


def test_tokens_of_odd_rows(llm_spark, sample, odd, nothing):
    found = STAGES["tokens"](llm_spark, odd, sample).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in ODD)
    assert STAGES["tokens"](llm_spark, nothing, sample).count() == 0


def test_the_whole_pipeline(llm_spark, sample):
    found = corpus_pipeline.run(llm_spark, sample).collect()
    docs = llm_spark.read.parquet(f"{sample}/documents.parquet")
    assert found and {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()}
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
