import pytest

from trafficloom.llm.tables import ship_package

LONG = "Und die " * 60_000 + "Ende."
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
# Null and empty texts, null ids and sources, repeated rows, ties, a very long text, and
# columns that bear the names operators use inside.
ROWS = [
    (1, PASSAGE + "\nand more\nlines here", "en", "a", 1, "x"),
    (2, PASSAGE + "\nand more\nlines here", "en", "a", 1, "x"),
    (3, PASSAGE.upper() + "\nand more\nlines here", None, "b", None, None),
    (4, None, "en", "b", None, "x"),
    (5, "", "de", None, 0, "x"),
    (6, " \n\t\n ", "de", None, 0, "x"),
    (7, LONG, "de", "b", 1, "x"),
    (8, "word", None, None, 1, "x"),
    (9, "Licensed under the Apache licence, version 2.0", "en", "a", 1, "x"),
    (9, "Licensed under the Apache licence, version 2.0", "en", "a", 1, "x"),
    (None, "naïve 你好 12 " + PASSAGE, "en", "a", 1, "x"),
    (None, None, None, None, None, None),
    (10, "\U0001f600 ??? 123", None, "c", 1, "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score bigint, key string"


@pytest.fixture(scope="session")
def llm_spark(spark, tmp_path_factory):
    ship_package(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm_spark):
    return llm_spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(llm_spark):
    """The smallest given tables."""
    return "/root/testdata/sf0.001"
