import pytest

SF = "/root/testdata/sf0.001"
#: documents with names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rec string, size long, digest string, h long, key string, fp long, copies int"
LONG = "lorem ipsum dolor sit amet consetetur " * 20_000


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), "rec", 1, "d", 2, "k", 3, 4)


EDGE = [
    row(1, None),
    row(2, ""),
    row(3, " \t\n\x0b\x0c\r"),
    row(4, "one"),
    row(5, "o n e"),
    row(6, "o n e"),
    row(7, LONG, None),
    row(8, LONG + "more", None),
    row(9, "the cat sat on the mat and then it slept all day"),
    row(9, "the cat sat on the mat and then it slept all day"),
    row(None, "the cat sat on the mat and then it slept all day", "t"),
    row(None, None, "t"),
    row(10, "a<|endoftext|>b \U0001f469‍\U0001f467 日本語 \x1c ʼn don't", "é"),
    row(11, "\x00 x \x00", "z", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
