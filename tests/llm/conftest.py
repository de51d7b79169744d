import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
#: A documents table with extra columns whose names clash with results and inner columns.
ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, id int, "
    "size string, copies string, code int, line_key string, whole_text string, ids string, kept string, n_tokens int"
)


def _prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


def odd_rows():
    extra = ("x", "y", 7, "z", "c", 3, "l", "w", "i", "k", 9)
    long_text = _prose(1, 60_000)
    base = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "b", 4),
        (4, "one", "en", None, 3),
        (5, long_text, "en", "a", len(long_text)),
        (6, long_text, "en", "b", len(long_text)),
        (7, _prose(2, 80) + "\n" + _prose(3, 60), "xx1", "b", 1),
        (8, _prose(2, 80) + "\n" + _prose(4, 60), "DE", "b", 1),
        (8, _prose(2, 80) + "\n" + _prose(4, 60), "DE", "b", 1),
        (None, _prose(2, 80), None, None, None),
        (9, "日本語 \U0001f600 é́ \x00 <|endoftext|> </s> \r\n ▁", "ja", "c", 1),
    ]
    return [(*row, *extra) for row in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [r.asDict() for r in documents.collect()]
