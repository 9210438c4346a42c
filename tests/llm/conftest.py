import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = " ".join(f"long{i}" for i in range(3000))
PASSAGE = "shared passage of words " * 25  # 600 bytes
EDGE = [
    (1, None, None, None, 7),
    (2, "", "en", "a", 7),
    (3, " \n\t ", "en", "a", 7),
    (4, "one", "en", "a", 7),
    (5, LONG, "en", "b", 7),
    (6, LONG, "en", "b", 7),
    (6, LONG, "en", "b", 7),
    (None, "no id here but some words of text", "fr", None, 7),
    (8, "first " + PASSAGE + " tail one", "de", "c", 7),
    (9, "other start " + PASSAGE + " another end", "de", "c", 7),
    (10, "<|x|> </s> [INST] \\l \\\\ <é>  two  spaces", "fr", "c", 7),
    (11, "a a a a a a a a a a a a a a a a a a a a a a", "fr", "c", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
