import os

import pytest

DATA = "/root/testdata/sf0.001"

#: Rows that every text operator must bear: nulls, empty and blank texts, repeats, very long words, clashing columns.
EDGES = [None, "", " ", "\n\n", "a", "a b", "é" * 70, "x" * 5000, "the same words again " * 40, "\x00\x01", "tab\tand\nline\r\nend", "日本語 テキスト 😀 " * 20, " lead and trail "]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, f"s{i % 2}", "kept", i) for i, t in enumerate(EDGES)]
    rows += [(100, rows[8][1], "s0", "kept", 1), (None, "a null id has a text of its own here", "s1", "kept", 2), (101, "repeated row", "s1", "kept", 3), (101, "repeated row", "s1", "kept", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int")


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
