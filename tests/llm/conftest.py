import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lotwise.session import build_session

    s = build_session("llm-tests", cores="4", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Real documents and every awkward text: null, empty, white space, very long, repeated rows, clashing columns."""
    odd = [None, "", " ", "  a  b\n\tc ", "\n\nfoo \n bar  ", "don't 's x's ▁▁a ▁", "中文 テスト　全角  x\x1ey é ΣΑΣ", "\nfoo", "ab" * 20_000, "foo\n", " lead",
           "<s> </s> <|endoftext|>😀", "same words here again", "same words here again", "The SAME words here again"]
    extra = spark.createDataFrame([(9_000_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(extra)
    return both.selectExpr("doc_id", "text", "'en' AS lang", "CASE WHEN doc_id % 3 > 0 THEN concat('s', doc_id % 4) END AS source", "length(text) AS n_chars",
                           "1 AS size", "'x' AS shard", "2 AS id", "3 AS score").cache()


@pytest.fixture(scope="session")
def texts(odd_docs):
    return {r["doc_id"]: r["text"] or "" for r in odd_docs.select("doc_id", "text").collect()}
