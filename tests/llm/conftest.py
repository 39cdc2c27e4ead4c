"""Tables that the tests of the operators share."""

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, EDGE, SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    # Names of extra columns that the operators use inside.
    return spark.createDataFrame(EDGE, DOC).withColumns({x: F.lit("x") for x in ("key", "score", "doc", "item", "pair", "same", "words", "the_text")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)
