from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.shared import small_batches

from . import brute

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_operators_leave_the_session_as_it_is(spark):
    given = spark.conf.get(NAME)
    docs = brute.documents(spark, [(1, "a b c"), (2, "a b c")])
    assert near_duplicates(docs).count() == 2 and pack(docs).count() == 2
    assert spark.conf.get(NAME) == given
    try:
        with small_batches(spark):
            assert int(spark.conf.get(NAME)) <= 2000
            raise ValueError
    except ValueError:
        assert spark.conf.get(NAME) == given
