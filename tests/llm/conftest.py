import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import text  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeated rows, short and long texts."""
    long = text(1, 20_000)
    near = text(2).split()
    near[30] = "changed"
    return [(1, text(1)), (2, text(2)), (3, text(2)), (4, " ".join(near)), (5, ""), (6, None), (None, text(3)),
            (7, " \n\t "), (8, "one two three"), (9, "one two three"), (10, long), (10, long), (11, long + " end"),
            (None, None), (12, "x" * 50_000), (13, text(4) + "\n" + text(4)), (14, "çé " + text(5))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows as documents, with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("doc_id", "text", "'en' AS lang", "if(doc_id % 2 = 0, 'b', if(doc_id is null, null, 'a')) AS source",
                         "0L AS n_chars", "1 AS size", "2 AS shard", "'x' AS tkey", "3 AS row", "4 AS key", "5 AS component",
                         "6 AS rid", "7 AS score", "8 AS taken", "9 AS pid")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
