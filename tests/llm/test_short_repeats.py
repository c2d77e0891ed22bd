"""Windows that repeat inside one short text."""

import pytest

from chainloom.llm import substring_dedup
from tests.llm import plain


@pytest.mark.parametrize("text", ["a " * 30, "a b " * 12, "é " * 22, "a " * 21, "a " * 20])
def test_one_short_text_that_repeats_itself(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    [row] = substring_dedup.substring_dedup(df).collect()
    assert row.n_removed == len(plain.repeated([(1, text)], 20)[0])
    assert (row.n_removed > 0) == (len(text.split()) > 20)
