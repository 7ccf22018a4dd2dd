"""The operators that are to use built-in functions only do so; scoring and encoding shuffle nothing."""

import pytest

from shutterloom.llm import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_fingerprints", "op10_url_rules"])
def test_no_python(spark, sf, name):
    text = plan(queries.queries()[name](spark, sf))
    assert not any(p in text for p in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op5_toxicity", "op8_byte_bpe"])
def test_no_shuffle(spark, sf, name):
    assert "Exchange" not in plan(queries.queries()[name](spark, sf))


def test_only_needed_columns_are_read(spark, sf):
    assert "html" not in plan(queries.op10_url_rules(spark, sf))
    assert "lang" not in plan(queries.op4_fingerprints(spark, sf))


def test_mixing_shuffles_no_texts(spark, sf):
    assert "Exchange hashpartitioning" not in plan(queries.op2_mixing(spark, sf))
