"""Every registered query against DuckDB on whole tables."""

import pytest

import __spark_entry__ as entry_points
from colloquy.plans import PLANS
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship_anchor(spark):
    """Totals at limit 512 that are known from an independent computation."""
    from pyspark.sql import functions as F

    from colloquy.plans.supervised import sequence_fit_at

    names = ("rows_total", "rows_truncated", "tokens", "supervised_tokens", "id_sum")
    got = sequence_fit_at(spark, "/root/testdata/sf0.01", 512).agg(*[F.sum(n) for n in names])
    assert tuple(got.first()) == (233, 222, 118077, 107159, 2024552)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    from colloquy.operators.examples import single_turn
    from colloquy.operators.tokenization import tokenize
    from colloquy.plans.supervised import SPEC

    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")

    def rows(df):
        out = tokenize(single_turn(df, 300), SPEC).select("example_id", "input_ids", "prompt_len")
        return sorted(map(tuple, out.collect()))

    assert rows(turns.repartition(parts)) == rows(turns)
