"""Every evidence query against its SQL on the driver's tables."""

from __future__ import annotations

import pandas as pd
import pytest

from evistrata import queries as core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql(spark, duck, sf_dir, same_rows, name):
    # Arrow keeps integers with nulls apart from doubles.
    same_rows(core.queries()[name](spark, sf_dir).toArrow().to_pandas(types_mapper=pd.ArrowDtype), duck.sql(core.oracle_sql()[name]).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype))


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, sf_dir, name):
    """Queries without SQL run whole; their operators are tested by value in test_operators."""
    df = core.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
