import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def table(spark):
    """A DataFrame of (doc_id, text) rows with extra columns whose names clash with internal ones."""

    def make(rows, *clashing):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        for name in clashing:
            df = df.selectExpr("*", f"'mine' as {name}")
        return df

    return make

