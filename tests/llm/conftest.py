import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts or (doc_id, text) pairs, over three partitions."""

    def make(*rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def clashing():
    """Adds columns named like what the operators make up inside."""

    def add(df):
        from pyspark.sql import functions as F

        names = "ord mark runs deleted fp ids score spans tie hits h item text_hash leaf component_id".split()
        return df.withColumns({n: F.lit("x") for n in names})

    return add
