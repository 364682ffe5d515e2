import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns that clash with working names."""
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            for name in ("_id", "_KEY", "mark", "key", "n", "words", "removed", "lang", "score", "rule", "host"):
                df = df.withColumn(name, F.lit(7))
        return df
    return make
