import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pageaudit.session import local_session

    s = local_session("pageaudit-tests", "8", "4", "8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Builds a page table from (url, html[, stage]) items."""
    def make(*items, scan="s"):
        rows = [(i, scan, it[2] if len(it) > 2 else "product", it[0], it[1], None) for i, it in enumerate(items)]
        return spark.createDataFrame(rows, "page_id long, scan_id string, stage string, url string, html string, visible_text string")

    return make


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a Column on one row given as a dict."""
    def run(column, **values):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
        return df.select(column.alias("x")).first()[0]

    return run
