"""Streams of pages are spread before a few bytes per order become a page."""

from pageaudit.registry.stream_queries import stream_view


def test_orders_are_spread_before_pages_are_made(spark):
    plan = stream_view(spark, "/root/testdata/sf0.001", "v_html", "orders")._jdf.queryExecution().analyzed().toString()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert "RepartitionByExpression [o_orderkey" in plan and f"], {n}" in plan
