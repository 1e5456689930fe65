"""Rules that need several snapshots of the same page, or the state of a session."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.functions.text import first_group
from pageaudit.functions.windows import lag_in_ranges


def clock_seconds(text):
    """Seconds shown by the first h:mm:ss or m:ss clock of a text."""
    parts = F.split(F.regexp_extract(text, r"\d{1,2}:\d{2}(:\d{2})?", 0), ":")
    return F.when(
        F.size(parts) > 1, F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x.cast("bigint"))
    )


def timer_resets(snapshots: DataFrame) -> DataFrame:
    """Timers that do not run down although time has passed. Needs url, pos, captured_at, text."""
    s = snapshots.withColumn("shown", clock_seconds(F.col("text"))).where("shown is not null")
    lagged = lag_in_ranges(s, ["url", "pos"], ["captured_at", "page_id"], ["shown", "captured_at"])
    return lagged.where((F.col("shown") >= F.col("prev.shown")) & (F.col("captured_at") > F.col("prev.captured_at"))).select(
        "url", "pos", "page_id", F.col("prev.shown").alias("shown_before"), "shown"
    )


def stock_stalls(snapshots: DataFrame) -> DataFrame:
    """Low-stock figures that stay or rise between snapshots of a page. Needs url, captured_at, visible_text."""
    s = snapshots.withColumn("stock", first_group(F.col("visible_text"), r"\b(?:only|just)\s+(\d+)\s*(?:left|remaining|in stock|available)").cast("bigint"))
    s = s.where("stock is not null")
    lagged = lag_in_ranges(s, ["url"], ["captured_at", "page_id"], ["stock", "captured_at"])
    return lagged.where((F.col("stock") >= F.col("prev.stock")) & (F.col("captured_at") > F.col("prev.captured_at"))).select(
        "url", "page_id", F.col("prev.stock").alias("stock_before"), "stock"
    )


def unsolicited_items(cart: DataFrame, added: DataFrame, keys=("session_id", "item")) -> DataFrame:
    """Cart items nobody added, one row per session and item."""
    return cart.select(*keys).distinct().join(added.select(*keys).distinct(), list(keys), "left_anti")


def price_track(snapshots: DataFrame) -> DataFrame:
    """Sessions whose highest price rose by more than 20 from first to latest snapshot.

    Needs session_id, ts, seq and highest_price. Batch form of the streaming tracker.
    """
    at = F.struct("ts", "seq")
    g = snapshots.groupBy("session_id").agg(
        F.count("*").alias("n"), F.min_by("highest_price", at).alias("first_price"), F.max_by("highest_price", at).alias("latest_price")
    )
    d = F.col("latest_price") - F.col("first_price")
    return g.where((F.col("n") >= 2) & (F.col("first_price") > 0) & (F.col("latest_price") > 0) & (d > 20)).select(
        "session_id", "first_price", "latest_price", d.alias("delta"),
        F.least(F.lit(0.95), 0.75 + d / 1000).alias("confidence"), F.when(d > 150, "high").otherwise("medium").alias("severity"),
    )
