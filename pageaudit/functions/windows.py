"""Window helpers that survive hot keys."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageaudit.session import written

from pageaudit.session import written


def top_k(df: DataFrame, partition_cols, order_cols, k: int, rank="rank") -> DataFrame:
    """The k first rows per group.

    Spark prunes each map partition to k rows per group before the shuffle, so
    a hot group never reaches a task whole.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lag_in_ranges(df: DataFrame, keys, order, fields) -> DataFrame:
    """Adds ``prev``: the struct of ``fields`` of the preceding row of the same key in the given order.

    A plain lag sorts all rows of a key in one task. Here the rows are cut into ranges of (key, order) of even size, so a key
    with many rows, be they of one second, is spread over tasks. Inside a range the lag is a window, and the first row of a
    key in a range takes the key's last row of the range before; that step sees one row per key and range only. The input
    is evaluated once; null keys are a key of their own.
    """
    key, value, lead = F.struct(*keys), F.struct(*fields), F.struct(*order)
    once = written(df.withColumn("_key", key), "lag-rows")
    cut = written(once.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()), "lag-ranges")
    inner = Window.partitionBy("_key", "_range").orderBy(*order)
    rows = cut.withColumn("_prev", F.lag(value).over(inner)).withColumn("_n", F.row_number().over(inner))
    ends = cut.groupBy("_key", "_range").agg(F.max_by(value, lead).alias("_last"))
    heads = ends.select("_key", "_range", F.lag("_last").over(Window.partitionBy("_key").orderBy("_range")).alias("_before"))
    out = rows.join(heads, ["_key", "_range"], "left")
    prev = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev"))
    return out.withColumn("prev", prev).drop("_key", "_range", "_prev", "_n", "_before")


def crowded_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """The values of ``key`` that more than ``most`` rows share, as a written table: a row for each ``most`` rows of ``df`` at the utmost."""
    return written(df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key), "crowded")
