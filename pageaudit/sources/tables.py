"""Page-snapshot source and access to stored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageaudit.functions.text import host_of, plain_spaces

SNAPSHOT_COLUMNS = {
    "page_id": "bigint", "scan_id": "string", "stage": "string", "captured_at": "timestamp",
    "url": "string", "html": "string", "visible_text": "string", "title": "string",
    "http_status": "int", "error_message": "string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_snapshots(df: DataFrame) -> DataFrame:
    """Any page table as snapshots; columns it lacks become NULL."""
    cols = [
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SNAPSHOT_COLUMNS.items()
    ]
    return (
        df.select(*cols)
        .withColumn("host", host_of("url"))
        .withColumn("visible_text", plain_spaces(F.col("visible_text")))
    )


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored snapshots in parquet, ORC or JSON lines."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(", ".join(f"{c} {t}" for c, t in SNAPSHOT_COLUMNS.items()))
    return as_snapshots(reader.format(fmt).load(path))
