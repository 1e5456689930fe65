"""Report sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_report(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested row per scan.

    Findings must be deduplicated per scan, pattern and title before: then a
    scan holds at most one finding per rule and the nested list stays short.
    Unbounded parts (components, transitions) are written as their own tables.
    """
    item = F.struct("pattern", "title", "confidence", "confidence_tier", "severity", "snippets")
    nested = findings.groupBy("scan_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    return scans.join(nested, "scan_id", "left")


def write_scan_report(report: DataFrame, path: str, date_col="scan_date") -> None:
    report.write.mode("overwrite").partitionBy(date_col).parquet(path)


def audit_log(*steps: DataFrame) -> DataFrame:
    """Log rows (scan_id, step, stage, message) from any number of step tables."""
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def log_step(df: DataFrame, step: int, stage: str, message) -> DataFrame:
    return df.select("scan_id", F.lit(step).alias("step"), F.lit(stage).alias("stage"), message.alias("message"))


def write_audit_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def write_site_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
