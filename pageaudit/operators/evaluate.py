"""Evaluation of findings against labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """Outcome per label (page_id, pattern, expected): TP, FP, FN or TN."""
    hit = findings.select("page_id", "pattern").distinct().withColumn("found", F.lit(True))
    j = labels.join(hit, ["page_id", "pattern"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    kind = (
        F.when(F.col("expected") & F.col("found"), "TP").when(~F.col("expected") & F.col("found"), "FP")
        .when(F.col("expected"), "FN").otherwise("TN")
    )
    return j.withColumn("outcome", kind)


def matrix(outcome_rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and pass rate, in percent with one decimal, per key."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    good = F.count_if(F.col("outcome").isin("TP", "TN"))
    return outcome_rows.groupBy(*keys).agg(
        of("TP").alias("tp"), of("FP").alias("fp"), of("FN").alias("fn"), of("TN").alias("tn"),
        (F.floor(good / F.count("*") * 1000 + 0.5) / 10).alias("pass_rate"),
    )


def count_check(labelled: DataFrame, findings: DataFrame) -> DataFrame:
    """Labelled pages (page_id, expected_count) next to the number of findings they raise."""
    n = findings.groupBy("page_id").agg(F.count("*").alias("actual_count"))
    return labelled.join(n, "page_id", "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0))).withColumn(
        "as_expected", F.col("actual_count") == F.col("expected_count")
    )
