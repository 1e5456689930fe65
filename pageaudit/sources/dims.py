"""Small dimensions; each has a fixed number of rows and is safe to broadcast."""

from pyspark.sql import DataFrame, SparkSession

from pageaudit import fixed as X


def dim_rules(spark: SparkSession, profile: str = "default") -> DataFrame:
    """Rule catalogue. The client profile replaces confidence and severity where it has its own."""
    rows = []
    for rule_id, pattern, subs, methods, conf, sev, title, scope, state in X.RULES:
        if profile == "client":
            conf, sev = X.CLIENT_CONFIDENCE.get(rule_id, (conf, sev))
        rows.append((rule_id, pattern, subs, methods, conf, sev, title, scope, state))
    return spark.createDataFrame(
        rows,
        "rule_id string, pattern string, sub_signals array<string>, methods array<string>, "
        "confidence double, severity string, title string, scope string, requires_state boolean",
    )


def dim_patterns(spark: SparkSession) -> DataFrame:
    rows = [
        (i, p, name, sec, stages, X.DEFAULT_WEIGHT if w is None else w, d or X.DEFAULT_DIMENSION)
        for i, (p, name, sec, stages, w, d) in enumerate(X.PATTERNS)
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, pattern string, pattern_title string, section string, "
        "required_stages array<string>, weight int, dimension string",
    )


def dim_marketplaces(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(X.MARKETPLACES)]
    return spark.createDataFrame(rows, "ordinal int, marketplace string, display string, domain string")


def dim_source_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.SOURCE_WEIGHTS, "source string, weight double")
