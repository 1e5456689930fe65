"""Text rules: what fires, and the scores that follow from a single finding."""

import pytest
from pyspark.sql import functions as F

from pageaudit.operators import rules, scores

# text, url, rule, risk score, points
VECTORS = [
    ("Only 3 left in stock", "https://a.com/p/1", "FU_SCARCITY_CLAIM", 15, 10),
    ("Selling out soon", "https://a.com/p/1", "FU_SCARCITY_CLAIM", 15, 10),
    ("Hurry, the sale ends tonight", "https://a.com/p/1", "FU_DEADLINE_TEXT", 15, 11),
    ("18 people are viewing this", "https://a.com/p/1", "FU_SOCIAL_PROOF", 20, 10),
    ("Free 7-day trial, later billed to your card", "https://a.com/p/1", "ST_CANCELLATION_BARRIER", 30, 17),
    ("You must install the viewer", "https://a.com/p/1", "FA_MANDATORY_DOWNLOAD", 45, 18),
    ("Convenience fee of ₹40", "https://a.com/cart", "DP_HIDDEN_FEE_CHECKOUT", 15, 16),
    ("Please do not uncheck this", "https://a.com/p/1", "TW_DOUBLE_NEGATIVE", 15, 12),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, str(i), "product", u, t) for i, (t, u, *_) in enumerate(VECTORS)]
    rows += [(100, "100", "product", "https://a.com/p/1", "Convenience fee of ₹40"),
             (101, "101", "cart", "https://a.com/checkout", "Platform fee. Pay now"),
             (102, "102", "product", "https://a.com/p/1", "A plain oak table"),
             (103, "103", "product", "https://a.com/p/1", "only 2 left")]
    df = spark.createDataFrame(rows, "page_id long, scan_id string, stage string, url string, visible_text string")
    from pageaudit.functions.text import plain_spaces
    return df.withColumn("visible_text", plain_spaces(F.col("visible_text")))


def test_rules_fire_and_score(spark, table):
    found = rules.detect_text(table)
    scans = table.select("scan_id", F.array("stage").alias("stages"))
    risk = {r.scan_id: r for r in scores.risk(found, scans).collect()}
    trans = {r.scan_id: r for r in scores.transparency(found, scans).collect()}
    by_scan = {r.scan_id: r.rules for r in found.groupBy("scan_id").agg(F.collect_set("rule_id").alias("rules")).collect()}
    for i, (_, _, rule, score, pts) in enumerate(VECTORS):
        assert by_scan[str(i)] == [rule]
        assert risk[str(i)].risk_score == score
        dims = [trans[str(i)][d] for d in scores.X.DIMENSIONS]
        assert sum(100 - d for d in dims) == pts
        assert trans[str(i)].transparency == 100 - round(pts * 0.5)
    assert "100" not in by_scan and "101" not in by_scan and "102" not in by_scan
    assert by_scan["103"] == ["FU_SCARCITY_CLAIM"]
    assert risk["102"].risk_level == "LOW" and risk["102"].risk_score == 0


def test_catalogue_only_rules(spark, table):
    df = spark.createDataFrame([(1, "https://a.com/x", "Shipping charge: ₹50. Shop unprotected.")], "page_id long, url string, visible_text string")
    got = {r.rule_id for r in rules.detect_text(df, extra=True).collect()}
    assert got == {"DP_MANDATORY_SHIPPING", "CS_FEAR_BASED_COPY"}


def test_clean_pages_are_kept_on_request(table):
    kept = rules.detect_text(table, keep_clean=True)
    assert kept.select("page_id").distinct().count() == table.count()


def test_explanations_quote_the_snippet(table):
    f = rules.detect_text(table)
    text = f.select("rule_id", rules.explanation(F.col("pattern"), F.col("sub_signals"), F.col("snippets")).alias("t")).collect()
    by_rule = {r.rule_id: r.t for r in text}
    assert "Only 3 left" in by_rule["FU_SCARCITY_CLAIM"] or "Selling out" in by_rule["FU_SCARCITY_CLAIM"] or "only" in by_rule["FU_SCARCITY_CLAIM"]
    assert all(by_rule.values())


@pytest.mark.parametrize("conf,n,tier", [(0.86, 2, "HIGH"), (0.95, 1, "MEDIUM"), (0.65, 2, "MEDIUM"), (0.69, 1, "LOW"), (0.70, 1, "MEDIUM")])
def test_tier(one, conf, n, tier):
    assert one(rules.confidence_tier(F.lit(conf), F.lit(n))) == tier


def test_coverage_by_stages(spark):
    none = spark.createDataFrame([], "scan_id string, pattern string")
    scans = spark.createDataFrame([("a", ["product"]), ("b", ["product", "cart"]), ("c", ["product", "cart", "checkout"])], "scan_id string, stages array<string>")
    empty = F.array().cast("array<string>")
    got = {r.scan_id: r.s for r in scans.select("scan_id", scores.coverage_score(empty, F.col("stages")).alias("s")).collect()}
    assert got == {"a": 15, "b": 31, "c": 100}
    rows = scores.coverage(none, scans).groupBy("scan_id", "status").count().collect()
    assert {(r.scan_id, r.status): r["count"] for r in rows}[("a", "EVALUATED_CLEAN")] == 2


def test_scores_do_not_depend_on_order(spark, table):
    f = rules.detect_text(table).withColumn("scan_id", F.lit("all"))
    scans = spark.createDataFrame([("all", ["product"])], "scan_id string, stages array<string>")
    a = scores.transparency(f, scans).first()
    b = scores.transparency(f.orderBy(F.rand(3)), scans).first()
    assert a == b


def test_gate_empties_a_scan_without_product(spark):
    s = spark.createDataFrame([("a", "HIGH", 90, "DETECTED", 38), ("b", "HIGH", 90, "DETECTED", 38)],
                              "scan_id string, risk_level string, risk_score long, verdict string, coverage_score long")
    g = spark.createDataFrame([("a", "ACCESS_OK", False), ("b", "FORBIDDEN", True)], "scan_id string, access string, product_reached boolean")
    got = {r.scan_id: r for r in scores.access_gate(s, g).collect()}
    assert (got["a"].risk_level, got["a"].risk_score, got["a"].verdict, got["a"].coverage_score) == ("UNDETERMINED", 0, "INCONCLUSIVE", 0)
    assert (got["b"].risk_level, got["b"].coverage_score) == ("UNDETERMINED", 38)
