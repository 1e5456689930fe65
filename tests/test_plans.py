"""End-to-end audits, streams next to their batch form, plan shapes and the checking SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, connect
from pageaudit.plans import audit
from pageaudit.registry.views import VIEWS
from pageaudit.streaming import operators as W

SF = "/root/testdata/sf0.001"
P0 = "<html><body><h1>Flight</h1><div class='fare'>Fare ₹4,890</div></body></html>"
P1 = """<html><body><div class="timer">09:59</div><label><input type=checkbox checked>Travel insurance ₹199</label><label><input type=checkbox checked>Carbon donation ₹99</label>
<div class="fee-row">Insurance & carbon add-ons ₹298</div><div class="total-row">Amount payable ₹5,188</div></body></html>"""
P2 = """<html><body><div class="fee-row">Insurance ₹199</div><div class="fee-row">Carbon offset ₹99</div><div class="fee-row">Convenience fee ₹450</div>
<div class="grand-total">Grand total ₹5,638</div></body></html>"""


def test_flight_journey_end_to_end(page):
    pages = page(("https://a.com/product/1", P0, "product"), ("https://a.com/cart", P1, "cart"), ("https://a.com/checkout", P2, "checkout"))
    out = audit.audit_journeys(pages)
    j = out["journeys"].first()
    assert (j.p0, j.p1, j.p2, j.delta_01, j.delta_12, j.delta_total, j.verdict) == (4890, 5188, 5638, 298, 450, 748, "DETECTED")
    assert sorted((r.component_type, float(r.amount)) for r in out["charges"].collect()) == [("convenience_fee", 450.0), ("donation", 99.0), ("protection", 199.0)]
    found = sorted(r.rule_id for r in out["findings"].collect())
    # two ticked boxes share pattern and title, so the scan keeps one
    assert found == ["BS_PRE_TICKED_CHECKBOX", "DP_HIDDEN_FEE_CHECKOUT", "DP_JOURNEY", "FU_COUNTDOWN_TIMER"]
    s = out["scans"].first()
    assert (s.risk_level, s.coverage_score, s.verdict) == ("HIGH", 100, "DETECTED")


def test_blocked_journey_is_undetermined(page):
    pages = page(("https://a.com/product/1", "<p>robot check</p>", "product"), ("https://a.com/cart", P1, "cart"))
    out = audit.audit_journeys(pages)
    s = out["scans"].first()
    assert (s.risk_level, s.risk_score, s.verdict, s.transparency) == ("UNDETERMINED", 0, "INCONCLUSIVE", 0)
    assert out["findings"].count() == out["charges"].count() == 0 and out["journeys"].first().verdict == "INCONCLUSIVE"


def test_only_visited_pages_are_audited(page, spark):
    timer = "<div class=timer>04:32</div>"
    pages = page(("https://a.com/1", timer), ("https://a.com/2", "<p>Chair</p>"), ("https://a.com/3", timer), (None, timer))
    links = spark.createDataFrame([("https://a.com/1", 0, "https://a.com/2")], "src_url string, seq int, dst_url string")
    starts = spark.createDataFrame([("a.com", "https://a.com/1")], "host string, url string")
    r = audit.audit_site(pages, links, starts).collect()
    assert [(x.host, x.pages_analyzed, x.total_findings, x.medium, x.patterns) for x in r] == [("a.com", 2, 1, 1, "FALSE_URGENCY")]


SCENARIOS = [
    ("clean", "<p>Chair ₹8,990</p><button>No</button>", None), ("urgency", "<div class=timer>04:32</div><p>Only 2 left in stock</p>", "FALSE_URGENCY"),
    ("sneaking", P1, "BASKET_SNEAKING"), ("shaming", "<button>No thanks, I hate saving money</button>", "CONFIRM_SHAMING"),
    ("interference", "<a href='/d' style='font-size: 9px; opacity: 0.1'>Decline</a>", "INTERFACE_INTERFERENCE"),
    ("subscription", "<div>Free 7-day trial. Automatic-recurring plan billed to your card. Strict no-refund.</div>", "SUBSCRIPTION_TRAP"),
    ("forced", "<div>You must install our app and grant access to your contacts.</div>", "FORCED_ACTION"),
    ("donation", "<input type=checkbox id=d checked><label for=d>Donation ₹10</label>", "BASKET_SNEAKING"),
]


def test_scenario_matrix(page, spark):
    from pageaudit.operators import element_rules, evaluate, structure
    pages = page(*[("https://a.com/x", h) for _, h, _ in SCENARIOS])
    patterns = sorted({p for *_, p in SCENARIOS if p})
    labels = spark.createDataFrame([(i, p, p == want or (i == 2 and p == "FALSE_URGENCY")) for i, (_, _, want) in enumerate(SCENARIOS) for p in patterns],
                                   "page_id long, pattern string, expected boolean")
    o = evaluate.outcomes(labels, element_rules.detect_all(structure.parse_pages(pages)))
    assert o.where("outcome in ('FP', 'FN')").collect() == []


def test_single_page_audit(page):
    r = audit.audit_pages(page(("https://a.com/product/1", P0), ("https://a.com/cart", P1)))
    got = {x.page_id: (x.risk_level, x.signals_found, x.coverage_score) for x in r.collect()}
    assert got[0] == ("LOW", 0, 15) and got[1][0] == "HIGH" and got[1][1] == 3


@pytest.mark.parametrize("kind", ["prices", "journeys"])
def test_stream_equals_batch_on_closed_sessions(spark, tmp_path, kind):
    rows = [(s, i, 600 * i + 50 * k) for k, s in enumerate("abc") for i in range(4)] + [("z", 99, 10**6)]
    df = spark.createDataFrame(rows, "scan_id string, seq long, sec long").select(
        "scan_id", F.col("scan_id").alias("session_id"), "seq", F.timestamp_seconds("sec").alias("ts"), (F.col("seq") * 100.0 + 1).alias("highest_price"),
        F.element_at(F.array(F.lit("PRODUCT_CAPTURED"), F.lit("CART_CAPTURED"), F.lit("CHECKOUT_CAPTURED"), F.lit("FAILED_INCONCLUSIVE")), (F.col("seq") % 4 + 1).cast("int")).alias("to_state"),
        F.lit("checkout").alias("stage"), F.lit(True).alias("verified"), F.col("seq").cast("decimal(14,2)").alias("price_observed"))
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    fn = W.track_prices if kind == "prices" else lambda df: W.track_journeys(df, "1 hour")
    key = "session_id" if kind == "prices" else "scan_id"
    batch = fn(spark.read.parquet(src)).where(F.col(key) != "z")
    stream = fn(spark.readStream.schema(df.schema).parquet(src))
    out = spark.read.schema(stream.schema).parquet(W.run_to_end(stream, str(tmp_path / "run")))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and out.count() == 3


def test_an_ended_stream_equals_the_batch(spark, tmp_path):
    """Nothing stays open behind the marker; pauses within a scan lose no state; late repeats are found with real times."""
    rows = [(s, i, 600 * i + (90_000 * i if s == "b" else 0)) for s in "abc" for i in range(5)] + [("d", 9, 7 * 10**5)]
    df = spark.createDataFrame(rows, "scan_id string, seq long, sec long").select(
        "scan_id", F.col("scan_id").alias("session_id"), "seq", F.timestamp_seconds("sec").alias("ts"), (F.col("seq") * 100.0 + 1).alias("highest_price"),
        F.element_at(F.array(F.lit("PRODUCT_CAPTURED"), F.lit("CART_CAPTURED"), F.lit("CHECKOUT_CAPTURED"), F.lit("FAILED_INCONCLUSIVE")), (F.col("seq") % 4 + 1).cast("int")).alias("to_state"),
        F.lit("checkout").alias("stage"), F.lit(True).alias("verified"), F.col("seq").cast("decimal(14,2)").alias("price_observed"), (F.col("seq") % 2).cast("string").alias("url"))
    src, end = str(tmp_path / "src"), str(tmp_path / "end")
    df.coalesce(1).write.parquet(src)
    W.write_end_marker(spark, end)
    stored, live = spark.read.parquet(src), lambda: W.with_end(spark.readStream.schema(df.schema).parquet(src), end)
    for k, fn in enumerate((W.track_journeys, W.track_prices)):
        stream = fn(live())
        out = spark.read.schema(stream.schema).parquet(W.run_to_end(stream, str(tmp_path / f"run{k}")))
        assert sorted(map(str, out.collect())) == sorted(map(str, fn(stored).collect())) and out.count() >= 2
    assert W.track_journeys(stored).count() == 4
    stream = W.first_captures(spark.readStream.schema(df.schema).parquet(src))
    out = spark.read.schema(stream.schema).parquet(W.run_to_end(stream, str(tmp_path / "dedup")))
    assert sorted(tuple(r) for r in out.select("session_id", "url").collect()) == sorted(tuple(r) for r in stored.select("session_id", "url").distinct().collect())


ALL = sorted(entry.queries())
SOME = ["q_shop_ranking", "a2_risk", "a4_coverage", "a5_dedup", "j6_verdict", "j9_fold", "j7_carryover_note", "n1_match_counts", "n3_price_inconsistency", "f6_offers", "f3_attributes",
        "k2_checkout_actions", "e4_access_status", "e6_action_tier", "h3_text_lines", "r_all_rules", "p12_components", "p15_ranked_price", "e9_reached", "q2_scan_scores", "n9_reachable",
        "w1_debounce", "w7_windowed_findings", "r14_timer_reset", "k7_lag"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ALL if os.environ.get("PAGEAUDIT_ALL") else SOME)
def test_checking_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_every_query_reads_given_tables_and_sql_keys_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all("{" in sql for sql in VIEWS.values())


@pytest.mark.parametrize("name", ["a2_risk", "a4_coverage", "j6_verdict", "n2_canonical_match", "a13_comparison_summary", "a8_listing_transparency", "k1_cart_actions"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = entry.queries()["j2_deltas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
