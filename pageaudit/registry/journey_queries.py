"""Queries over purchase journeys and event-shaped state."""

from pyspark.sql import functions as F

from pageaudit.functions import text as T
from pageaudit.functions.windows import lag_in_ranges
from pageaudit.operators import journey as J
from pageaudit.operators import scores, state
from pageaudit.registry.base import query
from pageaudit.registry.views import EV_K, SCAN_OF_EVENT, view
from pageaudit.sources.tables import table

WIDE = """w AS (SELECT scan_id, max(total) FILTER (WHERE stage = 'product' AND is_captured) AS p0,
  max(total) FILTER (WHERE stage = 'cart' AND is_captured) AS p1, max(total) FILTER (WHERE stage = 'checkout' AND is_captured) AS p2,
  bool_or(stage = 'cart') AS cart_reached, bool_or(stage = 'checkout') AS checkout_reached FROM v_stages GROUP BY scan_id),
 dl AS (SELECT *, CASE WHEN p0 IS NULL OR p1 IS NULL THEN NULL ELSE greatest(0, p1 - p0) END AS delta_01,
  CASE WHEN p1 IS NULL OR p2 IS NULL THEN NULL ELSE greatest(0, p2 - p1) END AS delta_12,
  CASE WHEN p0 IS NOT NULL AND p2 IS NOT NULL THEN greatest(0, p2 - p0) WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN greatest(0, p1 - p0) END AS delta_total FROM w)"""
PCT = "CASE WHEN delta_total IS NULL THEN NULL WHEN p0 > 0 THEN floor(delta_total::DOUBLE / p0::DOUBLE * 100 * 10 + 0.5) / 10 ELSE 0 END"
LEDGER = """c0 AS (SELECT *, CASE stage WHEN 'product' THEN 0 WHEN 'cart' THEN 1 ELSE 2 END AS ord FROM v_components WHERE NOT is_aggregate),
 lg AS (SELECT scan_id, component_type, amount, min(ord) FILTER (WHERE ord > 0) AS fo, max(ord) FILTER (WHERE ord > 0) AS lo,
  count(*) FILTER (WHERE ord > 0) - 1 AS carried, bool_or(ord = 0) AS previously_disclosed FROM c0 GROUP BY scan_id, component_type, amount
  HAVING count(*) FILTER (WHERE ord > 0) > 0),
 fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, component_type, amount ORDER BY ord, seq) AS rn FROM c0 WHERE ord > 0) x WHERE rn = 1),
 led AS (SELECT lg.*, fr.label, fr.selected_by_default, fr.is_delivery_dependent, fr.ord AS at_ord, fr.seq AS at_seq,
  CASE fo WHEN 1 THEN 'cart' ELSE 'checkout' END AS first_seen_stage, CASE lo WHEN 1 THEN 'cart' ELSE 'checkout' END AS last_seen_stage
  FROM lg JOIN fr USING (scan_id, component_type, amount)),
 a AS (SELECT *, CASE WHEN is_delivery_dependent OR component_type IN ('shipping', 'delivery') THEN 'EVALUATED_CLEAN'
   WHEN component_type IN ('convenience_fee', 'platform_fee', 'handling_fee', 'mandatory_fee') THEN CASE WHEN previously_disclosed THEN 'EVALUATED_CLEAN' ELSE 'DETECTED' END
   WHEN component_type IN ('protection', 'insurance', 'donation', 'charity') THEN CASE WHEN selected_by_default THEN 'POTENTIAL_SIGNAL' ELSE 'EVALUATED_CLEAN' END
   ELSE 'POTENTIAL_SIGNAL' END AS assessment FROM led)"""
VERDICT = f"""{WIDE}, {LEDGER}, cs AS (SELECT scan_id, sum(amount) AS explained, bool_or(assessment = 'DETECTED') AS any_detected,
   bool_and(component_type IN ('shipping', 'delivery', 'tax') OR assessment = 'EVALUATED_CLEAN') AS all_benign FROM a GROUP BY scan_id),
 j0 AS (SELECT dl.*, coalesce(explained, 0) AS explained, coalesce(any_detected, FALSE) AS any_detected, coalesce(all_benign, TRUE) AS all_benign,
   coalesce(delta_total > 0 AND delta_total > coalesce(explained, 0), FALSE) AS has_rest FROM dl LEFT JOIN cs USING (scan_id)),
 j AS (SELECT *, CASE WHEN (any_detected OR has_rest) AND delta_total IS NOT NULL THEN 'DETECTED'
   WHEN delta_total > 0 AND all_benign AND NOT any_detected AND NOT has_rest AND (cart_reached OR checkout_reached) THEN 'EVALUATED_CLEAN'
   WHEN NOT checkout_reached OR NOT cart_reached OR p1 IS NULL OR p2 IS NULL THEN 'INCONCLUSIVE'
   WHEN delta_total > 0 THEN 'PRICE_CHANGE_DETECTED' ELSE 'EVALUATED_CLEAN' END AS verdict FROM j0)"""


def stages(spark, sf):
    return view(spark, sf, "v_stages")


def charges(spark, sf):
    return J.assess_charges(J.ledger(view(spark, sf, "v_components")))


def journeys(spark, sf):
    return J.with_verdict(J.journey_deltas(stages(spark, sf)), J.charge_sums(charges(spark, sf)))


@query("j2_deltas", f"""WITH {WIDE} SELECT scan_id, p0::DOUBLE AS p0, p1::DOUBLE AS p1, p2::DOUBLE AS p2, cart_reached, checkout_reached,
  delta_01::DOUBLE AS delta_01, delta_12::DOUBLE AS delta_12, delta_total::DOUBLE AS delta_total, {PCT} AS pct FROM dl""")
def _(spark, sf):
    return J.journey_deltas(stages(spark, sf))


@query("j3_ledger", f"WITH {LEDGER} SELECT scan_id, component_type, amount::DOUBLE AS amount, label, carried::BIGINT AS carried, previously_disclosed, first_seen_stage, last_seen_stage FROM led")
def _(spark, sf):
    led = J.ledger(view(spark, sf, "v_components"))
    return led.select("scan_id", "component_type", "amount", "label", "carried", "previously_disclosed", "first_seen_stage", "last_seen_stage")


@query("j4_charges", f"WITH {LEDGER} SELECT scan_id, component_type, amount::DOUBLE AS amount, assessment FROM a")
def _(spark, sf):
    return charges(spark, sf).select("scan_id", "component_type", "amount", "assessment")


@query("j5_remainder", f"""WITH {VERDICT} SELECT scan_id, 'mandatory_fee' AS component_type, (delta_total - explained)::DOUBLE AS amount,
  CASE WHEN checkout_reached THEN 'checkout' ELSE 'cart' END AS first_seen_stage FROM j WHERE has_rest""")
def _(spark, sf):
    r = J.remainder(J.journey_deltas(stages(spark, sf)), J.charge_sums(charges(spark, sf)))
    return r.select("scan_id", "component_type", "amount", "first_seen_stage")


@query("j6_verdict", f"""WITH {VERDICT} SELECT scan_id, delta_total::DOUBLE AS delta_total, verdict, verdict = 'DETECTED' AS is_drip,
  CASE WHEN has_rest THEN (delta_total - explained)::DOUBLE END AS unexplained FROM j""")
def _(spark, sf):
    return journeys(spark, sf).select("scan_id", "delta_total", "verdict", "is_drip", "unexplained")


@query("r13_drip_finding", f"""WITH {VERDICT} SELECT scan_id, CASE WHEN checkout_reached THEN 'checkout' ELSE 'cart' END AS page_state,
  0.95::DOUBLE AS confidence, 'HIGH' AS confidence_tier FROM j WHERE verdict = 'DETECTED'""")
def _(spark, sf):
    return J.drip_findings(journeys(spark, sf)).select("scan_id", "page_state", "confidence", "confidence_tier")


_NOTE = "remained present at checkout and was not counted twice."
_NOTES = "remained present at checkout and were not counted twice."


@query("j7_carryover_note", f"""WITH {LEDGER}, ty AS (SELECT scan_id, component_type, min(at_ord * 1000000000000 + at_seq) AS first_at, arg_min(lower(label), at_ord * 1000000000000 + at_seq) AS label
    FROM led WHERE carried > 0 GROUP BY scan_id, component_type),
  nm AS (SELECT scan_id, list(CASE component_type WHEN 'protection' THEN 'Insurance' WHEN 'donation' THEN 'carbon contribution' ELSE label END ORDER BY first_at) AS ns FROM ty GROUP BY scan_id)
  SELECT scan_id, CASE len(ns) WHEN 1 THEN ns[1] || ' {_NOTE}' WHEN 2 THEN ns[1] || ' and ' || ns[2] || ' {_NOTES}'
    ELSE array_to_string(ns[1:len(ns)-1], ', ') || ', and ' || ns[len(ns)] || ' {_NOTES}' END AS note FROM nm""")
def _(spark, sf):
    return J.carryover_note(J.ledger(view(spark, sf, "v_components")))


@query("j8_stage_trace", """WITH s AS (SELECT *, CASE stage WHEN 'product' THEN 0 WHEN 'cart' THEN 1 ELSE 2 END AS ord FROM v_stages WHERE is_captured)
  SELECT scan_id, stage, total::DOUBLE AS total, (total - first_value(total) OVER (PARTITION BY scan_id ORDER BY ord))::DOUBLE AS delta_to_baseline FROM s""")
def _(spark, sf):
    return J.stage_trace(stages(spark, sf)).select("scan_id", "stage", "total", "delta_to_baseline")


def fold_sql(group="scan_id", source="v_transitions"):
    """Fold of transitions: last capture per stage unless a later failure clears it."""
    def cap(s):
        return f"to_state = '{s}_CAPTURED' AND verified"

    cart, out = "max(seq) FILTER (WHERE {})".format(cap("CART")), "max(seq) FILTER (WHERE {})".format(cap("CHECKOUT"))
    cf = "coalesce(max(seq) FILTER (WHERE to_state = 'FAILED_INCONCLUSIVE' AND stage = 'cart'), -1)"
    of = "coalesce(max(seq) FILTER (WHERE to_state = 'FAILED_INCONCLUSIVE' AND stage IN ('cart', 'checkout')), -1)"

    def price(s):
        # a list keeps a missing price of the last capture, which max_by would skip
        return f"(list(price_observed ORDER BY seq DESC) FILTER (WHERE {cap(s)}))[1]::DOUBLE"

    return f"""SELECT {group}, arg_max(to_state, seq) AS final_state, count(*) FILTER (WHERE {cap('PRODUCT')}) > 0 AS product_reached,
     coalesce({cart} > {cf}, FALSE) AS cart_reached, coalesce({out} > {of}, FALSE) AS checkout_reached, {price('PRODUCT')} AS p0,
     CASE WHEN {cart} > {cf} THEN {price('CART')} END AS p1, CASE WHEN {out} > {of} THEN {price('CHECKOUT')} END AS p2 FROM {source} GROUP BY {group}"""


@query("j9_fold", fold_sql())
def _(spark, sf):
    return J.fold_transitions(view(spark, sf, "v_transitions"))


_SNAP = f"""sn AS (SELECT {SCAN_OF_EVENT} AS scan_id, CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart' ELSE 'checkout' END AS state, ts, event_id,
  greatest(value, {EV_K}) AS top FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


@query("j1_legacy_journey", f"""WITH {_SNAP}, g AS (SELECT scan_id, arg_max(top, ts) FILTER (WHERE state = 'product') AS p0, arg_max(top, ts) FILTER (WHERE state = 'cart') AS c,
   arg_max(top, ts) FILTER (WHERE state = 'checkout') AS o FROM sn GROUP BY scan_id), h AS (SELECT scan_id, p0, coalesce(o, c) AS final, coalesce(o, c) - p0 AS delta FROM g)
  SELECT scan_id, p0, final, round(delta, 4) AS delta, floor(delta / p0 * 100 * 10 + 0.5) / 10 AS pct, round(least(0.95, 0.70 + delta / 2000), 6) AS confidence,
   CASE WHEN delta > 200 THEN 'high' ELSE 'medium' END AS severity FROM h WHERE p0 > 0 AND delta > 0""")
def _(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    snaps = ev.select(
        F.expr(SCAN_OF_EVENT).alias("scan_id"), "ts", F.array("value", F.expr(EV_K).cast("double")).alias("prices"),
        F.when(F.col("event_type") == "view", "product").when(F.col("event_type") == "click", "cart").otherwise("checkout").alias("state"))
    out = J.legacy_journey(snaps)
    return out.withColumn("delta", F.round("delta", 4)).withColumn("confidence", F.round("confidence", 6))


@query("r12_price_increase", f"""WITH {_SNAP}, g AS (SELECT scan_id, arg_max(top, ts) FILTER (WHERE state = 'product') AS p0, arg_max(top, ts) FILTER (WHERE state = 'cart') AS c,
   arg_max(top, ts) FILTER (WHERE state = 'checkout') AS o FROM sn GROUP BY scan_id)
  SELECT CASE WHEN coalesce(o, c) - p0 > 200 THEN 'high' ELSE 'medium' END AS severity, count(*)::BIGINT AS n FROM g WHERE p0 > 0 AND coalesce(o, c) > p0 GROUP BY 1""")
def _(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    snaps = ev.select(
        F.expr(SCAN_OF_EVENT).alias("scan_id"), "ts", F.array("value", F.expr(EV_K).cast("double")).alias("prices"),
        F.when(F.col("event_type") == "view", "product").when(F.col("event_type") == "click", "cart").otherwise("checkout").alias("state"))
    return J.legacy_journey(snaps).groupBy("severity").agg(F.count("*").alias("n"))


@query("r17_cart_increase", f"WITH {WIDE} SELECT scan_id, 'DP_PRICE_INCREASE_CART' AS rule_id, delta_01::DOUBLE AS delta_01, 0.75::DOUBLE AS confidence, 'medium' AS severity FROM dl WHERE delta_01 > 0")
def _(spark, sf):
    return J.cart_increase(J.journey_deltas(stages(spark, sf)))


_TIMER = f"tm AS (SELECT user_id, event_type, event_id, ts, {EV_K} AS k FROM events)"


@query("r14_timer_reset", f"""WITH {_TIMER}, s AS (SELECT *, (k % 60) * 60 + k % 7 AS shown FROM tm),
  l AS (SELECT *, lag(shown) OVER w AS b, lag(ts) OVER w AS bt FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
  SELECT 'https://t/' || user_id AS url, event_type AS pos, event_id AS page_id, b::BIGINT AS shown_before, shown::BIGINT AS shown FROM l WHERE shown >= b AND ts > bt""")
def _(spark, sf):
    k = F.expr(EV_K)
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("https://t/"), F.col("user_id")).alias("url"), F.col("event_type").alias("pos"), F.col("event_id").alias("page_id"),
        F.col("ts").alias("captured_at"), F.concat(F.lit("left "), F.format_string("%02d:%02d", k % 60, k % 7)).alias("text"))
    return state.timer_resets(ev)


@query("r15_stock_stall", f"""WITH {_TIMER}, s AS (SELECT *, 1 + k % 9 AS stock FROM tm WHERE k % 4 > 0),
  l AS (SELECT *, lag(stock) OVER w AS b, lag(ts) OVER w AS bt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT 'https://t/' || user_id AS url, event_id AS page_id, b::BIGINT AS stock_before, stock::BIGINT AS stock FROM l WHERE stock >= b AND ts > bt""")
def _(spark, sf):
    k = F.expr(EV_K)
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("https://t/"), F.col("user_id")).alias("url"), F.col("event_id").alias("page_id"), F.col("ts").alias("captured_at"),
        F.when(k % 4 > 0, F.concat(F.lit("Only "), (k % 9 + 1).cast("string"), F.lit(" left in stock"))).otherwise("In stock").alias("visible_text"))
    return state.stock_stalls(ev)


@query("k7_lag", """SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS change FROM events""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    lagged = lag_in_ranges(ev, ["user_id"], ["ts", "event_id"], ["value"])
    return lagged.select("event_id", F.round(F.col("value") - F.col("prev.value"), 4).alias("change"))


@query("r16_unsolicited_items", """SELECT DISTINCT l_orderkey AS session_id, l_partkey AS item FROM lineitem l WHERE l_linestatus = 'F' AND NOT EXISTS
  (SELECT 1 FROM lineitem m WHERE m.l_linestatus <> 'F' AND m.l_orderkey = l.l_orderkey AND m.l_partkey = l.l_partkey)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item"), "l_linestatus")
    return state.unsolicited_items(li.where("l_linestatus = 'F'"), li.where("l_linestatus <> 'F'"))


@query("n8_unsolicited_by_customer", """SELECT DISTINCT o_custkey AS session_id, l_suppkey AS item FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'R' AND (o_custkey, l_suppkey) NOT IN (SELECT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R')""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("session_id"), F.col("l_suppkey").alias("item"), "l_returnflag")
    return state.unsolicited_items(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"))


@query("w3_price_track_batch", """WITH g AS (SELECT user_id, count(*) AS n, arg_min(value, ts) AS a, arg_max(value, ts) AS b FROM events GROUP BY user_id)
  SELECT user_id::VARCHAR AS session_id, a AS first_price, b AS latest_price, round(b - a, 4) AS delta, round(least(0.95, 0.75 + (b - a) / 1000), 6) AS confidence,
   CASE WHEN b - a > 150 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE n >= 2 AND a > 0 AND b > 0 AND b - a > 20""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("highest_price"))
    return state.price_track(ev).withColumn("delta", F.round("delta", 4)).withColumn("confidence", F.round("confidence", 6))


_SUMS = """ac AS (SELECT scan_id, bool_and(coalesce(http_status, 200) < 400) AS ok, bool_or(product_state = 'CAPTURED') AS product_reached FROM v_access GROUP BY scan_id)"""


@query("a7_access_gate", f"""WITH {VERDICT}, {_SUMS} SELECT j.scan_id, CASE WHEN coalesce(ok, TRUE) AND coalesce(product_reached, FALSE) THEN 'LOW' ELSE 'UNDETERMINED' END AS risk_level,
  CASE WHEN coalesce(ok, TRUE) AND coalesce(product_reached, FALSE) THEN verdict ELSE 'INCONCLUSIVE' END AS verdict,
  CASE WHEN coalesce(ok, TRUE) AND coalesce(product_reached, FALSE) THEN 5 ELSE 0 END::BIGINT AS risk_score,
  CASE WHEN coalesce(product_reached, FALSE) THEN 31 ELSE 0 END::BIGINT AS coverage_score FROM j LEFT JOIN ac USING (scan_id)""")
def _(spark, sf):
    s = journeys(spark, sf).select("scan_id", "verdict", F.lit("LOW").alias("risk_level"), F.lit(5).alias("risk_score"), F.lit(31).alias("coverage_score"))
    gate = view(spark, sf, "v_access").groupBy("scan_id").agg(
        F.when(F.bool_and(F.coalesce("http_status", F.lit(200)) < 400), "ACCESS_OK").otherwise("FORBIDDEN").alias("access"),
        F.bool_or(F.col("product_state") == "CAPTURED").alias("product_reached"))
    return scores.access_gate(s, gate).select("scan_id", "risk_level", "verdict", "risk_score", "coverage_score")


@query("a15_scan_list", """SELECT page_id, coalesce(CASE WHEN trim(title) <> '' THEN title END, 'shop.example.com') AS display_name FROM
  (SELECT page_id, CASE WHEN title IN ('Lamp', 'Desk') THEN title ELSE '' END AS title FROM v_access) x""")
def _(spark, sf):
    a = view(spark, sf, "v_access").withColumn("title", F.when(F.col("title").isin("Lamp", "Desk"), F.col("title")).otherwise(""))
    return scores.scan_list(a).select("page_id", "display_name")


@query("k5_recent_scans", f"""SELECT {SCAN_OF_EVENT} AS scan_id, epoch_us(max(ts))::BIGINT AS started_us FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def _(spark, sf):
    s = table(spark, sf, "events").groupBy(F.expr(SCAN_OF_EVENT).alias("scan_id")).agg(F.max("ts").cast("timestamp").alias("started_at"))
    return scores.recent_scans(s, 25).select("scan_id", F.unix_micros("started_at").alias("started_us"))


@query("f9_money_text", """SELECT o_orderkey, '₹' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS money FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("₹"), T.money_text(F.col("o_totalprice"))).alias("money"))
