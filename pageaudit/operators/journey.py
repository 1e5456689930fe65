"""Price journeys: stage totals, fee ledger, drip-pricing verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit.functions.text import money_text

STAGE_ORD = {"product": 0, "cart": 1, "checkout": 2}
MONEY = "decimal(14,2)"
DELIVERY = ["shipping", "delivery"]
MANDATORY = ["convenience_fee", "platform_fee", "handling_fee", "mandatory_fee"]
OPTIONAL = ["protection", "insurance", "donation", "charity"]


def stage_ord(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, i in STAGE_ORD.items():
        out = F.when(stage == name, F.lit(i)).otherwise(out)
    return out


def one_decimal(x: Column) -> Column:
    """Half up to one decimal, the same in every engine."""
    return F.floor(x * 10 + 0.5) / 10


def journey_deltas(price_stages: DataFrame) -> DataFrame:
    """P0, P1, P2 and their deltas. An uncaptured total stays NULL, never zero."""
    total = F.when(F.col("is_captured"), F.col("total").cast(MONEY))
    at = lambda s: F.max(F.when(F.col("stage") == s, total))
    wide = price_stages.groupBy("scan_id").agg(
        at("product").alias("p0"), at("cart").alias("p1"), at("checkout").alias("p2"),
        F.bool_or(F.col("stage") == "cart").alias("cart_reached"),
        F.bool_or(F.col("stage") == "checkout").alias("checkout_reached"),
    )
    rise = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0).cast(MONEY), (b - a).cast(MONEY)))
    p0, p1, p2 = F.col("p0"), F.col("p1"), F.col("p2")
    total_delta = F.coalesce(rise(p0, p2), rise(p0, p1))
    return (
        wide.withColumn("delta_01", rise(p0, p1))
        .withColumn("delta_12", rise(p1, p2))
        .withColumn("delta_total", total_delta)
        .withColumn(
            "pct",
            F.when(F.col("delta_total").isNotNull() & (p0 > 0),
                   one_decimal(F.col("delta_total").cast("double") / p0.cast("double") * 100))
            .when(F.col("delta_total").isNotNull(), F.lit(0.0)),
        )
    )


def ledger(components: DataFrame) -> DataFrame:
    """One row per scan and charge: where it first and last appeared and how often it was carried over.

    A charge is the pair of type and amount. Charges seen only on the product
    page are not new charges; seeing one there marks it as disclosed before.
    """
    c = components.withColumn("ord", stage_ord(F.col("stage"))).withColumn("amount", F.col("amount").cast(MONEY))
    if "is_aggregate" in c.columns:
        c = c.where(~F.coalesce("is_aggregate", F.lit(False)))
    late = F.col("ord") > 0
    shown = F.struct("label", "is_mandatory", "disclosed_early", "selected_by_default", "is_delivery_dependent")
    grouped = c.groupBy("scan_id", "component_type", "amount").agg(
        F.min(F.when(late, F.col("ord"))).alias("first_ord"),
        F.max(F.when(late, F.col("ord"))).alias("last_ord"),
        (F.count_if(late) - 1).alias("carried"),
        F.bool_or(F.col("ord") == 0).alias("previously_disclosed"),
        F.min_by(F.when(late, shown), F.when(late, F.struct("ord", "seq"))).alias("s"),
        F.min(F.when(late, F.struct("ord", "seq"))).alias("seen_at"),
    )
    stage = lambda o: F.element_at(F.array(F.lit("cart"), F.lit("checkout")), o)
    return grouped.where(F.col("first_ord").isNotNull()).select(
        "scan_id", "component_type", "amount", "s.*", "carried", "previously_disclosed", "seen_at",
        stage(F.col("first_ord")).alias("first_seen_stage"), stage(F.col("last_ord")).alias("last_seen_stage"),
    )


def assess_charges(led: DataFrame) -> DataFrame:
    """Assessment of each new charge with a reason."""
    t = F.lower("component_type")
    delivery = F.coalesce("is_delivery_dependent", F.lit(False)) | t.isin(DELIVERY)
    withheld = t.isin(MANDATORY) & ~F.col("previously_disclosed")
    preselected = t.isin(OPTIONAL) & F.coalesce("selected_by_default", F.lit(False))
    status = (
        F.when(delivery, "EVALUATED_CLEAN")
        .when(withheld, "DETECTED")
        .when(t.isin(MANDATORY), "EVALUATED_CLEAN")
        .when(preselected, "POTENTIAL_SIGNAL")
        .when(t.isin(OPTIONAL), "EVALUATED_CLEAN")
        .otherwise("POTENTIAL_SIGNAL")
    )
    fee = F.concat(F.lit("₹"), money_text(F.col("amount")), F.lit(" at "), F.col("first_seen_stage"))
    reason = (
        F.when(delivery, F.concat(F.lit("variable delivery charge "), fee))
        .when(withheld, F.concat(F.lit("mandatory charge missing from the first price: "), fee))
        .when(t.isin(MANDATORY), F.concat(F.lit("charge disclosed before: "), fee))
        .when(preselected, F.concat(F.lit("optional charge selected in advance: "), fee))
        .when(t.isin(OPTIONAL), F.concat(F.lit("optional charge: "), fee))
        .otherwise(F.concat(F.lit("further charge: "), fee))
    )
    return led.withColumn("assessment", status).withColumn("reason", reason)


def charge_sums(assessed: DataFrame) -> DataFrame:
    """What the verdict needs to know about the charges of a scan, in one partial aggregate."""
    benign = F.col("component_type").isin("shipping", "delivery", "tax") | (F.col("assessment") == "EVALUATED_CLEAN")
    return assessed.groupBy("scan_id").agg(
        F.sum("amount").cast(MONEY).alias("explained"),
        F.bool_or(F.col("assessment") == "DETECTED").alias("any_detected"),
        F.bool_and(benign).alias("all_benign"),
        F.count("*").alias("n_charges"),
    )


def remainder(deltas: DataFrame, sums: DataFrame) -> DataFrame:
    """Part of the total delta that no new charge accounts for, as a mandatory fee row."""
    j = deltas.join(sums, "scan_id", "left")
    rest = (F.col("delta_total") - F.coalesce("explained", F.lit(0).cast(MONEY))).cast(MONEY)
    return j.where((F.col("delta_total") > 0) & (rest > 0)).select(
        "scan_id", F.lit("mandatory_fee").alias("component_type"),
        F.lit("Unitemized Mandatory Price Escalation").alias("label"), rest.alias("amount"),
        F.when(F.col("checkout_reached"), "checkout").otherwise("cart").alias("first_seen_stage"),
        F.lit("DETECTED").alias("assessment"),
    )


def with_verdict(deltas: DataFrame, sums: DataFrame) -> DataFrame:
    """Journey verdict; the tests apply in this order."""
    j = deltas.join(sums, "scan_id", "left")
    d = F.col("delta_total")
    rest = F.coalesce((d > 0) & (d > F.coalesce("explained", F.lit(0).cast(MONEY))), F.lit(False))
    detected = F.coalesce("any_detected", F.lit(False)) | rest
    benign = F.coalesce("all_benign", F.lit(True)) & ~detected & (d > 0)
    partial = ~F.col("checkout_reached") | ~F.col("cart_reached") | F.col("p1").isNull() | F.col("p2").isNull()
    verdict = (
        F.when(detected & d.isNotNull(), "DETECTED")
        .when(F.coalesce(benign, F.lit(False)) & (F.col("checkout_reached") | F.col("cart_reached")), "EVALUATED_CLEAN")
        .when(partial, "INCONCLUSIVE")
        .when(d > 0, "PRICE_CHANGE_DETECTED")
        .otherwise("EVALUATED_CLEAN")
    )
    return (
        j.withColumn("verdict", verdict)
        .withColumn("is_drip", F.col("verdict") == "DETECTED")
        .withColumn("unexplained", F.when(rest, d - F.coalesce("explained", F.lit(0).cast(MONEY))).cast(MONEY))
    )


def drip_findings(journeys: DataFrame) -> DataFrame:
    """Finding for every journey with a drip-pricing verdict."""
    rise = money_text(F.col("delta_total"))
    return journeys.where("is_drip").select(
        "scan_id", F.lit("DRIP_PRICING").alias("pattern"), F.lit("DP_JOURNEY").alias("rule_id"),
        F.lit(0.95).alias("confidence"), F.lit("HIGH").alias("confidence_tier"), F.lit("high").alias("severity"),
        F.when(F.col("checkout_reached"), "checkout").otherwise("cart").alias("page_state"),
        F.concat(F.lit("Drip Pricing Signal: Mandatory Surcharge Concealed Upfront (+₹"), rise, F.lit(")")).alias("title"),
        F.array(
            F.concat(F.lit("P0 Advertised: ₹"), money_text(F.col("p0"))),
            F.concat(F.lit("Observed Payable: ₹"), money_text(F.coalesce("p2", "p1"))),
            F.concat(F.lit("Mandatory Escalation: +₹"), rise),
        ).alias("snippets"),
    )


def carryover_note(led: DataFrame) -> DataFrame:
    """Sentence naming the carried-over charge types, in order of appearance.

    Grouped by type first, so the list per scan is as short as the list of types.
    """
    by_type = led.where("carried > 0").groupBy("scan_id", "component_type").agg(
        F.min("seen_at").alias("at"), F.min_by(F.lower("label"), "seen_at").alias("label")
    )
    name = (
        F.when(F.col("component_type") == "protection", "Insurance")
        .when(F.col("component_type") == "donation", "carbon contribution")
        .otherwise(F.col("label"))
    )
    per = by_type.groupBy("scan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "component_type", name.alias("name")))), lambda s: s["name"]).alias("names")
    )
    n, names = F.size("names"), F.col("names")
    last = F.element_at(names, -1)
    note = (
        F.when(n == 1, F.concat(last, F.lit(" remained present at checkout and was not counted twice.")))
        .when(n == 2, F.concat(names[0], F.lit(" and "), last, F.lit(" remained present at checkout and were not counted twice.")))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), last,
                            F.lit(" remained present at checkout and were not counted twice.")))
    )
    return per.select("scan_id", note.alias("note"))


def stage_trace(price_stages: DataFrame) -> DataFrame:
    """Each captured stage with its delta to the first captured stage of the scan.

    The baseline is a grouped minimum joined back: a journey has few stages, but
    a window would sort a hot scan in one task.
    """
    s = price_stages.where("is_captured").withColumn("ord", stage_ord(F.col("stage")))
    base = s.groupBy("scan_id").agg(F.min_by("total", "ord").alias("baseline"))
    return s.join(base, "scan_id").withColumn("delta_to_baseline", (F.col("total") - F.col("baseline")).cast(MONEY))


def fold_transitions(transitions: DataFrame, *span) -> DataFrame:
    """State of each purchase journey after all its transitions.

    A captured stage holds until a later failure at that stage (or, for the
    checkout, at the cart) clears it together with its price. ``span`` adds a
    grouping key, such as a session window.
    """
    state, seq = F.col("to_state"), F.col("seq")
    captured = lambda s: (state == f"{s}_CAPTURED") & F.col("verified")
    failed = state == "FAILED_INCONCLUSIVE"
    cart_fail = failed & (F.col("stage") == "cart")
    late_fail = failed & F.col("stage").isin("cart", "checkout")
    last = lambda cond: F.max(F.when(cond, seq))
    price = lambda cond: F.max_by(F.when(cond, F.struct(F.col("price_observed").alias("p"))), F.when(cond, seq))
    g = transitions.groupBy("scan_id", *span).agg(
        F.max_by("to_state", "seq").alias("final_state"),
        last(captured("PRODUCT")).alias("prod_at"), price(captured("PRODUCT")).alias("p0"),
        last(captured("CART")).alias("cart_at"), price(captured("CART")).alias("p1"), last(cart_fail).alias("cart_fail"),
        last(captured("CHECKOUT")).alias("out_at"), price(captured("CHECKOUT")).alias("p2"), last(late_fail).alias("late_fail"),
    )
    holds = lambda at, fail: F.col(at).isNotNull() & (F.coalesce(fail, F.lit(-1)) < F.col(at))
    cart, out = holds("cart_at", "cart_fail"), holds("out_at", "late_fail")
    extra = [c for c in g.columns if c == "visit"]
    return g.select(
        "scan_id", *extra, "final_state", F.col("prod_at").isNotNull().alias("product_reached"),
        cart.alias("cart_reached"), out.alias("checkout_reached"),
        F.col("p0.p").alias("p0"), F.when(cart, F.col("p1.p")).alias("p1"), F.when(out, F.col("p2.p")).alias("p2"),
    )


def legacy_journey(snapshots: DataFrame) -> DataFrame:
    """Highest price per state (latest snapshot of a state wins), product against checkout, else cart.

    ``snapshots``: scan_id, state, ts, prices.
    """
    s = snapshots.where(F.size("prices") > 0).withColumn("top", F.array_max("prices"))
    at = lambda st: F.max_by(F.when(F.col("state") == st, F.col("top")), F.when(F.col("state") == st, F.col("ts")))
    g = s.groupBy("scan_id").agg(at("product").alias("p0"), at("cart").alias("cart"), at("checkout").alias("checkout"))
    final = F.coalesce(F.when(F.col("checkout") != 0, F.col("checkout")), F.col("cart"))
    g = g.withColumn("final", final).withColumn("delta", F.col("final") - F.col("p0"))
    return g.where((F.col("p0") > 0) & (F.col("delta") > 0)).select(
        "scan_id", "p0", "final", "delta",
        one_decimal(F.col("delta").cast("double") / F.col("p0").cast("double") * 100).alias("pct"),
        F.least(F.lit(0.95), 0.70 + F.col("delta").cast("double") / 2000).alias("confidence"),
        F.when(F.col("delta") > 200, "high").otherwise("medium").alias("severity"),
    )


def cart_increase(deltas: DataFrame) -> DataFrame:
    """Scans whose cart total is above the advertised price."""
    return deltas.where("delta_01 > 0").select(
        "scan_id", F.lit("DP_PRICE_INCREASE_CART").alias("rule_id"), "delta_01",
        F.lit(0.75).alias("confidence"), F.lit("medium").alias("severity"),
    )
