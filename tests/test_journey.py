"""Journeys: deltas, ledger, verdicts, invariants, state fold."""

from decimal import Decimal as D

import pytest

from pageaudit.operators import journey as J

STAGES = "scan_id string, stage string, total decimal(14,2), is_captured boolean"
COMPONENTS = ("scan_id string, stage string, seq int, component_type string, label string, amount decimal(14,2), is_mandatory boolean, "
              "disclosed_early boolean, selected_by_default boolean, is_delivery_dependent boolean")


def run(spark, totals, parts=()):
    names = ["product", "cart", "checkout"]
    st = spark.createDataFrame([("s", names[i], None if t is None else D(str(t)), t is not None) for i, t in enumerate(totals)], STAGES)
    co = spark.createDataFrame([("s", stage, i, kind, kind.title(), D(str(a)), False, False, pre, kind == "shipping") for i, (stage, kind, a, pre) in enumerate(parts)], COMPONENTS)
    led = J.ledger(co)
    charges = J.assess_charges(led)
    deltas, sums = J.journey_deltas(st), J.charge_sums(charges)
    return J.with_verdict(deltas, sums).first(), charges.collect(), J.remainder(deltas, sums).collect(), J.carryover_note(led).collect()


def test_flight_booking(spark):
    j, charges, rest, note = run(spark, [4890, 5188, 5638], [
        ("cart", "protection", 199, True), ("cart", "donation", 99, True),
        ("checkout", "protection", 199, True), ("checkout", "donation", 99, True), ("checkout", "convenience_fee", 450, True)])
    assert (j.delta_01, j.delta_12, j.delta_total) == (298, 450, 748)
    assert j.verdict == "DETECTED" and j.is_drip and len(charges) == 3 and rest == []
    assert j.pct == 15.3
    assert note[0].note == "Insurance and carbon contribution remained present at checkout and were not counted twice."


@pytest.mark.parametrize("totals,parts,verdict", [
    ([4890, 4890, 5340], [("checkout", "convenience_fee", 450, True)], "DETECTED"),
    ([999, 1049], [("cart", "shipping", 50, True)], "EVALUATED_CLEAN"),
    ([999, 999, 999], [], "EVALUATED_CLEAN"),
    ([999], [], "INCONCLUSIVE"),
    ([999, 999], [], "INCONCLUSIVE"),
    ([999, None, None], [], "INCONCLUSIVE"),
    ([999, 1098, 1098], [("cart", "protection", 99, True)], "PRICE_CHANGE_DETECTED"),
    ([999, 1098, 1098], [("cart", "protection", 99, False)], "EVALUATED_CLEAN"),
    ([999, 1500, 1500], [], "DETECTED"),
    ([999, 1048, 1048], [("product", "platform_fee", 49, True), ("cart", "platform_fee", 49, True)], "EVALUATED_CLEAN"),
])
def test_verdicts(spark, totals, parts, verdict):
    assert run(spark, totals, parts)[0].verdict == verdict


def test_unexplained_part(spark):
    j, _, rest, _ = run(spark, [1000, 1000, 1300], [("checkout", "tax", 100, True)])
    assert j.verdict == "DETECTED" and j.unexplained == 200
    assert [(r.component_type, r.amount, r.first_seen_stage) for r in rest] == [("mandatory_fee", 200, "checkout")]


def test_uncaptured_totals_stay_unknown(spark):
    j = run(spark, [1000, None, 1200])[0]
    assert j.p1 is None and j.delta_01 is None and j.delta_12 is None and j.delta_total == 200
    j = run(spark, [None, 1000, 1200])[0]
    assert j.p0 is None and j.delta_total is None and j.pct is None


def test_deltas_never_negative(spark):
    j = run(spark, [1000, 900, 800])[0]
    assert (j.delta_01, j.delta_12, j.delta_total) == (0, 0, 0)


def test_failure_clears_phantom_prices(spark):
    schema = "scan_id string, seq long, to_state string, stage string, verified boolean, price_observed decimal(14,2)"
    f = "FAILED_INCONCLUSIVE"
    rows = [("a", 1, "PRODUCT_CAPTURED", "product", True, D(10)), ("a", 2, "CART_CAPTURED", "cart", True, D(12)), ("a", 3, "CHECKOUT_CAPTURED", "checkout", True, D(15)), ("a", 4, f, "checkout", True, None),
            ("b", 1, "CART_CAPTURED", "cart", True, D(12)), ("b", 2, "CHECKOUT_CAPTURED", "checkout", True, D(15)), ("b", 3, f, "cart", True, None),
            ("c", 1, f, "cart", True, None), ("c", 2, "CART_CAPTURED", "cart", True, D(9)), ("c", 3, "CHECKOUT_CAPTURED", "checkout", False, D(11)),
            ("d", 1, "CART_CAPTURED", "cart", True, D(9)), ("d", 2, "CART_CAPTURED", "cart", True, None)]
    got = {r.scan_id: r for r in J.fold_transitions(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a"].cart_reached, got["a"].p1, got["a"].checkout_reached, got["a"].p2) == (True, 12, False, None)
    assert (got["b"].cart_reached, got["b"].p1, got["b"].checkout_reached, got["b"].p2) == (False, None, False, None)
    assert (got["c"].cart_reached, got["c"].p1, got["c"].checkout_reached) == (True, 9, False)
    assert got["d"].cart_reached and got["d"].p1 is None
