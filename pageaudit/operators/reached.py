"""Whether a snapshot shows the cart or the checkout, by shop system.

Evidence adds up: address, structure, totals and call to action, by the tables in ``fixed``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.operators import structure as H
from pageaudit.operators.prices import first_fitting, some_fitting

def _points(cond: Column, n) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)


def _any(alternatives) -> Column:
    return some_fitting(alternatives)


def _sum(cols):
    return reduce(lambda a, b: a + b, cols)


def _verdict(score: Column, threshold: int, total: Column) -> Column:
    return F.struct((score >= threshold).alias("reached"), score.cast("double").alias("score"), total.alias("total"))


def _shop_cart(name) -> Column:
    urls, structures, total, cta = X.CART[name]
    el = first_fitting(total)
    shape = F.lit(0)
    for n, alts in reversed(structures):
        shape = F.when(_any(alts), n).otherwise(shape)
    score = _points(T.contains_any(F.col("url"), urls), 45) + shape + _points(el.isNotNull(), 25) + _points(_any(cta), 20)
    return _verdict(score, 45, T.clean_price(H.element_text(el, "")))


def _shop_checkout(name) -> Column:
    urls, shape_points, shape, total_points, total, words = X.CHECKOUT[name]
    el = first_fitting(total)
    score = (
        _points(T.contains_any(F.col("url"), urls), 50) + _points(_any(shape), shape_points)
        + _points(el.isNotNull(), total_points) + _points(T.contains_any(F.lower("_text"), words), 20)
    )
    return _verdict(score, 50, T.clean_price(H.element_text(el, "")))


def _generic_cart() -> Column:
    low = F.lower("_text")
    a = lambda e, name: F.lower(F.coalesce(H.attr(e, name), F.lit("")))
    drawer = F.exists(H.ELEMENTS, lambda e: (
        (e["cls"].contains("drawer") & F.lower(e["cls"]).contains("cart")) | F.lower(e["cls"]).contains("mini-cart")
        | F.coalesce(F.lower(e["id"]).contains("cart-drawer"), F.lit(False))
        | ((a(e, "role") == "dialog") & a(e, "aria-label").contains("cart"))
    ))
    score = _points(T.contains_any(F.lower("url"), X.GENERIC_CART_URL), 45) + _points(drawer, 35)
    score = score + _sum([_points(T.contains_any(low, w), n) for n, w in X.GENERIC_CART_WORDS])
    return _verdict(score, 50, T.clean_price(T.first_group(F.col("_text"), X.RX_SUBTOTAL)))


def _generic_checkout() -> Column:
    low = F.lower("_text")
    score = _points(T.contains_any(F.lower("url"), X.GENERIC_CHECKOUT_URL), 45)
    score = score + _sum([_points(T.contains_any(low, w), n) for n, w in X.GENERIC_CHECKOUT_WORDS])
    return _verdict(score, 50, T.clean_price(T.first_group(F.col("_text"), X.RX_ORDER_TOTAL)))


def _by_platform(shop, generic) -> Column:
    out = None
    for name in X.CART:
        out = F.when(F.col("platform") == name, shop(name)) if out is None else out.when(F.col("platform") == name, shop(name))
    return out.otherwise(generic)


def cart_and_checkout(parsed: DataFrame) -> DataFrame:
    """Reached flags, scores and observed totals; needs url and platform next to the parsed page."""
    p = parsed.withColumn("_text", H.snapshot_text() if "visible_text" in parsed.columns else H.page_text())
    p = p.select("page_id", _by_platform(_shop_cart, _generic_cart()).alias("cart"),
                 _by_platform(_shop_checkout, _generic_checkout()).alias("out"))
    return p.select(
        "page_id", F.col("cart.reached").alias("cart_reached"), F.col("cart.score").alias("cart_score"),
        F.col("cart.total").alias("cart_total"), F.col("out.reached").alias("checkout_reached"),
        F.col("out.score").alias("checkout_score"), F.col("out.total").alias("checkout_total"),
    )
