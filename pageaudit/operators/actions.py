"""Safety tier and ranking of page actions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import contains_any, found
from pageaudit.functions.windows import top_k


def _or_empty(c) -> Column:
    return F.coalesce(c, F.lit(""))


def action_class(text: Column, btn_type: Column, form_action: Column, form_inputs: Column, stage: Column) -> Column:
    """Struct of tier, reason code and payment context; the tests apply in this order."""
    t = F.lower(F.trim(text))
    form = F.lower(_or_empty(form_action))
    inputs = F.lower(F.array_join(F.coalesce(form_inputs, F.array().cast("array<string>")), "\n"))
    paying = contains_any(form, X.PAYMENT_FORM_WORDS) | contains_any(inputs, X.PAYMENT_FORM_WORDS)
    late = stage.isin("cart", "checkout")
    submits = (F.lower(_or_empty(btn_type)) == "submit") | t.contains("pay") | t.contains("order")
    generic = reduce(lambda a, b: a | b, [(t == p) | t.startswith(p + " ") for p in X.GENERIC_PHRASES])
    out = lambda tier, reason, ctx: F.struct(
        F.lit(tier).alias("tier"), F.lit(reason).alias("reason"),
        (F.lit(ctx) if isinstance(ctx, bool) else ctx).alias("payment_context"),
    )
    buy = t.contains("buy now")
    return (
        F.when(found(t, X.RX_NAV_NOISE), out("BLOCKED", "navigation", False))
        .when(contains_any(t, X.BLOCKED_PHRASES), out("BLOCKED", "irreversible", True))
        .when(paying & submits, out("BLOCKED", "payment_form", True))
        .when(buy & (late | paying), out("BLOCKED", "buy_now_late", True))
        .when(buy, out("CAUTION", "buy_now", False))
        .when(contains_any(t, X.SAFE_PHRASES) & ~paying, out("SAFE", "reversible", False))
        .when(generic & (stage == "cart"), out("CAUTION", "generic_in_cart", False))
        .when(generic, out("BLOCKED", "generic", False))
        .when(contains_any(t, X.CHECKOUT_PHRASES) & t.contains("book now") & late, out("BLOCKED", "book_now_late", True))
        .when(contains_any(t, X.CHECKOUT_PHRASES), out("CAUTION", "checkout", False))
        .otherwise(out("BLOCKED", "unrecognised", paying))
    )


def checkout_score(text: Column, href: Column, form_action: Column, surrounding: Column, stage: Column) -> Column:
    t, h = F.lower(F.trim(text)), F.lower(_or_empty(href))
    words = (
        F.when(found(t, X.RX_CHECKOUT_STRONG), 65.0)
        .when(found(t, X.RX_CHECKOUT_WORD), 55.0)
        .when(found(t, X.RX_CHECKOUT_REVIEW), 45.0)
        .when(found(t, X.RX_CHECKOUT_GENERIC), F.when(stage == "cart", 25.0).otherwise(5.0))
        .otherwise(0.0)
    )
    link = F.when(h.contains("checkout"), 30.0).when(h.contains("cart"), 15.0).otherwise(0.0)
    form = F.when(F.lower(_or_empty(form_action)).contains("checkout"), 25.0).otherwise(0.0)
    near = F.when(contains_any(F.lower(_or_empty(surrounding)), X.CONTEXT_WORDS), 20.0).otherwise(0.0)
    return F.when(found(t, X.RX_NAV_NOISE), 0.0).otherwise(words + link + form + near)


def cart_score(text: Column, tag: Column, href: Column, form_action: Column, visible: Column) -> Column:
    t, form = F.lower(F.trim(text)), _or_empty(form_action)
    words = F.when(found(t, X.RX_ADD_TO_CART), 45.0).when(t.contains("cart") | t.contains("bag"), 20.0).otherwise(0.0)
    link = F.when(form.contains("/cart/add") | _or_empty(href).contains("/cart"), 25.0).otherwise(0.0)
    inside = F.when(form != "", 20.0).otherwise(0.0)
    kind = F.when(tag.isin("button", "input"), 10.0).otherwise(0.0)
    return (
        F.when(~visible | (_or_empty(text) == ""), 0.0)
        .when(found(text, X.RX_NAV_NOISE), -100.0)
        .otherwise(words + link + inside + kind)
    )


def _classified(scored: DataFrame, cls: Column, allowed) -> DataFrame:
    """Keeps the rows whose class is allowed; the class is worked out once per row."""
    return scored.select("*", F.explode(F.filter(F.array(cls), allowed)).alias("cls"))


def rank_cart_actions(actions: DataFrame, k: int) -> DataFrame:
    """The k best add-to-cart actions per page, without blocked ones and those scored zero or less."""
    c = F.col
    scored = actions.withColumn("score", cart_score(c("text"), c("tag"), c("href"), c("form_action"), c("is_visible"))).where("score > 0")
    cls = action_class(c("text"), c("type"), c("form_action"), c("form_inputs"), F.lit("product"))
    ok = _classified(scored, cls, lambda k: k["tier"] != "BLOCKED")
    return top_k(ok, ["page_id"], [c("score").desc(), c("pos")], k)


def rank_checkout_actions(actions: DataFrame, k: int) -> DataFrame:
    """The k best checkout actions per page: not blocked, no payment context, score of at least 35."""
    c = F.col
    scored = actions.withColumn(
        "score", checkout_score(c("text"), c("href"), c("form_action"), c("surrounding"), F.lit("cart"))
    ).where(c("score") >= X.CHECKOUT_MIN_SCORE)
    cls = action_class(c("text"), F.lit(""), c("form_action"), c("form_inputs"), F.lit("cart"))
    ok = _classified(scored, cls, lambda k: (k["tier"] != "BLOCKED") & ~k["payment_context"])
    return top_k(ok, ["page_id"], [c("score").desc(), c("pos")], k)
