"""Queries over page classes, actions and layout."""

from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.operators import actions as A
from pageaudit.operators import classify as E
from pageaudit.operators import prominence as V
from pageaudit.registry.base import any_of, query, rx
from pageaudit.registry.views import view
from pageaudit.sources.tables import table

_PATH = "trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')"
_LOW = f"lower({_PATH})"
_TYPE = f"""CASE WHEN {_PATH} IN ('', 'index.html', 'home', 'default.aspx') THEN 'HOMEPAGE' WHEN {any_of(_LOW, X.CART_WORDS)} THEN 'CART'
  WHEN {any_of(_LOW, X.CHECKOUT_WORDS)} THEN 'CHECKOUT' WHEN {any_of(_LOW, X.CATEGORY_WORDS)} AND NOT regexp_matches({_LOW}, '/products?/[^/]+$') THEN 'CATEGORY'
  WHEN {any_of(_LOW, X.PRODUCT_PATHS)} THEN 'PRODUCT' WHEN {any_of('html', X.PRODUCT_MARKUP)} THEN 'PRODUCT' WHEN contains({_PATH}, '/') THEN 'PRODUCT' ELSE 'UNKNOWN' END"""


@query("e3_page_type", f"SELECT page_id, {_TYPE} AS page_type FROM v_access")
def _(spark, sf):
    return view(spark, sf, "v_access").select("page_id", E.page_type(F.col("url"), F.col("html")).alias("page_type"))


@query("e3_page_type_stored", f"SELECT page_id, {_TYPE} AS page_type FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", E.page_type(F.col("url"), F.col("html")).alias("page_type"))


_ACC_LOW = "lower(visible_text || ' ' || html)"
ACCESS = f"""CASE WHEN coalesce(error_message, '') <> '' AND contains(lower(error_message), 'timeout') THEN 'TIMEOUT' WHEN coalesce(error_message, '') <> '' THEN 'NETWORK_ERROR'
  WHEN coalesce(http_status, 0) = 0 AND html = '' THEN 'NETWORK_ERROR' WHEN http_status = 404 OR {any_of(_ACC_LOW, X.NOT_FOUND_SIGNALS)} THEN 'PAGE_NOT_FOUND'
  WHEN http_status = 401 THEN 'LOGIN_REQUIRED' WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status = 403 AND {any_of(_ACC_LOW, X.BOT_SIGNALS)} THEN 'BOT_CHALLENGE'
  WHEN http_status = 403 THEN 'FORBIDDEN' WHEN http_status = 503 THEN 'RATE_LIMITED' WHEN http_status >= 500 THEN 'NETWORK_ERROR'
  WHEN {any_of(_ACC_LOW, X.CAPTCHA_SIGNALS)} THEN 'CAPTCHA_PRESENT'
  WHEN {any_of(_ACC_LOW, X.BOT_SIGNALS)} THEN 'BOT_CHALLENGE' WHEN contains({_ACC_LOW}, 'enable javascript') THEN 'JS_REQUIRED' ELSE 'ACCESS_OK' END"""


def access(spark, sf):
    c = F.col
    return view(spark, sf, "v_access").withColumn(
        "access", E.access_status(c("http_status"), c("html"), c("visible_text"), c("error_message")))


@query("e4_access_status", f"SELECT page_id, {ACCESS} AS access FROM v_access")
def _(spark, sf):
    return access(spark, sf).select("page_id", "access")


@query("e10_listing_status", f"""WITH ac AS (SELECT *, {ACCESS} AS access FROM v_access) SELECT page_id, CASE
  WHEN access = 'PAGE_NOT_FOUND' OR coalesce(http_status IN (404, 410), FALSE) OR regexp_matches(title, {rx(X.RX_TITLE_NOT_FOUND)}) THEN 'PAGE_NOT_FOUND'
  WHEN access IN ('BOT_CHALLENGE', 'CAPTCHA_PRESENT') THEN 'BOT_CHALLENGE' WHEN access IN ('FORBIDDEN', 'NETWORK_ERROR', 'TIMEOUT', 'ACCESS_BLOCKED') THEN 'ACCESS_BLOCKED'
  WHEN product_state <> 'CAPTURED' AND coalesce(p0, 0) = 0 THEN 'PRODUCT_NOT_FOUND' ELSE 'PRODUCT_CAPTURED' END AS status FROM ac""")
def _(spark, sf):
    c = F.col
    status = E.listing_status(c("access"), c("http_status"), c("title"), c("product_state"), c("p0"))
    return access(spark, sf).select("page_id", status.alias("status"))


@query("e5_platform", """SELECT n AS page_id, CASE WHEN n % 5 = 0 THEN 'shopify' ELSE 'generic' END AS platform FROM v_html""")
def _(spark, sf):
    return view(spark, sf, "v_html").select("page_id", E.platform(F.col("html"), F.col("url")).alias("platform"))


_T = "lower(trim(text))"
_PAY = "(" + any_of("lower(form_action)", X.PAYMENT_FORM_WORDS) + " OR " + any_of("lower(form_input)", X.PAYMENT_FORM_WORDS) + ")"
_GEN = "(" + " OR ".join(f"{_T} = '{p}' OR starts_with({_T}, '{p} ')" for p in X.GENERIC_PHRASES) + ")"


def action_sql(stage="stage", btype="type"):
    late = f"{stage} IN ('cart', 'checkout')"
    return f"""CASE WHEN regexp_matches({_T}, {rx(X.RX_NAV_NOISE)}) THEN 'BLOCKED|navigation|false' WHEN {any_of(_T, X.BLOCKED_PHRASES)} THEN 'BLOCKED|irreversible|true'
     WHEN {_PAY} AND (lower({btype}) = 'submit' OR contains({_T}, 'pay') OR contains({_T}, 'order')) THEN 'BLOCKED|payment_form|true'
     WHEN contains({_T}, 'buy now') AND ({late} OR {_PAY}) THEN 'BLOCKED|buy_now_late|true' WHEN contains({_T}, 'buy now') THEN 'CAUTION|buy_now|false'
     WHEN {any_of(_T, X.SAFE_PHRASES)} AND NOT {_PAY} THEN 'SAFE|reversible|false' WHEN {_GEN} AND {stage} = 'cart' THEN 'CAUTION|generic_in_cart|false'
     WHEN {_GEN} THEN 'BLOCKED|generic|false' WHEN {any_of(_T, X.CHECKOUT_PHRASES)} AND contains({_T}, 'book now') AND {late} THEN 'BLOCKED|book_now_late|true'
     WHEN {any_of(_T, X.CHECKOUT_PHRASES)} THEN 'CAUTION|checkout|false' ELSE 'BLOCKED|unrecognised|' || {_PAY}::VARCHAR END"""


def checkout_sql(stage="stage"):
    return f"""CASE WHEN regexp_matches({_T}, {rx(X.RX_NAV_NOISE)}) THEN 0 ELSE
     (CASE WHEN regexp_matches({_T}, {rx(X.RX_CHECKOUT_STRONG)}) THEN 65 WHEN regexp_matches({_T}, {rx(X.RX_CHECKOUT_WORD)}) THEN 55 WHEN regexp_matches({_T}, {rx(X.RX_CHECKOUT_REVIEW)}) THEN 45
       WHEN regexp_matches({_T}, {rx(X.RX_CHECKOUT_GENERIC)}) THEN CASE WHEN {stage} = 'cart' THEN 25 ELSE 5 END ELSE 0 END)
     + (CASE WHEN contains(lower(href), 'checkout') THEN 30 WHEN contains(lower(href), 'cart') THEN 15 ELSE 0 END)
     + (CASE WHEN contains(lower(form_action), 'checkout') THEN 25 ELSE 0 END) + (CASE WHEN {any_of('lower(surrounding)', X.CONTEXT_WORDS)} THEN 20 ELSE 0 END) END::DOUBLE"""


CART_SQL = f"""CASE WHEN NOT is_visible OR text = '' THEN 0 WHEN regexp_matches(text, {rx(X.RX_NAV_NOISE)}) THEN -100 ELSE
     (CASE WHEN regexp_matches({_T}, {rx(X.RX_ADD_TO_CART)}) THEN 45 WHEN contains({_T}, 'cart') OR contains({_T}, 'bag') THEN 20 ELSE 0 END)
     + (CASE WHEN contains(form_action, '/cart/add') OR contains(href, '/cart') THEN 25 ELSE 0 END) + (CASE WHEN form_action <> '' THEN 20 ELSE 0 END)
     + (CASE WHEN tag IN ('button', 'input') THEN 10 ELSE 0 END) END::DOUBLE"""


def acts(spark, sf):
    return view(spark, sf, "v_actions").withColumn("form_inputs", F.array("form_input"))


@query("e6_action_tier", f"SELECT page_id, pos, {action_sql()} AS cls FROM v_actions")
def _(spark, sf):
    c = F.col
    cls = A.action_class(c("text"), c("type"), c("form_action"), c("form_inputs"), c("stage"))
    return acts(spark, sf).withColumn("k", cls).select(
        "page_id", "pos", F.concat_ws("|", "k.tier", "k.reason", F.col("k.payment_context").cast("string")).alias("cls"))


@query("e7_checkout_score", f"SELECT page_id, pos, {checkout_sql()} AS score FROM v_actions")
def _(spark, sf):
    c = F.col
    return acts(spark, sf).select("page_id", "pos", A.checkout_score(c("text"), c("href"), c("form_action"), c("surrounding"), c("stage")).alias("score"))


@query("e8_cart_score", f"SELECT page_id, pos, {CART_SQL} AS score FROM v_actions")
def _(spark, sf):
    c = F.col
    return acts(spark, sf).select("page_id", "pos", A.cart_score(c("text"), c("tag"), c("href"), c("form_action"), c("is_visible")).alias("score"))


_PRODUCT, _NONE = "'product'", "''"


@query("k1_cart_actions", f"""WITH x AS (SELECT page_id, pos, text, {CART_SQL} AS score, {action_sql(_PRODUCT)} AS cls FROM v_actions)
  SELECT * FROM (SELECT page_id, pos, text, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::BIGINT AS rank FROM x
   WHERE NOT starts_with(cls, 'BLOCKED') AND score > 0) y WHERE rank <= 3""")
def _(spark, sf):
    return A.rank_cart_actions(acts(spark, sf), 3).select("page_id", "pos", "text", "score", "rank")


@query("k2_checkout_actions", f"""WITH x AS (SELECT page_id, pos, text, {checkout_sql("'cart'")} AS score, {action_sql("'cart'", _NONE)} AS cls FROM v_actions)
  SELECT * FROM (SELECT page_id, pos, text, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::BIGINT AS rank FROM x
   WHERE NOT starts_with(cls, 'BLOCKED') AND NOT ends_with(cls, 'true') AND score >= 35) y WHERE rank <= 3""")
def _(spark, sf):
    return A.rank_checkout_actions(acts(spark, sf), 3).select("page_id", "pos", "text", "score", "rank")


_LUM = lambda p: f"(({p}_r * 0.299::DOUBLE + {p}_g * 0.587::DOUBLE + {p}_b * 0.114::DOUBLE) / 255)"
PROM = f"""pm AS (SELECT page_id, pos, role, least(width * height / (1280 * 720), 1) * 0.25::DOUBLE + least(font_px / 48, 1) * 0.2::DOUBLE + (CASE WHEN top < 360 THEN 1 ELSE 0.5::DOUBLE END) * 0.2::DOUBLE
  + (CASE WHEN opacity > 0.3::DOUBLE THEN 1 ELSE 0 END) * 0.2::DOUBLE + least(abs({_LUM('fg')} - {_LUM('bg')}) * 2, 1) * 0.15::DOUBLE AS prominence FROM v_layout)"""


def scored(spark, sf):
    c = F.col
    p = V.prominence(c("width"), c("height"), c("top"), c("font_px"), c("opacity"),
                     (c("fg_r"), c("fg_g"), c("fg_b")), (c("bg_r"), c("bg_g"), c("bg_b")))
    return view(spark, sf, "v_layout").withColumn("prominence", p)


@query("v1_prominence", f"WITH {PROM} SELECT page_id, pos, round(prominence, 6) AS prominence FROM pm")
def _(spark, sf):
    return scored(spark, sf).select("page_id", "pos", F.round("prominence", 6).alias("prominence"))


_PAIR = f"""{PROM}, pp AS (SELECT page_id, arg_min(prominence, pos) FILTER (WHERE role = 'accept') AS a, arg_min(prominence, pos) FILTER (WHERE role = 'decline') AS d FROM pm GROUP BY page_id),
  ra AS (SELECT page_id, a, d, CASE WHEN d > 0 THEN a / d ELSE 99 END AS ratio FROM pp WHERE a IS NOT NULL AND d IS NOT NULL)"""


@query("v2_prominence_ratio", f"WITH {_PAIR} SELECT page_id, round(ratio, 6) AS ratio FROM ra")
def _(spark, sf):
    return V.asymmetry(scored(spark, sf), 0.0).select("page_id", F.round("ratio", 6).alias("ratio"))


@query("r20_hidden_alternative", f"""WITH {_PAIR} SELECT page_id, round(ratio, 6) AS ratio, round(least(0.95, 0.7 + (ratio - 2) * 0.04 - 0.06), 6) AS confidence,
  CASE WHEN ratio >= 6 THEN 'high' ELSE 'medium' END AS severity FROM ra WHERE ratio >= 2""")
def _(spark, sf):
    """Threshold 2 instead of 3.5, since stored boxes here rarely differ more."""
    a = V.asymmetry(scored(spark, sf), 2.0)
    return a.select("page_id", F.round("ratio", 6).alias("ratio"), F.round("confidence", 6).alias("confidence"), "severity")


@query("r20_ratio_findings", f"""WITH {_PAIR} SELECT page_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 6 THEN 'high' ELSE 'medium' END AS severity FROM ra WHERE ratio >= 3.5""")
def _(spark, sf):
    a = V.asymmetry(scored(spark, sf))
    return a.select("page_id", F.round("ratio", 6).alias("ratio"), "severity")


@query("f10_url_parts", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/cart' AS cart_url FROM pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.host_of(F.col("url")).alias("host"), T.path_of(F.col("url")).alias("path"),
                    T.resolve(F.col("url"), F.lit("/cart")).alias("cart_url"))


@query("p1_parse_inr", r"""SELECT o_orderkey, CASE WHEN v BETWEEN 5 AND 25000000 THEN v::DOUBLE END AS amount FROM
  (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::DECIMAL(14,2) WHEN 1 THEN floor(o_totalprice)::DECIMAL(14,2) WHEN 2 THEN (o_orderkey % 9)::DECIMAL(14,2) END AS v FROM orders) x""")
def _(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    raw = (F.when(k % 4 == 0, F.format_number("o_totalprice", 2)).when(k % 4 == 1, F.format_number(F.floor("o_totalprice"), 0))
           .when(k % 4 == 2, (k % 9).cast("string")).otherwise("n/a"))
    return o.select("o_orderkey", T.parse_inr(raw).alias("amount"))


@query("p2_first_inr", r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::DOUBLE WHEN 1 THEN floor(o_totalprice)::DOUBLE WHEN 2 THEN 99::DOUBLE END AS amount FROM orders""")
def _(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    n = F.format_number(F.floor("o_totalprice"), 0)
    raw = (F.when(k % 4 == 0, F.concat(F.lit("4 stars and 3 left Rs. "), n, F.lit(" only"))).when(k % 4 == 1, F.concat(n, F.lit(" INR, was ₹9")))
           .when(k % 4 == 2, F.lit("₹2 coupon, then ₹99")).otherwise(F.concat(F.lit("call "), n)))
    return o.select("o_orderkey", T.first_inr(raw).alias("amount"))


@query("p4_clean_price", r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN nullif(value, 0) WHEN 1 THEN round(value * 100, 0) WHEN 2 THEN NULL END AS price FROM events""")
def _(spark, sf):
    ev, k = table(spark, sf, "events"), F.col("event_id")
    raw = (F.when(k % 4 == 0, F.concat(F.lit("₹ "), F.format_string("%.2f", "value"))).when(k % 4 == 1, F.format_number(F.round(F.col("value") * 100), 0))
           .when(k % 4 == 2, F.lit("1.2.3")).otherwise("free"))
    return ev.select("event_id", T.clean_price(raw).alias("price"))


@query("p16_confidence_label", """SELECT page_id, seq, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM v_candidates""")
def _(spark, sf):
    return view(spark, sf, "v_candidates").select("page_id", "seq", E.confidence_label(F.col("confidence")).alias("label"))
