"""Tables in the shape the operators need, derived from the stored tables.

The SQL is plain enough for Spark and for the checking engine, so both sides
start from the same rows. Every view reads its base tables whole.
"""

from pyspark.sql import DataFrame, SparkSession

from pageaudit.sources.tables import table

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def pick(expr, options, cast=None):
    """CASE over ``expr`` = 0, 1, 2 ...; options are SQL expressions."""
    body = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"(CASE {expr} {body} END)"


def texts(expr, options):
    return pick(expr, ["'" + o.replace("'", "''") + "'" for o in options])


PHRASES = [
    "Hurry, this sale ends soon", "Only 3 left in stock", "12 people are viewing this right now",
    "A platform fee applies to this order", "Auto-recurring plan, call to cancel", "Solid oak frame with a matt finish",
    "Free delivery on all sizes", "You must install our tool to continue", "Please do not uncheck this box",
    "Almost gone, act now", "Rated well by many readers", "Convenience fee and gateway fee are added",
    "Free 14 day trial and then billed to your card", "Returns are accepted for thirty days",
    "Limited time offer, last chance", "Grant access to your contacts to see the price",
    "Shipping charge: ₹ 60 per parcel", "Shop unprotected at your own risk", "Add to cart to see the bundle price",
    "Opt out of not receiving our letters", "Colour may differ from the picture", "Strict no-refund policy",
    "25 customers bought this today", "Machine washable at low heat",
]

STAGE_OF_EVENT = "CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart' ELSE 'checkout' END"
EV_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
SCAN_OF_EVENT = "CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING)"

VIEWS = {}

VIEWS["v_text"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS page_id, CAST(l_orderkey AS STRING) AS scan_id,
       {texts('l_linenumber % 3', ['checkout', 'product', 'cart'])} AS stage,
       'https://shop' || CAST(sk AS STRING) || '.example.com' ||
       {texts('l_linenumber % 3', ['/checkout', '/product/x', '/cart'])} AS url,
       {texts('pk % 24', PHRASES)} || '. ' || {texts('sk % 24', PHRASES)} || '. ' ||
       {texts('(pk + 3 * sk) % 24', PHRASES)} || CASE WHEN pk % 9 = 0 THEN '. Pay now' ELSE '.' END AS visible_text
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk
      FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l
"""

VIEWS["v_listings"] = f"""
SELECT pk * 1000000 + sk AS listing_id, pk AS compare_id,
       'https://www.' || {texts('sk % 8', ['amazon.in', 'flipkart.com', 'croma.com', 'reliancedigital.in',
                                          'vijaysales.com', 'tatacliq.com', 'smallshop.example', 'amazon.in.example'])}
       || '/dp/' || CAST(pk AS STRING) AS url,
       s_name AS seller,
       p_brand || ' ' || p_name || ' ' || {texts('sk % 7', [
           '8GB RAM 256GB SSD Ryzen 5', '16GB RAM 512GB SSD Core i7', '8GB RAM 256GB SSD', '8 GB RAM 256 GB SSD 15.6 inch',
           'for the office', 'black 128GB with 4GB', 'Ryzen 5 256GB SSD 8GB 15.6 inch silver'])} AS title,
       CASE WHEN sk % 4 = 3 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN sk % 5 = 0 THEN 'SKU-' || CAST(pk AS STRING) || '-' || CAST(sk % 2 AS STRING) END AS sku,
       CASE WHEN sk % 6 = 1 THEN 'M' || CAST(pk AS STRING) END AS mpn,
       CASE WHEN sk % 9 = 2 THEN '89' || CAST(pk + sk % 2 AS STRING) END AS gtin,
       CASE WHEN rf = 'R' THEN 'refurbished' WHEN rf = 'N' THEN 'new' END AS condition,
       CASE WHEN sk % 10 = 9 THEN 'BOT_CHALLENGE' WHEN sk % 23 = 7 THEN 'PRODUCT_NOT_FOUND' ELSE 'PRODUCT_CAPTURED' END AS status,
       CAST(floor(CAST(round(p_retailprice * 100) AS BIGINT) * (100 - pct) / 10000) AS DECIMAL(14,2)) AS listed_price,
       CAST({pick('(pk + sk) % 5', ['0', '49', '99', '0', '149'])} AS DECIMAL(14,2)) AS delivery_charge,
       {texts('sk % 8', ['amazon', 'flipkart', 'croma', 'reliancedigital', 'vijaysales', 'tatacliiq', 'unknown', 'amazon'])} AS marketplace,
       (pk + sk) % 4 AS findings_count
FROM (SELECT l_partkey AS pk, l_suppkey AS sk, min(l_returnflag) AS rf,
             CAST(round(min(l_discount) * 100) AS BIGINT) AS pct
      FROM {{lineitem}} GROUP BY l_partkey, l_suppkey) l
JOIN {{part}} p ON p.p_partkey = l.pk
JOIN {{supplier}} s ON s.s_suppkey = l.sk
"""

OFFER_LINES = [
    "₹2,000 instant discount today", "10% off on HDFC Bank Credit Card", "Use code SAVE500 for ₹500 off", "No-cost EMI available",
    "Extra ₹1,500 off on exchange", "Prime members get ₹100 off", "Flat ₹150 off on orders above ₹999", "5% cashback on all orders",
    "In the box: cable and manual", "₹75 off using SBI Card", "coupon: DEAL200 gives ₹200 off", "Zero-cost EMI from 3 months",
]
VIEWS["v_offers"] = f"""
SELECT pk * 1000000 + sk AS listing_id,
       {texts('pk % 12', OFFER_LINES)} || chr(10) || '  ' || {texts('sk % 12', OFFER_LINES)} || chr(10) || chr(10) ||
       {texts('(pk + sk) % 12', OFFER_LINES)} AS text
FROM (SELECT l_partkey AS pk, l_suppkey AS sk FROM {{lineitem}} GROUP BY l_partkey, l_suppkey) l
"""

REVIEW_SENTENCES = [
    "The price changed after two days.", "I was charged more than shown!", "There was a different price at checkout.",
    "A hidden charge was added.", "My coupon did not count, coupon invalid.", "It came from a different seller.",
    "I received different product.", "They sent the wrong variant.", "This is a fake discount.", "Works well and looks good.",
    "Nice.", "Delivery took four days.",
]
VIEWS["v_reviews"] = f"""
SELECT pk * 1000000 + sk AS review_id, pk * 1000000 + sk AS listing_id, pk AS compare_id,
       {texts('pk % 12', REVIEW_SENTENCES)} || ' ' || {texts('sk % 12', REVIEW_SENTENCES)} || chr(10) ||
       {texts('(2 * pk + sk) % 12', REVIEW_SENTENCES)} AS text
FROM (SELECT l_partkey AS pk, l_suppkey AS sk FROM {{lineitem}} GROUP BY l_partkey, l_suppkey) l
"""

ACTION_TEXTS = [
    "Add to Cart", "Buy Now", "Proceed to Checkout", "Checkout", "Continue", "Pay Now", "Place Order", "View cart",
    "Next step", "Review order", "Book now", "Help", "Enroll now", "Subscribe now", "Home", "Secure checkout",
    "Pay ₹999", "My bag", "Details", "Order now",
]
VIEWS["v_actions"] = f"""
SELECT pk AS page_id, sk AS pos, {texts('(pk + sk) % 20', ACTION_TEXTS)} AS text,
       {texts('sk % 3', ['button', 'a', 'div'])} AS tag,
       {texts('(pk + 2 * sk) % 5', ['', '/checkout', '/cart', '/x', 'https://a.example/cart/view'])} AS href,
       {texts('sk % 4', ['submit', '', 'button', ''])} AS type,
       {texts('(2 * pk + sk) % 6', ['', '/cart/add', '/checkout/start', '/api/payment', '', '/go'])} AS form_action,
       {texts('(pk + 5 * sk) % 7', ['', 'qty', 'card_number', 'email', 'cvv', '', ''])} AS form_input,
       {texts('sk % 5', ['Subtotal 40', '', 'Your cart', 'Total: 5', 'Nothing here'])} AS surrounding,
       {texts('(pk + sk) % 3', ['product', 'cart', 'checkout'])} AS stage,
       sk % 8 <> 3 AS is_visible
FROM (SELECT l_partkey AS pk, l_suppkey AS sk FROM {{lineitem}} GROUP BY l_partkey, l_suppkey) l
"""

VIEWS["v_layout"] = """
SELECT l.pk AS page_id, l.sk AS pos, CASE WHEN l.sk % 2 = 0 THEN 'accept' ELSE 'decline' END AS role,
       CAST(20 + (p_size * 7 + l.sk) % 400 AS DOUBLE) AS width, CAST(10 + (l.pk + l.sk * 3) % 90 AS DOUBLE) AS height,
       CAST((l.pk * 13 + l.sk * 29) % 1400 AS DOUBLE) AS top, CAST(8 + (l.pk + l.sk) % 56 AS DOUBLE) AS font_px,
       CAST((l.sk % 11) / 10 AS DOUBLE) AS opacity,
       (l.pk * 3) % 256 AS fg_r, (l.pk * 5) % 256 AS fg_g, (l.pk * 7) % 256 AS fg_b,
       (l.sk * 11) % 256 AS bg_r, (l.sk * 17) % 256 AS bg_g, (l.sk * 23) % 256 AS bg_b
FROM (SELECT l_partkey AS pk, l_suppkey AS sk FROM {lineitem} GROUP BY l_partkey, l_suppkey) l
JOIN {part} p ON p.p_partkey = l.pk
"""

VIEWS["v_stages"] = f"""
SELECT {SCAN_OF_EVENT} AS scan_id, {STAGE_OF_EVENT} AS stage, CAST(max(value) AS DECIMAL(14,2)) AS total,
       max({EV_K}) % 11 <> 0 AS is_captured, min(ts) AS captured_at
FROM {{events}}
GROUP BY {SCAN_OF_EVENT}, {STAGE_OF_EVENT}
"""

COMPONENT_TYPES = ["convenience_fee", "shipping", "protection", "donation", "tax", "platform_fee", "packing"]
VIEWS["v_components"] = f"""
SELECT scan_id, stage, seq, {texts('k % 7', COMPONENT_TYPES)} AS component_type,
       {texts('k % 7', ['Convenience Fee', 'Delivery', 'Insurance', 'Carbon', 'GST', 'Platform Fee', 'Packing'])} AS label,
       CAST({pick('k % 3', ['49', '99', '9.5'])} AS DECIMAL(14,2)) AS amount,
       k % 2 = 0 AS is_mandatory, stage = 'product' AS disclosed_early, k % 4 <> 1 AS selected_by_default,
       k % 7 = 1 AS is_delivery_dependent, FALSE AS is_aggregate
FROM (SELECT {SCAN_OF_EVENT} AS scan_id, {STAGE_OF_EVENT} AS stage, event_id AS seq, {EV_K} AS k
      FROM {{events}}) e
"""

VIEWS["v_transitions"] = f"""
SELECT {SCAN_OF_EVENT} AS scan_id, event_id AS seq, ts,
       CASE event_type WHEN 'view' THEN 'PRODUCT_CAPTURED' WHEN 'click' THEN 'CART_CAPTURED'
            WHEN 'purchase' THEN 'CHECKOUT_CAPTURED' WHEN 'error' THEN 'FAILED_INCONCLUSIVE' ELSE 'ACTION_EXECUTED' END AS to_state,
       CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'checkout'
            WHEN 'error' THEN (CASE {EV_K} % 2 WHEN 0 THEN 'cart' ELSE 'checkout' END) ELSE 'product' END AS stage,
       {EV_K} % 5 <> 0 AS verified,
       CASE WHEN {EV_K} % 13 = 0 THEN NULL ELSE CAST(value AS DECIMAL(14,2)) END AS price_observed
FROM {{events}}
"""

VIEWS["v_access"] = f"""
SELECT event_id AS page_id, {SCAN_OF_EVENT} AS scan_id,
       {pick('k % 12', ['200', '200', '404', '403', '403', '429', '500', '503', '401', '200', 'NULL', '410'])} AS http_status,
       CASE WHEN k % 12 = 10 AND k % 5 < 3 THEN '' WHEN k % 3 = 0 THEN repeat('x', 4100) ELSE '<html>' ||
            {texts('k % 8', ['robot check', 'g-recaptcha', 'enable javascript', 'ok', 'cf-turnstile', 'Page Not Found', 'fine', 'Security Verification'])} || '</html>' END AS html,
       CASE WHEN k % 2 = 0 THEN repeat('word ', 60) ELSE {texts('k % 5', ['hello', 'checking your browser before accessing', 'please enable JavaScript', 'a shop', 'Item unavailable'])} END AS visible_text,
       CASE WHEN k % 17 = 5 THEN 'Timeout after 15s' WHEN k % 19 = 5 THEN 'connection reset' END AS error_message,
       {texts('k % 6', ['Lamp', '404 Not Found', 'Chair', 'Page not found - shop', 'Desk', 'Sofa'])} AS title,
       CASE WHEN k % 4 = 1 THEN 'NOT_CAPTURED' ELSE 'CAPTURED' END AS product_state,
       CASE WHEN k % 8 = 1 THEN CAST(value AS DECIMAL(14,2)) END AS p0,
       'https://shop.example.com' || {texts('k % 14', ['', '/', '/cart/', '/checkout', '/search', '/collections/all', '/collections/a/products/b', '/dp/B00X', '/gp/product/1', '/p/one/two', '/one', '/one/two/three', '/home', '/my-bag?x=1'])} AS url
FROM (SELECT event_id, user_id, ts, value, {EV_K} AS k FROM {{events}}) e
"""

# one page per order; n is the order key, p a whole price
HTML_P = "(CAST(floor(o_totalprice / 50) AS BIGINT) + 100)"
Q = '"'
VIEWS["v_html"] = f"""
SELECT n AS page_id, CAST(CAST(floor(n / 3) AS BIGINT) AS STRING) AS scan_id, {texts('n % 3', ['product', 'cart', 'checkout'])} AS stage,
  'https://h' || CAST(n % 97 AS STRING) || '.example.com' || {texts('n % 3', ['/product/', '/cart/', '/checkout/'])} || CAST(n AS STRING) AS url,
  p, n,
  '<!DOCTYPE html><html><head><title>Item ' || CAST(n AS STRING) || '</title>' ||
  CASE WHEN n % 10 = 1 THEN '<meta property="og:price:amount" content="' || CAST(p AS STRING) || '">' ELSE '' END ||
  CASE WHEN n % 4 = 0 THEN '<script type="application/ld+json">{{{{"@type":"Product","name":"Item","offers":{{{{"price":"' || CAST(p AS STRING) || '.00","priceCurrency":"INR"}}}}}}}}</script>' ELSE '' END ||
  CASE WHEN n % 6 = 2 THEN '<script id="__NEXT_DATA__">{{{{"page":{{{{"mrp":' || CAST(p + 500 AS STRING) || ',"item":{{{{"sellingPrice":"' || CAST(p AS STRING) || '"}}}}}}}}}}}}</script>' ELSE '' END ||
  CASE WHEN n % 5 = 0 THEN '<script src="https://cdn.shopify.com/s.js"></script>' ELSE '' END ||
  '<style>p {{{{margin:0}}}}</style></head><body><header><a href="/">Home</a><a href="https://other.example.net/x">Out</a></header>' ||
  '<div class="product-info-main"><h1>Item number ' || CAST(n AS STRING) || '</h1>' ||
  '<s class="old-price">₹' || CAST(p + 500 AS STRING) || '</s>' ||
  CASE n % 4 WHEN 1 THEN '<span itemprop="price" content="' || CAST(p AS STRING) || '">now</span>'
             WHEN 2 THEN '<div class="price__sale"><span class="sale-price price-item">₹' || CAST(p AS STRING) || '</span></div>'
             WHEN 3 THEN '<p>Offer price: ₹' || CAST(p AS STRING) || '</p>' ELSE '' END ||
  CASE WHEN n % 7 = 0 THEN '<div class="countdown">04:3' || CAST(n % 10 AS STRING) || '</div>' ELSE '' END ||
  CASE WHEN n % 7 = 1 THEN '<p>Expires in 12:30 hrs</p>' ELSE '' END ||
  CASE WHEN n % 7 = 2 THEN '<div id="timer1">06:15 AM</div>' ELSE '' END ||
  CASE WHEN n % 11 = 0 THEN '<button>No thanks, I hate saving money</button>' ELSE '' END ||
  CASE WHEN n % 13 = 0 THEN '<a class="skip" style="font-size: 9px" href="skip?x=1">Skip</a>' ELSE '' END ||
  CASE WHEN n % 5 = 1 THEN '<label><input type="checkbox" checked> Add insurance ₹199</label>' ELSE '' END ||
  CASE WHEN n % 5 = 2 THEN '<input type="checkbox" id="c1"><label for="c1">Donation to a foundation ₹10</label>' ELSE '' END ||
  CASE WHEN n % 5 = 3 THEN '<label><input type="checkbox" checked> Send me the newsletter</label>' ELSE '' END ||
  CASE WHEN n % 8 = 5 THEN '<p>Only 2 left in stock</p>' ELSE '' END ||
  '</div>' ||
  CASE WHEN n % 3 > 0 THEN '<div class="summary-row">Convenience fee ₹' || CAST(30 + n % 4 AS STRING) || '</div><div class="summary-row">GST ₹' || CAST(20 + n % 3 AS STRING) || '</div>' ||
       CASE WHEN n % 2 = 0 THEN '<div class="summary-row">Delivery and handling ₹' || CAST(50 + n % 4 + n % 3 AS STRING) || '</div>' ELSE '' END ||
       CASE WHEN n % 4 < 2 THEN '<div class="total-row">Grand Total: ₹' || CAST(p + 50 AS STRING) || '</div>' ELSE '<p>Total ₹' || CAST(p + 60 AS STRING) || '</p>' END
  ELSE '' END ||
  CASE WHEN n % 9 = 4 THEN '<form action="/pay"><input type="password" name="pw" value="secret"><input name="qty" value="1"></form>' ELSE '' END ||
  '<footer>&copy; shop &middot; ₹99 gift</footer></body></html>' AS html
FROM (SELECT o_orderkey AS n, {HTML_P} AS p FROM {{orders}}) o
"""

VIEWS["v_responses"] = f"""
SELECT CAST(user_id AS STRING) AS session_id, event_id AS seq,
       'https://a.example/' || {texts('k % 4', ['api/cart', 'static/x', 'product', 'graphql'])} || '/' || CAST(event_id - event_id % 2 AS STRING) AS url,
       {texts('k % 3', ['application/json', 'text/html', 'application/json; charset=utf-8'])} AS content_type,
       '{{{{"item":{{{{"unit_price":' || CAST(k AS STRING) || ',"mrp":999,"list":[{{{{"salePrice":"₹' || CAST(k * 100 AS STRING) || '"}}}}]}}}}}}}}' AS body
FROM (SELECT event_id, user_id, {EV_K} AS k FROM {{events}}) e
"""

VIEWS["v_mutations"] = f"""
SELECT CAST(user_id AS STRING) AS session_id, ts,
       {texts('k % 9', ['dialog', 'div', 'div', 'span', 'div', 'p', 'div', 'li', 'div'])} AS tag,
       {texts('k % 11', ['Modal-Box', 'x', 'cart-drawer', '', 'note', 'price', 'y', 'z', 'popup', 'w', 'v'])} AS class_name
FROM (SELECT user_id, ts, {EV_K} AS k FROM {{events}}) e
"""

VIEWS["v_candidates"] = f"""
SELECT page_id, seq, CAST(amount AS DECIMAL(14,2)) AS amount, source, confidence, stage, is_mrp, is_discount, belongs_to_product
FROM (SELECT user_id AS page_id, event_id AS seq, floor(value) AS amount,
       {texts('k % 11', ['adapter', 'json_ld', 'network_json', 'shopify_embedded', 'meta_tag', 'next_data', 'window_hydration_state', 'dom', 'meta', 'regex', 'other'])} AS source,
       CAST({pick('k % 4', ['0.96', '0.94', '0.5', '0.35'])} AS DOUBLE) AS confidence,
       {texts('k % 3', ['product', 'product', 'cart'])} AS stage, k % 4 = 3 AS is_mrp, k % 10 = 7 AS is_discount,
       k % 9 <> 2 AS belongs_to_product FROM (SELECT *, {EV_K} AS k FROM {{events}}) e0) e
"""

DEPENDS = {v: [t for t in BASE if "{" + t + "}" in sql] for v, sql in VIEWS.items()}


def _tables(sql, spark, folder):
    return {t: table(spark, folder, t) for t in BASE if "{" + t + "}" in sql}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = _tables(sql, spark, folder)
    if name == "v_html":
        # a few bytes per order become a page of HTML: spread the orders, not the pages
        tables["orders"] = tables["orders"].select("o_orderkey", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(sql, **tables)


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in BASE}).strip()


def with_views(sql: str) -> str:
    """Prefixes a checking query with the views it names."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    body = sql.strip()
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
