"""Classification of pages and actions, prominence, windows, site walk."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageaudit.functions import windows
from pageaudit.operators import actions as A
from pageaudit.operators import classify as E
from pageaudit.operators import prominence as V
from pageaudit.operators import reached, site, state
from pageaudit.operators import structure as H


@pytest.mark.parametrize("text,stage,form,tier", [
    ("Add to Cart", "product", "", "SAFE"), ("Pay ₹5,638 Now", "checkout", "", "BLOCKED"), ("Buy Now", "product", "", "CAUTION"),
    ("Buy Now", "cart", "", "BLOCKED"), ("Continue", "cart", "", "CAUTION"), ("Continue", "product", "", "BLOCKED"),
    ("Proceed to Checkout", "cart", "", "CAUTION"), ("Place Order", "checkout", "", "BLOCKED"), ("Skip to content", "cart", "", "BLOCKED"),
    ("Order now", "cart", "/payment", "BLOCKED"), ("Book now", "checkout", "", "BLOCKED"), ("Book now", "product", "", "CAUTION"), ("Xyz", "cart", "", "BLOCKED"),
])
def test_action_tiers(one, text, stage, form, tier):
    c = A.action_class(F.lit(text), F.lit("submit"), F.lit(form), F.array(F.lit("qty")), F.lit(stage))
    assert one(c["tier"]) == tier


@pytest.mark.parametrize("text,href,stage,score", [("Proceed to checkout", "/checkout", "cart", 95.0), ("Checkout", "", "cart", 55.0), ("Next", "", "cart", 25.0),
                                                   ("Next", "", "product", 5.0), ("Help", "/checkout", "cart", 0.0)])
def test_checkout_scores(one, text, href, stage, score):
    assert one(A.checkout_score(F.lit(text), F.lit(href), F.lit(""), F.lit(""), F.lit(stage))) == score


@pytest.mark.parametrize("url,kind", [("https://a.com/", "HOMEPAGE"), ("https://a.com/cart", "CART"), ("https://a.com/checkout/x", "CHECKOUT"), ("https://a.com/collections/all", "CATEGORY"),
                                      ("https://a.com/collections/x/products/y", "PRODUCT"), ("https://a.com/a/dp/B0", "PRODUCT"), ("https://a.com/dp/B0", "PRODUCT"), ("https://a.com/one", "UNKNOWN")])
def test_page_types(one, url, kind):
    assert one(E.page_type(F.lit(url), F.lit(""))) == kind


@pytest.mark.parametrize("status,html,text,error,want", [
    (200, "x" * 5000, "y" * 300, None, "ACCESS_OK"), (None, "", "", None, "NETWORK_ERROR"), (200, "<p>", "", "Timeout 30s", "TIMEOUT"), (200, "<p>", "", "refused", "NETWORK_ERROR"),
    (404, "x", "", None, "PAGE_NOT_FOUND"), (200, "Product Not Found", "", None, "PAGE_NOT_FOUND"), (403, "Robot Check", "", None, "BOT_CHALLENGE"), (403, "x", "", None, "FORBIDDEN"),
    (429, "x", "", None, "RATE_LIMITED"), (503, "x", "", None, "RATE_LIMITED"), (500, "x", "", None, "NETWORK_ERROR"), (200, "g-recaptcha", "", None, "CAPTCHA_PRESENT"),
    (200, "Please enable JavaScript", "", None, "JS_REQUIRED"), (200, "x" * 5000 + "g-recaptcha", "y" * 300, None, "CAPTCHA_PRESENT"),
])
def test_access(one, status, html, text, error, want):
    args = [F.lit(status).cast("int"), F.lit(html), F.lit(text), F.lit(error).cast("string")]
    assert one(E.access_status(*args)) == want


@pytest.mark.parametrize("url,text,want", [("https://a.com/cart", "", "cart"), ("https://a.com/checkout", "Pay now", "payment"), ("https://a.com/checkout", "", "checkout"),
                                           ("https://a.com/p/1", "", "product"), ("https://a.com", "Buy now", "product"), ("https://a.com", "", "unknown")])
def test_page_state(one, url, text, want):
    assert one(E.page_state(F.lit(url), F.lit(text))) == want


@pytest.mark.parametrize("platform,url,html,cart,out", [
    ("shopify", "https://a.com/cart", "", 45.0, 0.0), ("shopify", "https://a.com/x", "<cart-drawer class='is-active'></cart-drawer><b class='cart__subtotal'>₹5</b>", 65.0, 0.0),
    ("woocommerce", "https://a.com/checkout", "<form class='woocommerce-checkout'></form><div class='order-total'><b class='woocommerce-Price-amount'>₹7</b></div>", 0.0, 120.0),
    ("magento", "https://a.com/cart", "<div class='cart-totals'><b class='price'>₹5</b></div><b data-role='proceed-to-checkout'></b>", 125.0, 0.0),
    ("bigcommerce", "https://a.com/cart.php", "<b class='cart-total-value'>₹5</b>", 70.0, 0.0),
    ("generic", "https://a.com/bag", "<h1>Your cart</h1><p>Subtotal: ₹500</p>", 90.0, 0.0),
])
def test_reached(page, platform, url, html, cart, out):
    p = H.parse_pages(page((url, html))).withColumn("platform", F.lit(platform))
    r = reached.cart_and_checkout(p).first()
    assert (r.cart_score, r.checkout_score) == (cart, out)


def test_prominence(one):
    full = V.prominence(F.lit(1280.0), F.lit(720.0), F.lit(0.0), F.lit(48.0), F.lit(1.0), [F.lit(0)] * 3, [F.lit(255)] * 3)
    assert one(full) == pytest.approx(1.0)
    assert one(V.prominence_ratio(F.lit(1.0), F.lit(0.0))) == 99.0


def test_lag_over_ranges_equals_plain_lag(spark):
    rnd = random.Random(2)
    rows = [("k" if rnd.random() < 0.6 else rnd.choice([None, "a", "b"]), i, rnd.choice([5, rnd.randint(0, 10**6)]), rnd.choice([None, rnd.random()])) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, id long, sec long, v double").withColumn("ts", F.timestamp_seconds("sec"))
    plain = df.withColumn("p", F.lag(F.struct("v")).over(Window.partitionBy("key").orderBy("ts", "id"))).select("id", F.col("p.v").alias("a"), F.col("p").isNull().alias("first"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for merged in ("true", "false"):  # one range, or as many as there are partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        ours = windows.lag_in_ranges(df, ["key"], ["ts", "id"], ["v"]).select("id", F.col("prev.v").alias("b"), F.col("prev").isNull().alias("no"))
        j = plain.join(ours, "id")
        assert j.count() == 1500 and j.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("first") != F.col("no"))).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert windows.lag_in_ranges(df.limit(0), ["key"], ["ts", "id"], ["v"]).count() == 0


def test_a_hot_key_of_one_moment_is_spread(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.lit(7)).alias("ts"), "id")
    out = windows.lag_in_ranges(df, ["key"], ["ts", "id"], ["id"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 1 and out.where("prev IS NULL").count() == 1 and out.where("prev.id = id - 1").count() == 19999


def test_membership_bitmap_loses_nothing(spark):
    pages = spark.range(5000).select(F.concat(F.lit("https://a/"), "id").alias("url"), "id")
    wanted = pages.where("id % 50 = 3").select("url")
    kept = site.may_be_among(pages, wanted)
    assert wanted.exceptAll(kept.select("url")).count() == 0 and 100 <= kept.count() < 110
    few = site.may_be_among(pages, wanted, 1 << 8)  # too small a bitmap lets more through, never less
    assert wanted.exceptAll(few.select("url")).count() == 0
    assert site.may_be_among(pages, wanted.limit(0)).count() == 0


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    out = windows.top_k(df, ["g"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_walk_is_breadth_first_and_bounded(spark):
    edges = {"a": ["b", "c", "a"], "b": ["d", "e"], "c": ["b", "f", "g"], "d": ["h", "i", "j"], "e": ["k"]}
    links = spark.createDataFrame([(s, i, d) for s, ds in edges.items() for i, d in enumerate(ds)], "src_url string, seq int, dst_url string")
    starts = spark.createDataFrame([("x", "a")], "host string, url string")
    got = [r.url for r in site.reachable_pages(starts, links, 8).orderBy("rank").collect()]
    assert got == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert site.reachable_pages(starts, links, 3).count() == 3
    whole = {r.url: r.depth for r in site.reachable_pages(starts, links).collect()}
    assert "".join(sorted(whole)) == "abcdefghijk" and whole["k"] == 3


def test_state_rules(spark):
    rows = [(1, "u", 0, "10:00 left", 1), (2, "u", 60, "10:00 left", 1), (3, "u", 120, "08:00 left", 1), (4, "u", 180, "09:30 left", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, sec long, text string, pos int").withColumn("captured_at", F.timestamp_seconds("sec"))
    assert sorted(r.page_id for r in state.timer_resets(df).collect()) == [2, 4]
    stock = df.withColumn("visible_text", F.expr("concat('Only ', element_at(array('3','3','2','5'), cast(page_id as int)), ' left')"))
    assert sorted(r.page_id for r in state.stock_stalls(stock).collect()) == [2, 4]
