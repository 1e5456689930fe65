"""Price candidates, page prices, totals and components."""

import itertools
import json
import random
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pageaudit.functions import text as T
from pageaudit.operators import prices as P
from pageaudit.operators import structure as H
from pageaudit.operators.classify import platform


def parsed(page, *htmls, url="https://a.com/product/1", stage="product"):
    return H.parse_pages(page(*[(url, h, stage) for h in htmls]).withColumn("platform", platform(F.col("html"), F.col("url"))))


@pytest.mark.parametrize("text,value", [("₹1,299.50", D("1299.50")), ("Rs. 4", None), ("Rs. 4 then Rs 99", D("99.00")), ("1299 inr", D("1299.00")), ("1299", None)])
def test_first_inr(one, text, value):
    assert one(T.first_inr(F.lit(text))) == value


@pytest.mark.parametrize("text,value", [("₹ 1,999.00", 1999.0), ("1.2.3", None), ("", None), ("free", None), ("-5", 5.0)])
def test_clean_price(one, text, value):
    assert one(T.clean_price(F.lit(text))) == value


def test_jsonld(page):
    ld = [{"@graph": [{"@type": "Product", "headline": "Lamp", "offers": [{"price": "1,999", "priceSpecification": [
        {"price": 4999, "priceType": "https://schema.org/ListPrice"}, {"price": 1989}]}]}, {"@type": "Thing", "price": 1}]}, {"@type": ["Offer"], "lowPrice": 5}]
    html = f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">{{bad</script>'
    p = parsed(page, html)
    got = [(float(r.amount), r.confidence, r.is_mrp) for r in P.jsonld_candidates(p).orderBy("seq").collect()]
    assert got == [(4999.0, 0.4, True), (1989.0, 0.96, False), (1999.0, 0.95, False), (5.0, 0.92, False)]
    assert p.select(P.jsonld_title().alias("t")).first().t == "Lamp"


def test_hydration_order_and_depth(page):
    deep = {"price": 1}
    for _ in range(9):
        deep = {"n": deep}
    state = {"zeta": [{"price": i} for i in range(1, 31)], "alpha": {"price": "₹ 77"}, "mrp": 500, "emiPlan": {"price": 3}, "deep": deep, "flag": {"price": True}}
    p = parsed(page, f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>')
    rows = P.hydration_candidates(p).orderBy("seq").collect()
    amounts = [float(r.amount) for r in rows]
    assert amounts == [float(i) for i in range(1, 31)] + [77.0, 500.0, 1.0, 1.0]  # document order, every item and depth, nothing under emi
    assert [r.is_mrp for r in rows if r.amount == 500] == [True]


def test_shopify_paise(page):
    p = parsed(page, '<script id="ProductJson-1">{"price": 199900, "variants": [{"price": 9900}], "compare_at_price": 499900}</script>')
    got = {(float(r.amount), r.is_mrp) for r in P.hydration_candidates(p).collect()}
    assert got == {(1999.0, False), (9900.0, False), (499900.0, True)}


@pytest.mark.parametrize("html,url,expected", [
    ('<i>cdn.shopify.com</i><b class="price-item--sale">₹900</b><s class="price-item--regular">₹1,200</s>', "https://a.com",
     {("sale", 900.0, 0.96, False), ("compare", 1200.0, 0.35, True), ("regular", 1200.0, 0.35, True)}),
    ('<i>window.Shopify</i><b class="price-item--regular">₹900</b>', "https://a.com", {("regular", 900.0, 0.94, False)}),
    ('<body class="woocommerce"><p class="price"><del><b class="woocommerce-Price-amount">₹20</b></del><ins><b class="woocommerce-Price-amount">₹15</b></ins></p>',
     "https://a.com", {("sale", 15.0, 0.96, False), ("compare", 20.0, 0.35, True)}),
    ('<body class="woocommerce"><div class="summary"><b class="woocommerce-Price-amount">₹15</b></div>', "https://a.com", {("plain", 15.0, 0.93, False)}),
    ('<div data-mage-init="x" class="price-box"><b class="price">₹44</b></div><div class="old-price"><b class="price">₹55</b></div>', "https://a.com",
     {("plain", 44.0, 0.94, False), ("compare", 55.0, 0.35, True)}),
    ('<i>stencil-utils</i><div class="productView-price"><b class="price">₹12</b></div>', "https://a.com", {("sale", 12.0, 0.95, False)}),
    ('<div class="a-price"><b class="a-offscreen">₹39</b></div><div class="pdp-price"><strong>₹88</strong></div>', "https://a.com", {("myntra", 88.0, 0.94, False)}),
    ('<div class="Nx9bqj CxhGGd">₹71</div>', "https://a.com", {("flipkart", 71.0, 0.94, False)}),
])
def test_platform_selectors(page, html, url, expected):
    rows = P.platform_candidates(parsed(page, html, url=url)).collect()
    assert {(r.label.split()[1], float(r.amount), r.confidence, r.is_mrp) for r in rows} == expected


@pytest.mark.parametrize("html,total,source,conf", [
    ('<script type="application/ld+json">{"offers":{"price":"2999"}}</script><b itemprop="price" content="1"></b>', 2999, "JSON_LD", "HIGH"),
    ('<b itemprop="price">₹ 2,500</b><b class="sale-price">₹1</b>', 2500, "MICRODATA", "HIGH"),
    ('<s class="sale-price">₹9,999</s><b class="final-price">₹700</b><b class="offer-price">₹650</b>', 650, "SEMANTIC_SELECTOR", "HIGH"),
    ('<b data-price="4,999">x</b>', 4999, "SEMANTIC_SELECTOR", "HIGH"),
    ('<p>MRP: ₹4,999</p><p>Offer price: 2,999</p>', 2999, "REGEX_PROXIMITY", "MEDIUM"),
    ('<nav>₹500</nav><p>Rs. 750 in all</p>', 750, "FALLBACK", "LOW"),
    ('<p>No numbers</p>', None, "NONE", "FAILED"),
    ('<p>4.5 stars, EMI from Rs 500</p>', None, "NONE", "FAILED"),
])
def test_product_price_priority(page, html, total, source, conf):
    r = P.product_price(parsed(page, html)).first()
    assert (None if r.total is None else float(r.total), r.extraction_source, r.extraction_confidence) == (total, source, conf)


@pytest.mark.parametrize("html,total,source,conf", [
    ("<div class='total-row'>Grand Total: ₹5,638</div><p>Subtotal ₹1</p>", 5638, "DOM_SUMMARY_CONTAINER", "HIGH"),
    ("<p>Amount payable ₹5,188</p>", 5188, "TOTAL_ANCHOR", "HIGH"), ("<p>Total: ₹450</p>", 450, "TOTAL_ANCHOR", "MEDIUM"),
    ("<p>₹450</p>", None, "NONE", "FAILED"),
    ("<div class='my-total'>Total ₹9</div><div class='grand-total'>Total ₹8</div>", 8, "DOM_SUMMARY_CONTAINER", "HIGH"),
])
def test_stage_total(page, html, total, source, conf):
    r = P.stage_total(parsed(page, html, stage="cart")).first()
    assert (None if r.total is None else float(r.total), r.extraction_source, r.extraction_confidence) == (total, source, conf)


def test_components_of_a_cart(page):
    html = """<label><input type=checkbox checked>Travel insurance ₹199</label><label><input type=checkbox checked>Carbon donation ₹99</label>
    <div class="fee-row">Insurance & carbon add-ons ₹298</div><div class="fee-row">Convenience fee ₹450</div><div class="fee-row">Convenience fee ₹450</div>
    <div class="fee-row">Cart subtotal ₹5,188</div><div class="fee-row">Delivery ₹40</div>"""
    got = [(r.component_type, float(r.amount), r.selected_by_default) for r in P.stage_components(parsed(page, html, stage="cart")).orderBy("seq").collect()]
    assert got == [("protection", 199.0, True), ("donation", 99.0, True), ("convenience_fee", 450.0, True), ("shipping", 40.0, True)]


def test_sums_agree_with_brute_force(spark, monkeypatch):
    rnd, rows, both = random.Random(11), [], set()
    for _ in range(150):
        cents = [rnd.choice([rnd.randint(100, 6000), 100 * rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 9))]
        want = [any(abs(sum(c) - t) < 50 for r in range(2, len(cents)) for c in itertools.combinations([x for x in cents if x < t], r)) for t in cents]
        rows.append((cents, want))
        both.update(want)
    assert both == {True, False}
    for limit in (1 << 14, 5, 0):  # a set of sums, a change in mid course, bits from the start
        monkeypatch.setattr(P, "MANY_SUMS", limit)
        assert all(P.summed_from_smaller(cents) == want for cents, want in rows)


def test_forty_unequal_fees_take_no_time(spark):
    cents = [10_007 + 7_919 * k + k * k for k in range(40)]
    begin = time.time()
    flags = P.summed_from_smaller([*cents, sum(cents), sum(cents[:7])])
    assert time.time() - begin < 1 and flags[40] and flags[41] and not flags[0]
    rows = [("fee", D(c) / 100, "Fee") for c in [*cents, sum(cents)]]
    df = spark.createDataFrame([(rows,), ([],), (None,)], "c array<struct<component_type: string, amount: decimal(14,2), raw: string>>")
    left = [r.k for r in df.select(P.drop_aggregates(F.col("c")).alias("k")).collect()]
    assert [float(x.amount) * 100 for x in left[0]] == pytest.approx([c for c, f in zip(cents, flags) if not f]) and left[1:] == [[], None]


def test_ranking(spark):
    def rank(*rows):
        df = spark.createDataFrame([(1, i, D(a), s, c, "product", m, False, True) for i, (a, s, c, m) in enumerate(rows)],
                                   "page_id long, seq int, amount decimal(14,2), source string, confidence double, stage string, is_mrp boolean, is_discount boolean, belongs_to_product boolean")
        return P.rank_candidates(df).first()

    r = rank((4999, "dom", 0.99, True), (2999, "dom", 0.9, False))
    assert (float(r.price), r.has_conflict) == (2999.0, False)
    r = rank((1999, "json_ld", 0.95, False), (2199, "dom", 0.9, False))
    assert (float(r.price), r.has_conflict) == (1999.0, True)
    r = rank((4999, "dom", 0.4, True))
    assert float(r.price) == 4999.0
    r = rank((10, "meta", 0.9, False), (11, "meta", 0.9, False))
    assert float(r.price) == 10.0


def test_row_ranking_equals_table_ranking(page, spark):
    htmls = ['<meta property="og:price:amount" content="900"><i>cdn.shopify.com</i><b class="price-item--sale">₹905</b>',
             '<script type="application/ld+json">{"@type":"Offer","price":10}</script>', "<p>none</p>"]
    p = parsed(page, *htmls).withColumn("cands", P.candidate_array())
    fallback = F.struct(F.lit(None).cast("decimal(14,2)").alias("amount"), F.lit("NONE").alias("source"))
    rows = {r.page_id: r.b for r in p.select("page_id", P.best_candidate(F.col("cands"), fallback).alias("b")).collect()}
    table = {r.page_id: r for r in P.rank_candidates(P.all_candidates(p)).collect()}
    assert rows[2].amount is None and 2 not in table
    for k in (0, 1):
        assert (rows[k].amount, rows[k].source, rows[k].has_conflict) == (table[k].price, table[k].source, table[k].has_conflict)


def test_network_rules(spark):
    body = json.dumps({"a": {"sellingPrice": "₹1,500", "mrpPrice": 9, "list": [{"price": 20 + i} for i in range(30)]}, "emi": {"price": 50}, "price": 5})
    rows = [("s", 1, "https://x/api/p", "application/json", body), ("s", 2, "https://x/api/p", "application/json", body),
            ("s", 3, "https://x/static", "application/json", body), ("s", 4, "https://x/api/q", "text/html", body), ("s", 5, "https://x/api/r", "application/json", "{bad")]
    df = spark.createDataFrame(rows, "session_id string, seq long, url string, content_type string, body string")
    got = [float(r.amount) for r in P.network_candidates(df).orderBy("seq", "ord").collect()]
    assert got == [1500.0] + [20.0 + i for i in range(30)] + [5.0]
    assert P.network_candidates(df, low=10, high=40).count() == 20
    assert P.network_candidates(df, 4).count() == 4
