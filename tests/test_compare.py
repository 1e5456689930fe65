"""Fingerprints, matching, inconsistencies, offers, reviews, summaries."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pageaudit.functions import text as T
from pageaudit.operators import compare as C
from pageaudit.plans import comparison

LISTING = ("listing_id long, compare_id long, title string, brand string, sku string, mpn string, gtin string, seller string, condition string, status string, "
           "marketplace string, listed_price decimal(14,2), delivery_charge decimal(14,2), findings_count long")


def listing(i, title, price=None, brand=None, sku=None, mpn=None, gtin=None, seller="S", condition=None, status="PRODUCT_CAPTURED", group=1, delivery=0, findings=0):
    return (i, group, title, brand, sku, mpn, gtin, seller, condition, status, "m", None if price is None else D(str(price)), D(delivery), findings)


def fp(spark, *rows):
    return C.with_fingerprint(spark.createDataFrame(list(rows), LISTING))


@pytest.mark.parametrize("title,ram,storage,processor,screen,color", [
    ("Acer 8GB RAM 256GB SSD Ryzen 5 15.6 inch black", "8GB", "256GB SSD", "ryzen 5", "15.6 inch", "black"),
    ("Phone 128GB 6GB Snapdragon 888", "6GB", "128GB", "snapdragon 888", None, None),
    ("Laptop 1 TB HDD, 16 GB memory, Core i7, 14\" Space Grey", "16GB", "1TB HDD", "core i7", "14 inch", "space grey"),
    ("Card 128GB", None, "128GB", None, None, None),
    ("Phone 8GB RAM", "8GB", None, None, None, None),
    ("Oak table", None, None, None, None, None),
])
def test_attributes(spark, title, ram, storage, processor, screen, color):
    r = fp(spark, listing(1, title)).first()
    assert (r.ram, r.storage, r.processor, r.screen_size, r.color) == (ram, storage, processor, screen, color)


def test_fingerprint_fields(spark):
    r = fp(spark, listing(1, "Acer Aspire 5 Slim Laptop 8GB RAM 256GB SSD", sku="A1")).first()
    assert (r.brand, r.model) == ("Acer", "Aspire 5 Slim Laptop")
    assert r.extraction_confidence == 0.8
    assert r.normalized_title == "acer aspire 5 slim laptop 8gb ram 256gb ssd"
    r = fp(spark, listing(1, "TV")).first()
    assert (r.brand, r.model, r.extraction_confidence) == (None, None, 0.35)


@pytest.mark.parametrize("raw,norm", [("Café Set, the NEW one!", "cafe one"), ("Ａbc ½ ﬁne™", "abc 1 2 finetm"), ("  A_b  ", "a_b"), ("Résumé", "re sume")])
def test_title_folding(one, raw, norm):
    assert one(T.normalise_title(F.lit(raw))) == norm


@pytest.mark.parametrize("a,b,verdict", [
    (dict(title="x", sku="A"), dict(title="y", sku="a"), "MATCHED"),
    (dict(title="x", sku="A", gtin="1"), dict(title="x", sku="B", gtin="1"), "NOT_MATCHED"),
    (dict(title="x", sku="A", gtin="1"), dict(title="x", gtin="1"), "MATCHED"),
    (dict(title="Acer 8GB RAM 256GB SSD Ryzen 5"), dict(title="acer v2 8GB RAM 256GB SSD Ryzen 5"), "MATCHED"),
    (dict(title="Acer 8GB RAM 256GB SSD"), dict(title="Acer pro 8GB RAM 256GB SSD"), "PROBABLE_MATCH"),
    (dict(title="Acer 8GB RAM"), dict(title="Acer pro 8GB RAM"), "POSSIBLE_MATCH"),
    (dict(title="Acer 8GB RAM 256GB SSD"), dict(title="Acer 8GB RAM 512GB SSD"), "NOT_MATCHED"),
    (dict(title="blue oak table"), dict(title="the blue oak table"), "POSSIBLE_MATCH"),
    (dict(title="blue oak table"), dict(title="red steel chair"), "NOT_MATCHED"),
    (dict(title="blue oak table"), dict(title="green oak table"), "INSUFFICIENT_EVIDENCE"),
])
def test_verdicts(spark, a, b, verdict):
    left, right = fp(spark, listing(1, **a)).alias("a"), fp(spark, listing(2, **b)).alias("b")
    j = left.join(right, F.col("a.compare_id") == F.col("b.compare_id"))
    assert j.select(C.match_verdict(lambda f: F.col(f"a.{f}"), lambda f: F.col(f"b.{f}"))).first()[0] == verdict


def test_partner_counts_equal_all_pairs(spark):
    """The linear matching against every pair, on random listings with missing fields and one hot group."""
    rnd, rows = random.Random(3), []
    for i in range(260):
        spec = " ".join(rnd.choice(v) for v in (["8GB RAM", "16GB RAM", ""], ["256GB SSD", "512GB SSD", ""], ["Ryzen 5", "Core i7", ""], ["14 inch", "15.6 inch", ""]))
        some = lambda v: rnd.choice(v) if rnd.random() < 0.25 else None
        rows.append(listing(i, f"{rnd.choice(['Acer', 'Dell'])} {spec}", rnd.randint(900, 1200), brand=rnd.choice([None, "Acer", "ACER ", "Dell"]),
                            sku=some(["A", "B"]), mpn=some(["M", "N"]), gtin=some(["1", "2"]), group=1 if rnd.random() < 0.5 else rnd.randint(2, 6)))
    f = fp(spark, *rows).cache()
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, (F.col("a.compare_id") == F.col("b.compare_id")) & (F.col("a.listing_id") != F.col("b.listing_id"))).select(
        F.col("a.listing_id").alias("la"), F.col("b.listed_price").alias("price"), F.col("b.listing_id").alias("lb"),
        C.match_verdict(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("v"))
    want = {}
    for r in pairs.where("v in ('MATCHED', 'PROBABLE_MATCH')").collect():
        w = want.setdefault(r.la, [0, 0, (r.price, r.lb)])
        w[0 if r.v == "MATCHED" else 1] += 1
        w[2] = min(w[2], (r.price, r.lb))
    got = {}
    for r in C.comparable_partners(f).collect():
        if r.n_matched + r.n_probable:
            best = (r.cheapest.listed_price, r.cheapest.listing_id)
            own = (r.own.listed_price, r.own.listing_id)
            got[r.listing_id] = [r.n_matched, r.n_probable, best, own]
    assert set(got) == set(want)
    for k, (m, p, best, own) in got.items():
        assert [m, p] == want[k][:2]
        assert best == min(want[k][2], own)


def inconsistencies(spark, rows, offers=()):
    o = spark.createDataFrame(list(offers), "listing_id long, best_offer double")
    return C.price_inconsistencies(fp(spark, *rows), o).collect()


def test_laptop_pair(spark):
    t = "Acer Aspire 8GB RAM 256GB SSD Ryzen 5"
    r = inconsistencies(spark, [listing(1, t, 65000), listing(2, t, 100000)])
    assert [(x.listing_id, x.cheapest_listing, float(x.price_delta), x.price_delta_pct, x.explanation) for x in r] == [(2, 1, 35000.0, 53.8, "unexplained")]


@pytest.mark.parametrize("a,b,offers,why", [
    (dict(price=80000), dict(price=100000), [(1, 20000.0)], "offer"),
    (dict(price=100), dict(price=150, delivery=49), [], "fee"),
    (dict(price=100), dict(price=150, condition="refurbished"), [], "condition"),
    (dict(price=100, sku="A"), dict(price=150, sku="A", title="Acer 16GB RAM 256GB SSD Ryzen 5"), [], "variant"),
    (dict(price=100), dict(price=104), [], None),
    (dict(price=100), dict(price=200, status="BOT_CHALLENGE"), [], None),
])
def test_explanations(spark, a, b, offers, why):
    t = "Acer 8GB RAM 256GB SSD Ryzen 5"
    r = inconsistencies(spark, [listing(1, **{"title": t, **a}), listing(2, **{"title": t, **b})], offers)
    assert [x.explanation for x in r] == ([] if why is None else [why])


def offers_of(spark, text):
    df = spark.createDataFrame([(1, text)], "listing_id long, text string")
    return C.extract_offers(df).orderBy("seq").collect()


@pytest.mark.parametrize("line,kind,value,pct,applicable", [
    ("₹2,000 instant discount", "instant_discount", 2000.0, None, True),
    ("Flat ₹500 off on orders above ₹5,000", "instant_discount", 500.0, None, False),
    ("10% off with HDFC Bank Credit Card", "bank_offer", None, 10.0, False),
    ("Use code SAVE500 for ₹500 off", "coupon", 500.0, None, True),
    ("Prime members get ₹100 off", "membership", 100.0, None, False),
    ("5% cashback", "instant_discount", None, 5.0, True),
    ("No-cost EMI available", "emi", None, None, False),
])
def test_offer_kinds(spark, line, kind, value, pct, applicable):
    r = offers_of(spark, line)
    assert [(o.offer_type, o.discount_value, o.discount_percentage, o.is_applicable) for o in r] == [(kind, value, pct, applicable)]


def test_offers_stack_and_deduplicate(spark):
    r = offers_of(spark, "Extra ₹10,000 off on exchange\nExtra ₹10,000 off on exchange\n\tno-cost EMI and 5% off\n" + "x" * 301 + " 9% off\nPlain text")
    assert [o.offer_type for o in r] == ["exchange", "instant_discount", "emi", "instant_discount", "instant_discount"]
    assert [o.discount_value for o in r] == [10000.0, 10000.0, None, None, None]


def test_effective_price(spark):
    ls = spark.createDataFrame([listing(1, "x", 50000, delivery=100)], LISTING)
    o = C.extract_offers(spark.createDataFrame([(1, "₹2,000 instant discount\n₹1,500 off on SBI Card\nUse code ABCD for ₹500 off")], "listing_id long, text string"))
    r = C.effective_prices(ls, o).first()
    assert (r.applicable, r.conditional, r.payable, r.n_conditional) == (2500, 1500, 47600, 1)
    assert r.note == "Listed: ₹50,000 - ₹2,500 (applicable discount) + ₹100 (mandatory fees) = ₹47,600"


def test_reviews(spark):
    text = "The price changed overnight! Bad.\nA hidden charge was added. Coupon didn't work for me. All fine here, really."
    df = spark.createDataFrame([(1, 1, 1, text), (2, 1, 1, "Another hidden charge appeared.")], "review_id long, listing_id long, compare_id long, text string")
    s = C.review_signals(df)
    assert [r.signal_type for r in s.orderBy("review_id", "pos").collect()] == ["PRICE_MISMATCH", "UNEXPECTED_FEE", "COUPON_NOT_APPLIED", "UNEXPECTED_FEE"]
    c = {r.signal_type: r for r in C.review_clusters(s).collect()}
    assert (c["UNEXPECTED_FEE"].review_count, c["UNEXPECTED_FEE"].confidence, c["UNEXPECTED_FEE"].snippet) == (2, 0.8, "A hidden charge was added.")
    e = C.review_evidence(C.review_clusters(s)).first()
    assert (e.total_signals, e.corroboration, e.concerns.split(",")[0]) == (4, "CORROBORATED", "UNEXPECTED_FEE")
    every = C.review_evidence(C.review_clusters(s), comparisons=spark.createDataFrame([(1,), (2,)], "compare_id long")).collect()
    assert {r.compare_id: (r.total_signals, r.corroboration) for r in every} == {1: (4, "CORROBORATED"), 2: (0, "CLEAN")}


def test_canonical_and_summary(spark):
    f = fp(spark, listing(1, "Acer 8GB RAM", 10), listing(2, "Acer 8GB RAM 256GB SSD", 9, findings=2), listing(3, "Acer 8GB RAM 512GB SSD", 8, status="ACCESS_BLOCKED"))
    m = {r.listing_id: (r.canonical_listing, r.match_confidence) for r in C.canonical_match(f).collect()}
    assert m == {1: (2, "POSSIBLE_MATCH"), 2: (2, "MATCHED"), 3: (2, "NOT_MATCHED")}
    s = C.comparison_summary(f.withColumn("payable", F.col("listed_price"))).first()
    assert (s.status, s.captured, s.blocked, s.cheapest_listing, s.cleanest_listing) == ("PARTIAL", 2, 1, 2, 1)


def test_an_explained_gap_hides_no_unexplained_one(spark):
    t = "Acer 8GB RAM 256GB SSD Ryzen 5"
    r = inconsistencies(spark, [listing(1, t, 100), listing(2, t, 50, condition="refurbished"), listing(3, t, 60)])
    assert {(x.listing_id, x.explanation, x.cheapest_listing) for x in r} == {(1, "condition", 2), (1, "unexplained", 3), (3, "condition", 2)}


def test_inconsistencies_equal_all_pairs(spark):
    """Per listing and explanation the cheapest partner, against every pair; equal prices, many offers and charges, one large group."""
    rnd = random.Random(9)
    rows, offers = [], []
    for i in range(220):
        title = f"Acer {rnd.choice(['8GB RAM', '16GB RAM', ''])} 256GB SSD {rnd.choice(['Ryzen 5', 'Core i7', ''])}"
        rows.append(listing(i, title, rnd.choice([100, 120, 120, 126, 150, 199, rnd.randint(90, 400)]), brand="Acer", sku=rnd.choice([None, None, "A", "B"]), condition=rnd.choice([None, "new", "refurbished"]),
                            delivery=rnd.choice([0, 0, 20, 49, 90]), seller=rnd.choice(["S", "S Shop", None]), group=1 if rnd.random() < 0.6 else rnd.randint(2, 4)))
        if rnd.random() < 0.5:
            offers.append((i, rnd.choice([5.0, 10.5, 30.0, 75.0, 150.0])))
    f = fp(spark, *rows)
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, (F.col("a.compare_id") == F.col("b.compare_id")) & (F.col("a.listed_price") > F.col("b.listed_price"))).select(
        F.col("a.listing_id").alias("la"), F.col("b.listing_id").alias("lb"), F.col("a.listed_price").alias("hi"), F.col("b.listed_price").alias("lo"),
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("condition", "delivery_charge", "ram", "storage", "processor", "screen_size")],
        C.match_verdict(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("v")).where("v in ('MATCHED', 'PROBABLE_MATCH')").collect()
    best, of = {}, dict(offers)
    for r in pairs:
        gap = r.hi - r.lo
        if float(gap) / float(r.lo) * 100 < 5:
            continue
        fields = [(r[f"a_{c}"], r[f"b_{c}"]) for c in ("ram", "storage", "processor", "screen_size")]
        if any(x and y and x.lower() != y.lower() for x, y in fields):
            why = "variant"
        elif (r.a_condition or "new") != (r.b_condition or "new"):
            why = "condition"
        elif 4 * max(of.get(r.la, 0), of.get(r.lb, 0)) >= 3 * gap:
            why = "offer"
        elif 4 * abs((r.a_delivery_charge or 0) - (r.b_delivery_charge or 0)) >= 3 * gap:
            why = "fee"
        else:
            why = "unexplained"
        key = (r.la, why)
        best[key] = min(best.get(key, (10**9, 0)), (r.lo, r.lb))
    got = C.price_inconsistencies(f, spark.createDataFrame(offers, "listing_id long, best_offer double")).collect()
    assert {(x.listing_id, x.explanation): (x.price_low, x.cheapest_listing) for x in got} == best
    assert len(got) == len(best) and {k for _, k in best} == {"variant", "condition", "offer", "fee", "unexplained"}


def test_partners_are_kept_in_short_rows_and_written_once(spark, monkeypatch):
    """Two written tables, no longer one row per listing, key and price; keys travel as 16 bytes."""
    kept = []
    monkeypatch.setattr(C, "written", lambda df, kind: kept.append((kind, df.schema)) or df)
    monkeypatch.setattr(C, "cut_lineage", lambda df: kept.append(("cut", df.schema)) or df)
    fp = spark.createDataFrame(
        [(1, k, "brand", "8GB", "256GB", 100.0 + k) for k in range(3)], "compare_id long, listing_id long, brand string, ram string, storage string, listed_price double")
    for c in {*C.X.MATCH_IDS, *C.X.MATCH_ATTRS, "condition", "seller", "status", "delivery_charge"} - set(fp.columns):
        fp = fp.withColumn(c, C.F.lit("CAPTURED") if c == "status" else C.F.lit(None).cast("string"))
    rows = C.price_inconsistencies(fp, spark.createDataFrame([], "listing_id long, best_offer double"))
    assert [k for k, _ in kept] == ["listings", "partners"]
    assert "binary" in kept[0][1]["keys"].dataType.simpleString() and kept[1][1]["cls"].dataType.simpleString() == "binary"
    assert rows.count() == 0  # gaps below the threshold


def mixed_listings(rnd, n):
    """Listings of one large comparison, small ones and none, with repeated and null ids."""
    rows = []
    for i in range(n):
        some = lambda v: rnd.choice(v) if rnd.random() < 0.25 else None
        title = f"Acer {rnd.choice(['8GB RAM', '16GB RAM', ''])} 256GB SSD {rnd.choice(['Ryzen 5', 'Core i7', ''])} {rnd.choice(['14 inch', ''])}"
        rows.append(listing(i if i else None, title, rnd.choice([100, 120, 126, 150, None, rnd.randint(90, 400)]), brand=rnd.choice([None, "Acer", " ACER", "Dell"]), sku=some(["A", "b", ""]), mpn=some(["M", "N"]),
                            gtin=some(["1", "2"]), condition=rnd.choice([None, "new", "refurbished"]), delivery=rnd.choice([0, 20, 90]), seller=rnd.choice(["S", None]), group=rnd.choice([1, 1, 2, 3, None])))
    return rows + rows[3:6]


@pytest.mark.parametrize("find", [
    lambda f, o: C.price_inconsistencies(f, o), lambda f, o: C.comparable_partners(f).select("compare_id", "listing_id", "n_matched", "n_probable", "cheapest", "product_match")])
def test_pairs_and_keys_give_the_same_rows(spark, monkeypatch, find):
    rnd = random.Random(21)
    f = fp(spark, *mixed_listings(rnd, 120)).cache()
    o = spark.createDataFrame([(i, rnd.choice([5.0, 30.0, 75.0])) for i in range(0, 120, 2)], "listing_id long, best_offer double")
    found = []
    for most in (0, 30, 1000):
        monkeypatch.setattr(C, "MOST_PAIRED", most)
        found.append(sorted(map(repr, find(f, o).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_small_comparisons_are_matched_without_rows_per_key(spark, monkeypatch):
    kept, plain = {}, C.written
    monkeypatch.setattr(C, "written", lambda df, kind: kept.setdefault(kind, plain(df, kind)))
    t = "Acer 8GB RAM 256GB SSD Ryzen 5"
    assert len(inconsistencies(spark, [listing(i, t, 100 + 50 * (i % 3), group=i // 3) for i in range(30)])) == 20
    assert kept["listings"].count() == 30 and kept["partners"].count() == 0


def test_a_comparison_keeps_its_tables_as_parquet(spark):
    """Columns and compressed, not rows as Java writes them; offers are those of extract_offers."""
    rows = spark.createDataFrame([listing(i, "Acer 8GB RAM 256GB SSD Ryzen 5", 100 + 50 * i) for i in range(3)], LISTING)
    texts = spark.createDataFrame([(0, "Use code ABCD for ₹500 off\nUse code ABCD for ₹500 off")], "listing_id long, text string")
    reviews = spark.createDataFrame([(1, 1, 1, "A hidden charge was added.")], "review_id long, listing_id long, compare_id long, text string")
    out = comparison.compare_listings(rows, texts, reviews)
    assert all(f.endswith(".parquet") for name in ("fingerprints", "offers") for f in out[name].inputFiles()) and out["fingerprints"].inputFiles()
    assert out["offers"].collect() == C.extract_offers(texts).collect() and out["fingerprints"].count() == 3
    assert {(r.listing_id, r.explanation) for r in out["inconsistencies"].collect()} == {(1, "offer"), (2, "offer"), (2, "unexplained")}
