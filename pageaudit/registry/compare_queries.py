"""Queries over listings: fingerprints, matching, offers, reviews, summaries."""

from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.operators import compare as C
from pageaudit.operators import scores
from pageaudit.registry.base import query, rx
from pageaudit.registry.views import view
from pageaudit.sources.dims import dim_marketplaces
from pageaudit.sources.tables import table


def listings(spark, sf):
    return view(spark, sf, "v_listings")


def fingerprints(spark, sf):
    return C.with_fingerprint(listings(spark, sf))


_MP = "CASE " + " ".join(f"WHEN contains(lower(url), '{d}') THEN '{k}'" for k, _, d in X.MARKETPLACES) + " ELSE 'unknown' END"


@query("s4_marketplace", f"SELECT listing_id, {_MP} AS marketplace FROM v_listings")
def _(spark, sf):
    return listings(spark, sf).select("listing_id", T.marketplace_of(F.col("url")).alias("marketplace"))


@query("s4_marketplace_lookup", f"SELECT m AS marketplace, count(*)::BIGINT AS n FROM (SELECT {_MP} AS m FROM v_listings) x GROUP BY m")
def _(spark, sf):
    m = listings(spark, sf).select(T.marketplace_of(F.col("url")).alias("marketplace")).groupBy("marketplace").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(dim_marketplaces(spark)), "marketplace", "left").select("marketplace", "n")


# fingerprint in the checking engine: alternatives without look-ahead, capture and filter
_TEXT = "(coalesce(title, '') || ' ')"
_ST_X = f"regexp_extract({_TEXT}, {rx(X.RX_STORAGE)}, ['n', 'u', 'k'])"
_ST_ALL = r"regexp_extract_all(" + _TEXT + r", '(?i)(\d+\s*(?:gb|tb))(\s*ram)?', 0)"
_NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9_\s]', ' ', 'g'), {rx(X.RX_TITLE_NOISE)}, ' ', 'g'), '\s+', ' ', 'g'))"""
FP = rf"""fp0 AS (SELECT *, CASE WHEN {_ST_X}['n'] <> '' THEN {_ST_X}['n'] || upper({_ST_X}['u']) || ' ' || upper({_ST_X}['k'])
   ELSE upper(replace(list_filter({_ST_ALL}, lambda x: NOT regexp_matches(x, '(?i)ram$'))[1], ' ', '')) END AS storage,
   regexp_extract({_TEXT}, {rx(X.RX_RAM)}, 1) AS ram_x,
   list_transform(list_filter(regexp_extract_all({_TEXT}, '(?i)\b\d+\s*gb\b(?:\s*(?:ssd|hdd|storage|nvme|rom))?'), lambda x: NOT regexp_matches(x, '(?i)(ssd|hdd|storage|nvme|rom)$')),
     lambda x: regexp_extract(x, '\d+')) AS ram_l,
   nullif(lower(trim(regexp_extract({_TEXT}, {rx(X.RX_PROCESSOR)}))), '') AS processor,
   CASE WHEN regexp_matches({_TEXT}, {rx(X.RX_SCREEN)}) THEN regexp_extract({_TEXT}, {rx(X.RX_SCREEN)}, 1) || ' inch' END AS screen_size,
   nullif(lower(regexp_extract({_TEXT}, {rx(X.RX_COLOR)})), '') AS color,
   coalesce(brand, split_part(title, ' ', 1)) AS b2, lower({_NORM}) AS normalized_title FROM v_listings),
 fp1 AS (SELECT * EXCLUDE (brand), b2 AS brand, CASE WHEN ram_x <> '' THEN ram_x || 'GB'
   ELSE list_filter(ram_l, lambda n: storage IS NULL OR NOT contains(lower(storage), n || 'gb'))[1] || 'GB' END AS ram FROM fp0),
 fp AS (SELECT *, array_to_string(string_split(trim(substr(title, length(brand) + 1)), ' ')[1:4], ' ') AS model,
   round(least(0.95, 0.35 + 0.10::DOUBLE * ((sku IS NOT NULL)::INT + (mpn IS NOT NULL)::INT + (gtin IS NOT NULL)::INT + (ram IS NOT NULL)::INT + (storage IS NOT NULL)::INT + (processor IS NOT NULL)::INT) + 0.15), 2)::DOUBLE AS extraction_confidence FROM fp1)"""


@query("f1_normalise_title", f"SELECT listing_id, lower({_NORM}) AS normalized_title FROM v_listings")
def _(spark, sf):
    return listings(spark, sf).select("listing_id", T.normalise_title(F.col("title")).alias("normalized_title"))


@query("f3_attributes", f"WITH {FP} SELECT listing_id, ram, storage, processor, screen_size, color FROM fp")
def _(spark, sf):
    return fingerprints(spark, sf).select("listing_id", "ram", "storage", "processor", "screen_size", "color")


@query("f4_fingerprint", f"WITH {FP} SELECT listing_id, brand, nullif(model, '') AS model, extraction_confidence FROM fp")
def _(spark, sf):
    return fingerprints(spark, sf).select("listing_id", "brand", "model", "extraction_confidence")


def jaccard_sql(a, b):
    ta, tb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"(len(list_intersect({ta}, {tb}))::DOUBLE / len(list_distinct(list_concat({ta}, {tb}))))"


def verdict_sql(a="a", b="b"):
    ids = " ".join(
        f"WHEN {a}.{f} IS NOT NULL AND {b}.{f} IS NOT NULL THEN CASE WHEN lower({a}.{f}) = lower({b}.{f}) THEN 'MATCHED' ELSE 'NOT_MATCHED' END" for f in X.MATCH_IDS)
    same = " + ".join(f"coalesce(({a}.{f} = {b}.{f})::INT, 0)" for f in X.MATCH_ATTRS)
    conflict = " OR ".join(f"coalesce({a}.{f} <> {b}.{f}, FALSE)" for f in X.MATCH_ATTRS)
    sim = jaccard_sql(f"{a}.normalized_title", f"{b}.normalized_title")
    br = f"lower({a}.brand) = lower({b}.brand)"
    return f"""CASE {ids} WHEN {conflict} THEN 'NOT_MATCHED' WHEN {br} AND ({same}) >= 3 THEN 'MATCHED' WHEN {br} AND ({same}) = 2 THEN 'PROBABLE_MATCH'
     WHEN {br} AND ({same}) = 1 THEN 'POSSIBLE_MATCH' WHEN {sim} >= 0.85 THEN 'POSSIBLE_MATCH' WHEN {sim} < 0.35 THEN 'NOT_MATCHED' ELSE 'INSUFFICIENT_EVIDENCE' END"""


CANON = """cn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY compare_id ORDER BY extraction_confidence DESC, listing_id) AS rn FROM fp) x WHERE rn = 1)"""


@query("n2_canonical_match", f"""WITH {FP}, {CANON} SELECT b.listing_id, a.listing_id AS canonical_listing,
  CASE WHEN a.listing_id = b.listing_id THEN 'MATCHED' ELSE {verdict_sql()} END AS match_confidence FROM fp b JOIN cn a ON a.compare_id = b.compare_id""")
def _(spark, sf):
    return C.canonical_match(fingerprints(spark, sf)).select("listing_id", "canonical_listing", "match_confidence")


@query("f5_verdict_counts", f"""WITH {FP}, {CANON} SELECT CASE WHEN a.listing_id = b.listing_id THEN 'MATCHED' ELSE {verdict_sql()} END AS match_confidence,
  count(*)::BIGINT AS n FROM fp b JOIN cn a ON a.compare_id = b.compare_id GROUP BY 1""")
def _(spark, sf):
    return C.canonical_match(fingerprints(spark, sf)).groupBy("match_confidence").agg(F.count("*").alias("n"))


@query("f2_title_similarity", f"""WITH {FP}, {CANON} SELECT b.listing_id, round({jaccard_sql('a.normalized_title', 'b.normalized_title')}, 6) AS similarity
  FROM fp b JOIN cn a ON a.compare_id = b.compare_id""")
def _(spark, sf):
    fp = fingerprints(spark, sf)
    lead = F.struct("extraction_confidence", -F.col("listing_id"))
    best = fp.groupBy("compare_id").agg(F.max_by("normalized_title", lead).alias("canonical_title"))
    return fp.join(best, "compare_id").select("listing_id", F.round(T.title_similarity(F.col("canonical_title"), F.col("normalized_title")), 6).alias("similarity"))


PAIRS = f"pr AS (SELECT a.compare_id, a.listing_id AS la, b.listing_id AS lb, {verdict_sql()} AS v FROM fp a JOIN fp b ON a.compare_id = b.compare_id AND a.listing_id <> b.listing_id)"


@query("n1_match_counts", f"""WITH {FP}, {PAIRS} SELECT compare_id, la AS listing_id, count(*) FILTER (WHERE v = 'MATCHED')::BIGINT AS n_matched,
  count(*) FILTER (WHERE v = 'PROBABLE_MATCH')::BIGINT AS n_probable FROM pr GROUP BY compare_id, la HAVING count(*) FILTER (WHERE v IN ('MATCHED', 'PROBABLE_MATCH')) > 0""")
def _(spark, sf):
    """Matching partners per listing; the check counts them over all pairs."""
    p = C.comparable_partners(fingerprints(spark, sf)).where("n_matched + n_probable > 0")
    return p.select("compare_id", "listing_id", "n_matched", "n_probable")


BEST = "bo AS (SELECT listing_id, max(discount_value) AS best_offer FROM oo GROUP BY listing_id)"


def offers_sql():
    """Offers per line, then the first per key."""
    amt = f"try_cast(replace(regexp_extract(line, {rx(X.RX_OFFER_INSTANT)}, 1), ',', '') AS DOUBLE)"
    pct = f"try_cast(regexp_extract(line, {rx(X.RX_OFFER_PCT)}, 1) AS DOUBLE)"
    exc = f"try_cast(replace(regexp_extract(line, {rx(X.RX_OFFER_EXCHANGE)}, 1), ',', '') AS DOUBLE)"
    mn = f"try_cast(replace(regexp_extract(line, {rx(X.RX_OFFER_MIN)}, 1), ',', '') AS DOUBLE)"
    hit = lambda r: f"regexp_matches(line, {rx(r)})"
    plain = "NOT contains(lower(line), 'bank') AND NOT contains(lower(line), 'card')"
    bank = f"trim(regexp_extract(line, {rx(X.RX_OFFER_BANK)}, 1))"
    mem = f"trim(regexp_extract(line, {rx(X.RX_OFFER_MEMBER)}, 1))"
    code = f"upper(regexp_extract(line, {rx(X.RX_OFFER_COUPON)}, 1))"
    return rf"""ln AS (SELECT listing_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line,
   generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS line_no FROM v_offers),
 lk AS (SELECT *, {amt} AS amt, {pct} AS pct, CASE WHEN {hit(X.RX_OFFER_BANK)} THEN 'bank_offer' WHEN {hit(X.RX_OFFER_MEMBER)} THEN 'membership'
   WHEN {hit(X.RX_OFFER_COUPON)} THEN 'coupon' WHEN {hit(X.RX_OFFER_INSTANT)} AND {plain} THEN 'instant' WHEN {hit(X.RX_OFFER_PCT)} AND {plain} THEN 'pct' END AS kind FROM ln),
 ok AS (SELECT listing_id, line_no * 3 + 0 AS seq, 'emi' AS offer_type, 'emi:' || line AS key, NULL::DOUBLE AS discount_value, NULL::DOUBLE AS discount_percentage, TRUE AS is_conditional, FALSE AS is_applicable, '' AS who FROM lk WHERE {hit(X.RX_OFFER_EMI)}
  UNION ALL SELECT listing_id, line_no * 3 + ({hit(X.RX_OFFER_EMI)})::INT, 'exchange', 'exchange:' || coalesce({exc}::VARCHAR, ''), {exc}, NULL, TRUE, FALSE, '' FROM lk WHERE {hit(X.RX_OFFER_EXCHANGE)}
  UNION ALL SELECT listing_id, line_no * 3 + ({hit(X.RX_OFFER_EMI)})::INT + ({hit(X.RX_OFFER_EXCHANGE)})::INT,
    CASE kind WHEN 'instant' THEN 'instant_discount' WHEN 'pct' THEN 'instant_discount' ELSE kind END,
    CASE kind WHEN 'bank_offer' THEN 'bank:' || lower({bank}) || coalesce(amt::VARCHAR, '-') || ':' || coalesce(pct::VARCHAR, '-')
      WHEN 'membership' THEN 'm:' || lower({mem}) || coalesce(amt::VARCHAR, '-') WHEN 'coupon' THEN 'c:' || {code} WHEN 'instant' THEN 'i:' || coalesce(amt::VARCHAR, '-') ELSE 'p:' || pct::VARCHAR END,
    CASE WHEN kind <> 'pct' THEN amt END, CASE WHEN kind IN ('bank_offer', 'coupon', 'pct') THEN pct END,
    CASE WHEN kind IN ('bank_offer', 'membership', 'coupon') THEN TRUE WHEN kind = 'instant' THEN coalesce({mn}, 0) <> 0 ELSE FALSE END,
    CASE WHEN kind IN ('bank_offer', 'membership') THEN FALSE WHEN kind = 'instant' THEN coalesce({mn}, 0) = 0 ELSE TRUE END,
    CASE kind WHEN 'bank_offer' THEN {bank} WHEN 'membership' THEN {mem} WHEN 'coupon' THEN {code} ELSE '' END FROM lk WHERE kind IS NOT NULL),
 oo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, key ORDER BY seq) AS rn FROM ok) x WHERE rn = 1)"""


def offers(spark, sf):
    return C.extract_offers(view(spark, sf, "v_offers"))


@query("f6_offers", f"""WITH {offers_sql()} SELECT listing_id, seq::BIGINT AS seq, offer_type, discount_value, discount_percentage, is_conditional, is_applicable, who FROM oo""")
def _(spark, sf):
    return offers(spark, sf).select(
        "listing_id", F.col("seq").cast("bigint").alias("seq"), "offer_type", "discount_value", "discount_percentage", "is_conditional", "is_applicable",
        F.coalesce("bank", "membership", "coupon_code", F.lit("")).alias("who"))


@query("a11_effective_price", f"""WITH {offers_sql()}, sm AS (SELECT listing_id, sum(discount_value::DECIMAL(14,2)) FILTER (WHERE is_applicable) AS ap,
   sum(discount_value::DECIMAL(14,2)) FILTER (WHERE is_conditional AND NOT is_applicable) AS co, count(*) FILTER (WHERE is_conditional AND NOT is_applicable AND discount_value > 0) AS nc FROM oo GROUP BY listing_id)
  SELECT l.listing_id, listed_price::DOUBLE AS listed_price, delivery_charge::DOUBLE AS fees, coalesce(ap, 0)::DOUBLE AS applicable, coalesce(co, 0)::DOUBLE AS conditional, coalesce(nc, 0)::BIGINT AS n_conditional,
   (listed_price - coalesce(ap, 0) + delivery_charge)::DOUBLE AS payable FROM v_listings l LEFT JOIN sm USING (listing_id) WHERE listed_price > 0""")
def _(spark, sf):
    return C.effective_prices(listings(spark, sf), offers(spark, sf)).drop("compare_id", "note")


_INC = f"""WITH {FP}, {offers_sql()}, {BEST}, cap AS (SELECT fp.*, best_offer FROM fp LEFT JOIN bo USING (listing_id) WHERE status = 'PRODUCT_CAPTURED' AND listed_price > 0),
 pr AS (SELECT a.compare_id, a.listing_id, b.listing_id AS cheapest_listing, {verdict_sql()} AS product_match, a.listed_price AS hi, b.listed_price AS lo,
   coalesce(a.seller = b.seller OR contains(a.seller, b.seller) OR contains(b.seller, a.seller), FALSE) AS same_seller,
   NOT ({' OR '.join(f'coalesce(a.{f} <> b.{f}, FALSE)' for f in X.MATCH_ATTRS)}) AS same_variant,
   coalesce(a.condition, 'new') = coalesce(b.condition, 'new') AS same_condition,
   greatest(coalesce(a.best_offer, 0), coalesce(b.best_offer, 0))::DECIMAL(18,4) AS offer, abs(a.delivery_charge - b.delivery_charge) AS fee
   FROM cap a JOIN cap b ON a.compare_id = b.compare_id AND a.listing_id <> b.listing_id),
 px AS (SELECT *, 4 * offer >= 3 * (hi - lo) AS offer_explains, 4 * fee >= 3 * (hi - lo) AS fee_explains FROM pr
   WHERE product_match IN ('MATCHED', 'PROBABLE_MATCH') AND hi > lo AND (hi - lo)::DOUBLE / lo::DOUBLE * 100 >= 5),
 pe AS (SELECT *, CASE WHEN NOT same_variant THEN 'variant' WHEN NOT same_condition THEN 'condition' WHEN offer_explains THEN 'offer' WHEN fee_explains THEN 'fee' ELSE 'unexplained' END AS explanation FROM px),
 pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, explanation ORDER BY lo, cheapest_listing) AS rn FROM pe) x WHERE rn = 1)
"""


@query("n3_price_inconsistency", _INC + """SELECT compare_id, listing_id, cheapest_listing, product_match, hi::DOUBLE AS price_high, lo::DOUBLE AS price_low, (hi - lo)::DOUBLE AS price_delta,
  floor((hi - lo)::DOUBLE / lo::DOUBLE * 100 * 10 + 0.5) / 10 AS price_delta_pct, same_seller, same_variant, same_condition, offer_explains, fee_explains, explanation FROM pk""")
def _(spark, sf):
    """Listings dearer than a comparable listing, per explanation of the gap; the check looks at all pairs."""
    return C.price_inconsistencies(fingerprints(spark, sf), C.best_offers(C.extract_offers(view(spark, sf, "v_offers"), ["discount_value"])))


_REV_KIND = "CASE " + " ".join(f"WHEN regexp_matches(s, {rx(p)}) THEN '{n}'" for p, n in X.REVIEW_SIGNALS) + " END"
REV = rf"""sn AS (SELECT review_id, listing_id, compare_id, unnest(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw,
   generate_subscripts(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS pos FROM v_reviews),
 sg AS (SELECT review_id, listing_id, compare_id, pos::BIGINT AS pos, s AS snippet, {_REV_KIND} AS signal_type FROM (SELECT *, trim(raw) AS s FROM sn) y WHERE s <> '')"""


@query("f7_review_signals", f"WITH {REV} SELECT review_id, pos, snippet, signal_type FROM sg WHERE signal_type IS NOT NULL")
def _(spark, sf):
    return C.review_signals(view(spark, sf, "v_reviews")).select("review_id", F.col("pos").cast("bigint").alias("pos"), "snippet", "signal_type")


@query("a10_review_clusters", f"""WITH {REV} SELECT compare_id, signal_type, count(*)::BIGINT AS review_count, arg_min(snippet, review_id * 100 + pos) AS snippet,
  round(least(0.95, 0.6 + count(*) * 0.1::DOUBLE), 2)::DOUBLE AS confidence FROM sg WHERE signal_type IS NOT NULL GROUP BY compare_id, signal_type""")
def _(spark, sf):
    return C.review_clusters(C.review_signals(view(spark, sf, "v_reviews")))


@query("k6_review_evidence", f"""WITH {REV}, cl AS (SELECT compare_id, signal_type, count(*) AS n FROM sg WHERE signal_type IS NOT NULL GROUP BY compare_id, signal_type)
  SELECT r.compare_id, coalesce(sum(n), 0)::BIGINT AS total_signals, CASE WHEN coalesce(sum(n), 0) >= 3 THEN 'CORROBORATED' WHEN sum(n) >= 1 THEN 'WEAK_SIGNAL' ELSE 'CLEAN' END AS corroboration,
   coalesce(string_agg(signal_type, ',' ORDER BY n DESC, signal_type), '') AS concerns FROM (SELECT DISTINCT compare_id FROM v_reviews) r LEFT JOIN cl ON cl.compare_id = r.compare_id GROUP BY r.compare_id""")
def _(spark, sf):
    v = view(spark, sf, "v_reviews")
    return C.review_evidence(C.review_clusters(C.review_signals(v)), comparisons=v)


@query("a13_comparison_summary", f"""WITH {offers_sql()}, sm AS (SELECT listing_id, sum(discount_value::DECIMAL(14,2)) FILTER (WHERE is_applicable) AS ap FROM oo GROUP BY listing_id),
 l AS (SELECT l0.*, listed_price - coalesce(ap, 0) + delivery_charge AS payable, status = 'PRODUCT_CAPTURED' AS okk FROM v_listings l0 LEFT JOIN sm USING (listing_id))
 SELECT compare_id, count(*)::BIGINT AS n_listings, count(*) FILTER (WHERE okk)::BIGINT AS captured, count(*) FILTER (WHERE NOT okk)::BIGINT AS blocked,
  CASE WHEN count(*) FILTER (WHERE okk) = 0 THEN 'ERROR' WHEN count(*) FILTER (WHERE NOT okk) > 0 THEN 'PARTIAL' ELSE 'DONE' END AS status,
  (list(listing_id ORDER BY payable, listing_id) FILTER (WHERE okk))[1] AS cheapest_listing, min(payable) FILTER (WHERE okk)::DOUBLE AS lowest_payable,
  (list(listing_id ORDER BY findings_count, listing_id) FILTER (WHERE okk))[1] AS cleanest_listing FROM l GROUP BY compare_id""")
def _(spark, sf):
    ls = listings(spark, sf)
    pay = C.effective_prices(ls, offers(spark, sf)).select("listing_id", "payable")
    return C.comparison_summary(ls.join(pay, "listing_id", "left"))


@query("f11_seller_equality", """SELECT kind, n_matching::BIGINT AS n_matching, count(*)::BIGINT AS n FROM (SELECT l.listing_id, kind,
   (lower(l.seller) = lower(s.s_name) OR contains(lower(l.seller), lower(s.s_name)) OR contains(lower(s.s_name), lower(l.seller)))::INT AS n_matching
   FROM v_listings l, (VALUES ('own', 0), ('next', 1)) k(kind, step), (SELECT min(s_suppkey) AS lo, count(*) AS m FROM supplier) r
   JOIN supplier s ON s.s_suppkey = r.lo + (l.listing_id % 1000000 - r.lo + k.step) % r.m) x GROUP BY 1, 2""")
def _(spark, sf):
    """Each listing with its own supplier and the next one, over all supplier keys."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    lo, m = s.agg(F.min("s_suppkey"), F.count("*")).first()
    pairs = listings(spark, sf).select("listing_id", "seller", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("step")) for n, k in enumerate(("own", "next"))])))
    j = pairs.withColumn("s_suppkey", F.lit(lo) + (F.col("listing_id") % 1000000 - lo + F.col("step")) % m).join(s, "s_suppkey")
    same = C.same_seller(F.lower("seller"), F.lower("s_name")).cast("int").alias("n_matching")
    return j.select("kind", same).groupBy("kind", "n_matching").agg(F.count("*").alias("n"))


_SIG = lambda ps: "CASE WHEN " + " OR ".join(f"list_contains(seen, '{p}')" for p in ps) + " THEN 'SIGNAL' ELSE 'CLEAR' END"


def _a8_sql():
    from pageaudit.registry.text_queries import findings_sql
    dims = ", ".join(f"CASE WHEN NOT ev THEN 'NOT_EVALUATED' ELSE {_SIG(ps)} END AS {n}" for n, ps in X.LISTING_DIMENSIONS)
    return f"""WITH f AS ({findings_sql()}), g AS (SELECT page_id, list_distinct(list(pattern)) AS seen FROM f GROUP BY page_id),
     t AS (SELECT p.page_id, coalesce(seen, []) AS seen, p.page_id % 5 > 0 AS ev FROM v_text p LEFT JOIN g ON g.page_id = p.page_id)
     SELECT page_id, {dims}, CASE WHEN ev THEN 38 ELSE 0 END::BIGINT AS journey_coverage FROM t"""


@query("a8_listing_transparency", _a8_sql())
def _(spark, sf):
    from pageaudit.registry.text_queries import findings
    seen = findings(spark, sf, keep_clean=True).groupBy("page_id").agg(F.collect_set("pattern").alias("seen"))
    dims = scores.listing_transparency(F.col("page_id") % 5 > 0, F.col("seen"), F.lit(38))
    return seen.select("page_id", *dims)


@query("q3_compare", f"""{_INC}, ic AS (SELECT compare_id, count(*) AS n FROM pk GROUP BY compare_id),
  {REV}, re AS (SELECT compare_id, count(*) AS n FROM sg WHERE signal_type IS NOT NULL GROUP BY compare_id)
  SELECT l.compare_id, count(*)::BIGINT AS n_listings, coalesce(any_value(ic.n), 0)::BIGINT AS n_inconsistent, coalesce(any_value(re.n), 0)::BIGINT AS total_signals
  FROM v_listings l LEFT JOIN ic ON ic.compare_id = l.compare_id LEFT JOIN re ON re.compare_id = l.compare_id GROUP BY l.compare_id""")
def _(spark, sf):
    """The comparison plan, its parts put next to each other per comparison."""
    from pageaudit.plans.comparison import compare_listings
    out = compare_listings(listings(spark, sf), view(spark, sf, "v_offers"), view(spark, sf, "v_reviews"))
    n = out["inconsistencies"].groupBy("compare_id").agg(F.count("*").alias("n_inconsistent"))
    s = out["summary"].select("compare_id", "n_listings").join(n, "compare_id", "left").join(
        out["review_evidence"].select("compare_id", "total_signals"), "compare_id", "left")
    return s.fillna(0)
