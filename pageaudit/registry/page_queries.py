"""Queries over HTML: structure, element rules, prices, journeys, sites."""

from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.operators import element_rules as ER
from pageaudit.operators import evaluate
from pageaudit.operators import prices as P
from pageaudit.operators import reached, site
from pageaudit.operators import structure as H
from pageaudit.operators.classify import platform
from pageaudit.plans import audit
from pageaudit.registry.base import query
from pageaudit.registry.journey_queries import VERDICT
from pageaudit.registry.views import view
from pageaudit.sources.dims import dim_source_weights
from pageaudit.sources.tables import as_snapshots, table


def stored(spark, sf):
    """The stored pages, parsed."""
    return H.parse_pages(table(spark, sf, "pages"))


def html(spark, sf):
    return view(spark, sf, "v_html").drop("p", "n")


def shop(spark, sf, parts=tuple(H.STRUCTURE), with_platform=True):
    """The derived shop pages, parsed; ``parts`` as in ``parse_pages``. The shop system is looked for in the HTML only if asked for."""
    v = html(spark, sf).withColumn("visible_text", F.lit(None).cast("string"))
    return H.parse_pages(v.withColumn("platform", platform(F.col("html"), F.col("url"))) if with_platform else v, parts)


_UNESC = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_COUNT = lambda rx: f"len(regexp_extract_all(html, '{rx}'))::BIGINT"


@query("h10_page_profile", f"""SELECT page_id, {_COUNT('<[a-z][a-z0-9]*[ >]')} AS n_elements, 0::BIGINT AS n_forms, 0::BIGINT AS n_inputs, 0::BIGINT AS n_buttons,
  {_COUNT('<a ')} AS n_links, {_COUNT('<li>')} AS n_items, {_COUNT('<p>')} AS n_paragraphs, {_COUNT('<script')} AS n_scripts FROM pages""")
def _(spark, sf):
    return H.page_profile(stored(spark, sf))


@query("h1_elements", f"""SELECT page_id, {_COUNT('<[a-z][a-z0-9]*[ >]')} AS n, {_COUNT('<[a-z][a-z0-9]*[ >]')} - 1 AS last_pos,
  ({_COUNT('<li>')} * 4)::BIGINT AS li_depth FROM pages""")
def _(spark, sf):
    e = H.elements_table(stored(spark, sf))
    return e.groupBy("page_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"),
                                    F.coalesce(F.sum(F.when(F.col("tag") == "li", F.col("depth"))), F.lit(0)).alias("li_depth"))


@query("h2_visible", f"SELECT page_id, {_COUNT('<[a-z][a-z0-9]*[ >]')} - 5 AS n_visible, 5::BIGINT AS n_hidden FROM pages")
def _(spark, sf):
    e = H.elements_table(stored(spark, sf))
    return e.groupBy("page_id").agg(F.count_if(~F.col("hidden")).alias("n_visible"), F.count_if("hidden").alias("n_hidden"))


@query("h3_text_lines", r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
  u AS (SELECT page_id, unnest(string_split(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10))) AS x FROM b)
  SELECT page_id, count(*)::BIGINT AS n_lines, sum(length(trim(x)))::BIGINT AS n_chars FROM u WHERE trim(x) <> '' GROUP BY page_id""")
def _(spark, sf):
    t = H.text_lines(stored(spark, sf))
    return t.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("s1_text_fallback", None)
def _(spark, sf):
    p = H.parse_pages(as_snapshots(html(spark, sf)))
    return p.select("page_id", F.length(H.snapshot_text()).alias("n_chars"))


@query("h4_checkbox_labels", """SELECT n AS page_id, n % 5 <> 2 AS checked, CASE n % 5 WHEN 1 THEN 'Add insurance ₹199' WHEN 2 THEN 'Donation to a foundation ₹10'
  ELSE 'Send me the newsletter' END AS label FROM v_html WHERE n % 5 IN (1, 2, 3)""")
def _(spark, sf):
    return H.checkbox_labels(shop(spark, sf, H.Parts(("elements", "nodes"), ("pos", "parent", "last", "tag", "attrs", "after", "t0", "t1", "label")), False)).select("page_id", "checked", "label")


@query("n4_labels_by_for", "SELECT n AS page_id, 'c1' AS id, 'Donation to a foundation ₹10' AS label FROM v_html WHERE n % 5 = 2")
def _(spark, sf):
    return H.labels_by_for(shop(spark, sf, H.Parts(("elements", "nodes"), ("id", "t0", "t1", "label")), False))


@query("h5_struck", "SELECT n AS page_id, 's' AS tag, 'old-price' AS cls FROM v_html")
def _(spark, sf):
    return H.elements_table(shop(spark, sf, H.Parts(("elements",), ("tag", "cls", "struck")))).where("struck").select("page_id", "tag", "cls")


@query("n5_ancestors", "SELECT n AS page_id, 2::BIGINT AS links_in_header, CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END::BIGINT AS links_elsewhere FROM v_html")
def _(spark, sf):
    anchors = F.filter("elements", lambda e: e["tag"] == "a")
    flags = F.transform(anchors, lambda e: H.inside(e, ("header",)))
    return shop(spark, sf).select("page_id", F.size(F.filter(flags, lambda x: x)).alias("links_in_header"),
                                  F.size(F.filter(flags, lambda x: ~x)).alias("links_elsewhere"))


@query("h6_links", """WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS seq FROM pages)
  SELECT page_id, seq::BIGINT AS seq, href, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS dst_url, TRUE AS same_host FROM h""")
def _(spark, sf):
    return H.links(stored(spark, sf)).select("page_id", "seq", "href", "dst_url", "same_host")


@query("h6_links_shop", """SELECT n AS page_id, 0::BIGINT AS seq, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' AS dst_url, TRUE AS same_host FROM v_html
  UNION ALL SELECT n, 1, 'https://other.example.net/x', FALSE FROM v_html
  UNION ALL SELECT n, 2, regexp_replace(url, '[^/]*$', '') || 'skip?x=1', TRUE FROM v_html WHERE n % 13 = 0""")
def _(spark, sf):
    return H.links(shop(spark, sf, H.Parts(("elements",), ("tag", "attrs")), False)).select("page_id", "seq", "dst_url", "same_host")


@query("h7_redact", "SELECT n AS page_id, 'pw' AS name, FALSE AS has_value FROM v_html WHERE n % 9 = 4 UNION ALL SELECT n, 'qty', TRUE FROM v_html WHERE n % 9 = 4")
def _(spark, sf):
    e = H.elements_table(H.redact(shop(spark, sf, H.Parts(("elements",), ("tag", "attrs")), False)))
    named = e.where((F.col("tag") == "input") & F.map_contains_key("attrs", "name"))
    return named.select("page_id", F.element_at("attrs", "name").alias("name"), F.map_contains_key("attrs", "value").alias("has_value"))


@query("h8_identity", f"""WITH t AS (SELECT page_id, trim({_UNESC.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS h FROM pages)
  SELECT page_id, CASE WHEN length(h) > 3 THEN h ELSE 'Target Product' END AS title FROM t""")
def _(spark, sf):
    return H.identity(stored(spark, sf)).select("page_id", "title")


@query("h8_identity_shop", "SELECT n AS page_id, 'Item number ' || n AS title, '.product-info-main' AS container FROM v_html")
def _(spark, sf):
    return H.identity(shop(spark, sf))


@query("h9_unrelated", "SELECT n AS page_id, 2::BIGINT AS n_unrelated FROM v_html")
def _(spark, sf):
    blocks = F.filter("elements", lambda e: e["tag"].isin("header", "footer", "h1", "div") & (e["depth"] < 4))
    return shop(spark, sf).select("page_id", F.size(F.filter(
        blocks, lambda e: H.in_unrelated_section(e["tag"], e["id"], F.lit("")))).alias("n_unrelated"))


@query("x1_json_walk", """SELECT n AS page_id, 0::BIGINT AS ord, 0::BIGINT AS depth, '$.page' AS path, NULL AS value FROM v_html WHERE n % 6 = 2
  UNION ALL SELECT n, 1, 1, '$.page.mrp', (p + 500)::VARCHAR FROM v_html WHERE n % 6 = 2
  UNION ALL SELECT n, 2, 1, '$.page.item', NULL FROM v_html WHERE n % 6 = 2
  UNION ALL SELECT n, 3, 2, '$.page.item.sellingPrice', p::VARCHAR FROM v_html WHERE n % 6 = 2""")
def _(spark, sf):
    return shop(spark, sf, ("state",), False).select("page_id", F.inline("state")).select("page_id", "ord", "depth", "path", "value")


@query("m1_attribute_map", """SELECT n AS page_id, 'style' AS name, 'font-size: 9px' AS value FROM v_html WHERE n % 13 = 0 UNION ALL SELECT n, 'class', 'skip' FROM v_html WHERE n % 13 = 0
  UNION ALL SELECT n, 'href', 'skip?x=1' FROM v_html WHERE n % 13 = 0""")
def _(spark, sf):
    e = H.elements_table(shop(spark, sf, H.Parts(("elements",), ("tag", "cls", "attrs")), False)).where("tag = 'a' and cls = 'skip'")
    return e.select("page_id", F.explode("attrs").alias("name", "value"))


# --- element rules -------------------------------------------------------------------

_TIMER = "CASE n % 7 WHEN 0 THEN '04:3' || (n % 10) WHEN 1 THEN 'Expires in 12:30 hrs' END"
_FOLLOWED = "(n % 13 = 0 OR n % 5 IN (1, 2, 3) OR n % 8 = 5)"
_SHAME = f"""CASE WHEN {_FOLLOWED} THEN 'No thanks, I hate saving money' ELSE 'Item number ' || n || '₹' || (p + 500) ||
  (CASE n % 4 WHEN 1 THEN 'now' WHEN 2 THEN '₹' || p WHEN 3 THEN 'Offer price: ₹' || p ELSE '' END) ||
  (CASE n % 7 WHEN 0 THEN '04:3' || (n % 10) WHEN 1 THEN 'Expires in 12:30 hrs' WHEN 2 THEN '06:15 AM' ELSE '' END) || 'No thanks, I hate saving money' END"""


def rule_rows(spark, sf, rule):
    f = ER.detect_elements(shop(spark, sf, H.RULE_PARTS, False)).where(F.col("rule_id") == rule)
    return f.select("page_id", "confidence_tier", F.array_join("snippets", "|").alias("snippets"))


@query("r1_countdown", f"SELECT n AS page_id, 'LOW' AS confidence_tier, {_TIMER} AS snippets FROM v_html WHERE n % 7 < 2")
def _(spark, sf):
    return rule_rows(spark, sf, "FU_COUNTDOWN_TIMER")


@query("r5_preticked", "SELECT n AS page_id, 'MEDIUM' AS confidence_tier, 'Add insurance ₹199' AS snippets FROM v_html WHERE n % 5 = 1")
def _(spark, sf):
    return rule_rows(spark, sf, "BS_PRE_TICKED_CHECKBOX")


@query("r6_confirm_shaming", f"SELECT n AS page_id, 'MEDIUM' AS confidence_tier, {_SHAME} AS snippets FROM v_html WHERE n % 11 = 0")
def _(spark, sf):
    return rule_rows(spark, sf, "CS_SHAME_DECLINE")


@query("r7_visual_asymmetry", "SELECT n AS page_id, 'HIGH' AS confidence_tier, 'Skip (style: font-size: 9px)' AS snippets FROM v_html WHERE n % 13 = 0")
def _(spark, sf):
    return rule_rows(spark, sf, "II_VISUAL_ASYMMETRY")


# every finding the derived shop pages hold
PAGE_FINDINGS = """pf AS (SELECT n, scan_id, stage, 'FU_COUNTDOWN_TIMER' AS rule_id, 'FALSE_URGENCY' AS pattern, 0.65::DOUBLE AS confidence, 'LOW' AS confidence_tier, 'medium' AS severity FROM v_html WHERE n % 7 < 2
  UNION ALL SELECT n, scan_id, stage, 'BS_PRE_TICKED_CHECKBOX', 'BASKET_SNEAKING', 0.85, 'MEDIUM', 'high' FROM v_html WHERE n % 5 = 1
  UNION ALL SELECT n, scan_id, stage, 'CS_SHAME_DECLINE', 'CONFIRM_SHAMING', 0.88, 'MEDIUM', 'high' FROM v_html WHERE n % 11 = 0
  UNION ALL SELECT n, scan_id, stage, 'II_VISUAL_ASYMMETRY', 'INTERFACE_INTERFERENCE', 0.86, 'HIGH', 'high' FROM v_html WHERE n % 13 = 0
  UNION ALL SELECT n, scan_id, stage, 'FU_SCARCITY_CLAIM', 'FALSE_URGENCY', 0.70, 'MEDIUM', 'medium' FROM v_html WHERE n % 8 = 5
  UNION ALL SELECT n, scan_id, stage, 'FU_DEADLINE_TEXT', 'FALSE_URGENCY', 0.72, 'MEDIUM', 'medium' FROM v_html WHERE n % 7 = 1
  UNION ALL SELECT n, scan_id, stage, 'DP_HIDDEN_FEE_CHECKOUT', 'DRIP_PRICING', 0.80, 'MEDIUM', 'high' FROM v_html WHERE n % 3 > 0)"""


@query("r_all_rules", f"WITH {PAGE_FINDINGS} SELECT n AS page_id, rule_id, pattern, confidence, confidence_tier, severity FROM pf")
def _(spark, sf):
    return ER.detect_all(shop(spark, sf, H.RULE_PARTS, False)).select("page_id", "rule_id", "pattern", "confidence", "confidence_tier", "severity")


@query("w2_prefilter_keeps_all", f"WITH {PAGE_FINDINGS} SELECT rule_id, count(*)::BIGINT AS n FROM pf GROUP BY rule_id")
def _(spark, sf):
    """Findings behind the cheap page test: none may be missing."""
    v = H.parse_pages(html(spark, sf).withColumn("visible_text", F.lit(None).cast("string")), H.RULE_PARTS)
    return ER.detect_all(ER.with_page_text(v).where(ER.may_raise())).groupBy("rule_id").agg(F.count("*").alias("n"))


# --- prices ----------------------------------------------------------------------------

_CAND = """cd AS (SELECT n, p::DOUBLE AS amount, 'json_ld' AS source, 0.95::DOUBLE AS confidence, FALSE AS is_mrp FROM v_html WHERE n % 4 = 0
  UNION ALL SELECT n, p + 500, 'next_data', 0.3, TRUE FROM v_html WHERE n % 6 = 2 UNION ALL SELECT n, p, 'next_data', 95 / 120, FALSE FROM v_html WHERE n % 6 = 2
  UNION ALL SELECT n, p, 'meta_tag', 0.94, FALSE FROM v_html WHERE n % 10 = 1 UNION ALL SELECT n, p, 'adapter', 0.96, FALSE FROM v_html WHERE n % 5 = 0 AND n % 4 = 2)"""


def cand(df):
    return df.select("page_id", "amount", "source", F.round("confidence", 6).alias("confidence"), "is_mrp")


for _name, _fn, _src, _parts in [
    ("p5_jsonld", P.jsonld_candidates, "json_ld", ("scripts",)), ("p6_hydration", P.hydration_candidates, "next_data", ("state",)),
    ("p8_meta", P.meta_candidates, "meta_tag", ("elements",)), ("p9_platform", P.platform_candidates, "adapter", H.PRICE_PARTS),
]:
    @query(_name, f"WITH {_CAND} SELECT n AS page_id, amount, source, round(confidence, 6) AS confidence, is_mrp FROM cd WHERE source = '{_src}'")
    def _(spark, sf, fn=_fn, parts=_parts):
        return cand(fn(shop(spark, sf, parts, parts != ("scripts",))))


@query("k8_candidate_union", f"WITH {_CAND} SELECT n AS page_id, amount, source, round(confidence, 6) AS confidence, is_mrp FROM cd")
def _(spark, sf):
    return cand(P.all_candidates(shop(spark, sf)))


_BEST = "CASE WHEN n % 5 = 0 AND n % 4 = 2 THEN 'adapter' WHEN n % 4 = 0 THEN 'json_ld' WHEN n % 10 = 1 THEN 'meta_tag' ELSE 'next_data' END"


@query("p15_ranked_price", f"""WITH {_CAND} SELECT n AS page_id, any_value(v_html.p)::DOUBLE AS price, any_value({_BEST.replace('n %', 'v_html.n %')}) AS source, count(*)::BIGINT AS n_candidates,
  FALSE AS has_conflict FROM cd JOIN v_html USING (n) GROUP BY n""")
def _(spark, sf):
    r = P.rank_candidates(P.all_candidates(shop(spark, sf)))
    return r.select("page_id", "price", "source", "n_candidates", "has_conflict")


_W = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in X.SOURCE_WEIGHTS) + " ELSE 0.8 END::DOUBLE"
_SCORED = f"""sc AS (SELECT *, confidence * {_W} * (CASE WHEN stage = 'product' THEN 1 ELSE 0.85 END)::DOUBLE AS score,
   NOT is_mrp AND NOT is_discount AND amount > 0 AND belongs_to_product AS ok FROM v_candidates),
  us AS (SELECT *, bool_or(ok) OVER (PARTITION BY page_id) AS any_ok FROM sc WHERE amount > 0 AND NOT is_discount),
  vl AS (SELECT * FROM us WHERE ok OR NOT any_ok)"""


@query("k3_best_candidate", f"""WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS rn FROM vl),
  cf AS (SELECT page_id, count(DISTINCT amount) FILTER (WHERE score >= 0.75::DOUBLE AND source IN ('json_ld', 'network_json', 'adapter', 'dom')) > 1 AS has_conflict FROM vl GROUP BY page_id)
  SELECT page_id, amount::DOUBLE AS price, source, least(0.99, confidence) AS confidence, has_conflict FROM b JOIN cf USING (page_id) WHERE rn = 1""")
def _(spark, sf):
    return P.rank_candidates(view(spark, sf, "v_candidates")).select("page_id", "price", "source", "confidence", "has_conflict")


@query("n6_weight_lookup", f"SELECT source, count(*)::BIGINT AS n, any_value({_W}) AS weight FROM v_candidates GROUP BY source")
def _(spark, sf):
    n = view(spark, sf, "v_candidates").groupBy("source").agg(F.count("*").alias("n"))
    known = n.join(F.broadcast(dim_source_weights(spark)), "source", "left")
    return known.select("source", "n", F.coalesce("weight", F.lit(X.DEFAULT_SOURCE_WEIGHT)).alias("weight"))


@query("p10_product_price", """SELECT n AS page_id, (CASE WHEN n % 4 = 3 THEN p + 500 ELSE p END)::DOUBLE AS total,
  CASE n % 4 WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'MICRODATA' WHEN 2 THEN 'SEMANTIC_SELECTOR' ELSE 'REGEX_PROXIMITY' END AS extraction_source,
  CASE WHEN n % 4 = 3 THEN 'MEDIUM' ELSE 'HIGH' END AS extraction_confidence FROM v_html WHERE n % 3 = 0""")
def _(spark, sf):
    return P.product_price(shop(spark, sf).where("stage = 'product'")).drop("n_rejected")


@query("p11_stage_total", """SELECT n AS page_id, (CASE WHEN n % 4 < 2 THEN p + 50 ELSE p + 60 END)::DOUBLE AS total,
  CASE WHEN n % 4 < 2 THEN 'DOM_SUMMARY_CONTAINER' ELSE 'TOTAL_ANCHOR' END AS extraction_source, CASE WHEN n % 4 < 2 THEN 'HIGH' ELSE 'MEDIUM' END AS extraction_confidence FROM v_html WHERE n % 3 > 0""")
def _(spark, sf):
    return P.stage_total(shop(spark, sf).where("stage <> 'product'"))


_COMP = """cp AS (SELECT n, scan_id, stage, 1 AS seq, 'protection' AS component_type, 199 AS amount, TRUE AS selected_by_default FROM v_html WHERE n % 5 = 1
  UNION ALL SELECT n, scan_id, stage, 2, 'donation', 10, FALSE FROM v_html WHERE n % 5 = 2
  UNION ALL SELECT n, scan_id, stage, 3, 'convenience_fee', 30 + n % 4, TRUE FROM v_html WHERE n % 3 > 0 AND NOT (n % 5 = 2 AND n % 3 = n % 4)
  UNION ALL SELECT n, scan_id, stage, 4, 'tax', 20 + n % 3, TRUE FROM v_html WHERE n % 3 > 0)"""


FEE_PARTS = H.Parts(("elements", "nodes"), ("parent", "tag", "cls", "attrs", "t0", "t1", "up", "box", "label"))


@query("p12_components", f"WITH {_COMP} SELECT n AS page_id, component_type, amount::DOUBLE AS amount, selected_by_default FROM cp")
def _(spark, sf):
    return P.stage_components(shop(spark, sf, FEE_PARTS)).select("page_id", "component_type", "amount", "selected_by_default")


@query("p13_raw_components", """SELECT n AS page_id, (CASE WHEN n % 5 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN n % 3 > 0 THEN 2 ELSE 0 END + CASE WHEN n % 3 > 0 AND n % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM v_html""")
def _(spark, sf):
    return shop(spark, sf, FEE_PARTS, False).select("page_id", F.size(P.dedup_components(P.raw_components())).alias("n"))


@query("p14_dropped_aggregates", """SELECT n AS page_id, (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 5 = 2 AND n % 3 = n % 4 THEN 1 ELSE 0 END)::BIGINT AS n
  FROM v_html WHERE n % 3 > 0 AND (n % 2 = 0 OR (n % 5 = 2 AND n % 3 = n % 4))""")
def _(spark, sf):
    c = shop(spark, sf, FEE_PARTS, False).select("page_id", P.dedup_components(P.raw_components()).alias("c"))
    return c.select("page_id", (F.size("c") - F.size(P.drop_aggregates(F.col("c")))).alias("n")).where("n > 0")


@query("e9_reached", """SELECT n AS page_id, n % 5 = 0 AND n % 3 = 1 AS cart_reached, CASE WHEN n % 3 = 1 THEN 45 ELSE 0 END::DOUBLE AS cart_score,
  CASE WHEN n % 5 > 0 AND n % 3 > 0 THEN (CASE WHEN n % 4 < 2 THEN p + 50 ELSE p + 60 END)::DOUBLE END AS cart_total,
  n % 5 = 0 AND n % 3 = 2 AS checkout_reached, CASE WHEN n % 3 = 2 THEN (CASE WHEN n % 5 = 0 THEN 50 ELSE 45 END) ELSE 0 END::DOUBLE AS checkout_score,
  CASE WHEN n % 5 > 0 AND n % 3 > 0 AND n % 4 < 2 THEN (p + 50)::DOUBLE END AS checkout_total FROM v_html""")
def _(spark, sf):
    return reached.cart_and_checkout(shop(spark, sf, H.Parts(("elements", "nodes"), ("tag", "id", "cls", "classes", "attrs", "t0", "t1", "up"))))


@query("p7_network", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id, url ORDER BY seq) AS rn FROM v_responses
    WHERE (contains(url, 'api') OR contains(url, 'product') OR contains(url, 'cart') OR contains(url, 'graphql')) AND contains(content_type, 'json')),
  c AS (SELECT session_id, seq, 2 AS ord, 'unit_price' AS key, regexp_extract(body, 'unit_price":([0-9]+)', 1)::DOUBLE AS amount FROM r WHERE rn = 1
    UNION ALL SELECT session_id, seq, 5, 'salePrice', regexp_extract(body, '₹([0-9]+)', 1)::DOUBLE FROM r WHERE rn = 1)
  SELECT session_id, seq, key, amount FROM c WHERE amount > 0""")
def _(spark, sf):
    return P.network_candidates(view(spark, sf, "v_responses")).select("session_id", "seq", "key", "amount")


# --- end to end ----------------------------------------------------------------------------

@query("q1_audit_pages", f"""WITH {PAGE_FINDINGS}, g AS (SELECT n, count(*) AS s, count(*) FILTER (WHERE confidence_tier = 'HIGH' OR confidence >= 0.85) AS h,
   count(*) FILTER (WHERE confidence_tier = 'MEDIUM' OR (confidence >= 0.65 AND confidence < 0.85)) AS m, count(*) FILTER (WHERE confidence_tier = 'LOW' OR confidence < 0.65) AS l,
   sum(round_even((CASE pattern WHEN 'FALSE_URGENCY' THEN 15 WHEN 'CONFIRM_SHAMING' THEN 15 WHEN 'INTERFACE_INTERFERENCE' THEN 15 ELSE 20 END) * confidence, 0)) AS pts FROM pf GROUP BY n),
  r AS (SELECT v.n, coalesce(s, 0) AS s, coalesce(h, 0) AS h, coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(pts, 0) AS pts FROM v_html v LEFT JOIN g ON g.n = v.n),
  q AS (SELECT *, least(100, 30 * h + 15 * m + 5 * l)::BIGINT AS risk_score FROM r)
  SELECT n AS page_id, s::BIGINT AS signals_found, risk_score, CASE WHEN h >= 1 OR risk_score >= 50 THEN 'HIGH' WHEN m >= 1 OR risk_score >= 20 THEN 'ELEVATED' ELSE 'LOW' END AS risk_level,
   greatest(0, 100 - round_even(pts * 0.5::DOUBLE, 0))::BIGINT AS transparency FROM q""")
def _(spark, sf):
    v = html(spark, sf).withColumn("visible_text", F.lit(None).cast("string"))
    return audit.audit_pages(v).select("page_id", "signals_found", "risk_score", "risk_level", "transparency")


_HS = """hs AS (SELECT scan_id, stage, (CASE WHEN n % 3 = 0 THEN (CASE WHEN n % 4 = 3 AND n % 10 <> 1 THEN p + 500 ELSE p END) WHEN n % 4 < 2 THEN p + 50 ELSE p + 60 END)::DECIMAL(14,2) AS total, TRUE AS is_captured FROM v_html),
  hc AS (SELECT scan_id, stage, n * 10 + seq AS seq, component_type, component_type AS label, amount::DECIMAL(14,2) AS amount, selected_by_default, FALSE AS is_delivery_dependent, FALSE AS is_aggregate FROM cp)"""
_JOURNEY = f"{_COMP}, {_HS}, {VERDICT}".replace("v_stages", "hs").replace("v_components", "hc")


@query("q2_audit_journeys", f"WITH {_JOURNEY} SELECT scan_id, p0::DOUBLE AS p0, p1::DOUBLE AS p1, p2::DOUBLE AS p2, delta_total::DOUBLE AS delta_total, explained::DOUBLE AS explained, verdict FROM j")
def _(spark, sf):
    j = audit.audit_journeys(html(spark, sf))["journeys"]
    return j.select("scan_id", "p0", "p1", "p2", "delta_total", F.coalesce("explained", F.lit(0)).alias("explained"), "verdict")


_Q2F = f"""{_JOURNEY}, {PAGE_FINDINGS}, fd AS (SELECT DISTINCT scan_id, rule_id, pattern, confidence, confidence_tier FROM pf
  UNION ALL SELECT scan_id, 'DP_JOURNEY', 'DRIP_PRICING', 0.95, 'HIGH' FROM j WHERE verdict = 'DETECTED'),
 gg AS (SELECT scan_id, count(*) AS s, count(*) FILTER (WHERE confidence_tier = 'HIGH' OR confidence >= 0.85) AS h, count(*) FILTER (WHERE confidence_tier = 'MEDIUM' OR (confidence >= 0.65 AND confidence < 0.85)) AS m,
   count(*) FILTER (WHERE confidence_tier = 'LOW' OR confidence < 0.65) AS l,
   sum(round_even((CASE pattern WHEN 'FALSE_URGENCY' THEN 15 WHEN 'CONFIRM_SHAMING' THEN 15 WHEN 'INTERFACE_INTERFERENCE' THEN 15 ELSE 20 END) * confidence, 0)) AS pts FROM fd GROUP BY scan_id),
 st AS (SELECT scan_id, bool_or(stage = 'product') AS has_p FROM v_html GROUP BY scan_id)"""


@query("q2_scan_scores", f"""WITH {_Q2F} SELECT st.scan_id, coalesce(s, 0)::BIGINT AS signals_found, least(100, 30 * coalesce(h, 0) + 15 * coalesce(m, 0) + 5 * coalesce(l, 0))::BIGINT AS risk_score,
  greatest(0, 100 - round_even(coalesce(pts, 0) * 0.5::DOUBLE, 0))::BIGINT AS transparency, verdict, has_p AS product_reached FROM st LEFT JOIN gg USING (scan_id) LEFT JOIN j USING (scan_id)""")
def _(spark, sf):
    s = audit.audit_journeys(html(spark, sf))["scans"]
    return s.select("scan_id", "signals_found", "risk_score", "transparency", "verdict", "product_reached")


@query("q5_evaluate", f"""WITH {PAGE_FINDINGS}, lab AS (SELECT n, 'FALSE_URGENCY' AS pattern, n % 7 < 2 AS expected FROM v_html UNION ALL SELECT n, 'BASKET_SNEAKING', n % 5 IN (1, 3) FROM v_html),
  o AS (SELECT lab.*, x.n IS NOT NULL AS found FROM lab LEFT JOIN (SELECT DISTINCT n, pattern FROM pf) x ON x.n = lab.n AND x.pattern = lab.pattern)
  SELECT pattern, count(*) FILTER (WHERE expected AND found)::BIGINT AS tp, count(*) FILTER (WHERE NOT expected AND found)::BIGINT AS fp, count(*) FILTER (WHERE expected AND NOT found)::BIGINT AS fn,
   count(*) FILTER (WHERE NOT expected AND NOT found)::BIGINT AS tn, floor(count(*) FILTER (WHERE expected = found) / count(*) * 1000 + 0.5) / 10 AS pass_rate FROM o GROUP BY pattern""")
def _(spark, sf):
    v, k = html(spark, sf), F.col("page_id")
    lab = v.select("page_id", F.lit("FALSE_URGENCY").alias("pattern"), (k % 7 < 2).alias("expected")).unionByName(
        v.select("page_id", F.lit("BASKET_SNEAKING").alias("pattern"), (k % 5).isin(1, 3).alias("expected")))
    return evaluate.matrix(evaluate.outcomes(lab, ER.detect_all(shop(spark, sf, H.RULE_PARTS))), "pattern")


@query("s5_labelled_counts", f"""WITH {PAGE_FINDINGS}, lb AS (SELECT n, ((n % 7 < 2)::INT + (n % 5 = 1)::INT + (n % 11 = 0)::INT + (n % 13 = 0)::INT + (n % 8 = 5)::INT + (n % 7 = 1)::INT)::BIGINT AS e FROM v_html)
  SELECT lb.n AS page_id, e AS expected_count, coalesce(k, 0)::BIGINT AS actual_count, e = coalesce(k, 0) AS as_expected FROM lb LEFT JOIN (SELECT n, count(*) AS k FROM pf GROUP BY n) x ON x.n = lb.n""")
def _(spark, sf):
    """Labels leave out the fee rule, so the late stages differ by one."""
    k = F.col("page_id")
    hits = [k % 7 < 2, k % 5 == 1, k % 11 == 0, k % 13 == 0, k % 8 == 5, k % 7 == 1]
    expected = sum((h.cast("bigint") for h in hits), F.lit(0).cast("bigint"))
    labelled = html(spark, sf).select("page_id", expected.alias("expected_count"))
    return evaluate.count_check(labelled, ER.detect_all(shop(spark, sf, H.RULE_PARTS)))


# --- sites -----------------------------------------------------------------------------------

N_SITES = 10


def site_graph(spark, sf):
    """The stored pages laid out as ten sites; page r of a site links to its pages 2r and 2r + 1."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").select("page_id", "html", (k % N_SITES).alias("site"), (F.floor(k / N_SITES) + 1).alias("r"))
    return p.withColumn("host", F.concat(F.lit("site"), F.col("site"), F.lit(".example.com"))).withColumn("url", page_url("r"))


def page_url(rank):
    return F.concat(F.lit("https://"), F.col("host"), F.lit("/page/"), F.col(rank).cast("string"))


def graph_parts(g):
    """Start pages and links; a page's link up its tree is arithmetic, so no join is needed."""
    starts = g.where("r = 1").select("host", "url")
    up = g.where("r > 1").withColumn("up", F.floor(F.col("r") / 2))
    links = up.select(page_url("up").alias("src_url"), (F.col("r") % 2).cast("int").alias("seq"), F.col("url").alias("dst_url"))
    return starts, links


_SITES = f"g AS (SELECT 'site' || (page_id % {N_SITES}) || '.example.com' AS host, page_id // {N_SITES} + 1 AS r FROM pages)"


@query("n9_reachable", f"WITH {_SITES} SELECT host, 'https://' || host || '/page/' || r AS url, floor(log2(r))::BIGINT AS depth FROM g")
def _(spark, sf):
    starts, links = graph_parts(site_graph(spark, sf))
    return site.reachable_pages(starts, links).select("host", "url", "depth")


@query("n9_reachable_nav", """WITH p AS (SELECT page_id, url, html, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
  s AS (SELECT host, arg_min(url, page_id) AS url, arg_min(html, page_id) AS html FROM p GROUP BY host),
  l AS (SELECT host, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM s)
  SELECT host, count(DISTINCT dst)::BIGINT + 1 AS n_visited FROM l WHERE dst <> url GROUP BY host""")
def _(spark, sf):
    """Walk over the real navigation links; they lead to pages that are not stored."""
    p = table(spark, sf, "pages").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    links = H.links(H.parse_pages(p.select("page_id", "url", "html"))).where("same_host").select("src_url", "seq", "dst_url")
    walk = site.reachable_pages(p.groupBy("host").agg(F.min_by("url", "page_id").alias("url")), links)
    return walk.groupBy("host").agg(F.count("*").alias("n_visited"))


_HOST = "regexp_extract(url, '://([^/]+)', 1)"


@query("a9_site_report", f"""WITH {PAGE_FINDINGS}, u AS (SELECT n, {_HOST} AS host FROM v_html), x AS (SELECT host, severity, pf.n, pattern FROM pf JOIN u ON u.n = pf.n)
  SELECT u.host, count(DISTINCT u.n)::BIGINT AS pages_analyzed, coalesce(any_value(t), 0)::BIGINT AS total_findings, 0::BIGINT AS critical, coalesce(any_value(h), 0)::BIGINT AS high, coalesce(any_value(m), 0)::BIGINT AS medium,
   coalesce(any_value(l), 0)::BIGINT AS low, coalesce(any_value(pg), 0)::BIGINT AS pages_requiring_attention, coalesce(any_value(ps), '') AS patterns
  FROM u LEFT JOIN (SELECT host, count(*) AS t, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m, count(*) FILTER (WHERE severity = 'low') AS l,
    count(DISTINCT n) AS pg, array_to_string(list_sort(list(DISTINCT pattern)), ',') AS ps FROM x GROUP BY host) y ON y.host = u.host GROUP BY u.host""")
def _(spark, sf):
    return site.site_report(html(spark, sf).select("url"), ER.detect_all(shop(spark, sf, H.RULE_PARTS)))


@query("s8_site_report_json", f"WITH {PAGE_FINDINGS}, x AS (SELECT {_HOST} AS host, pf.* FROM pf JOIN v_html USING (n)) SELECT host, count(*)::BIGINT AS total_findings FROM x GROUP BY host")
def _(spark, sf):
    """The report written as JSON and read back."""
    from pageaudit.registry.base import scratch
    from pageaudit.sources.sinks import write_site_report
    path = scratch(spark, "site-report")
    write_site_report(site.site_report(html(spark, sf).select("url"), ER.detect_all(shop(spark, sf, H.RULE_PARTS))), path)
    return spark.read.schema("host string, total_findings bigint").json(path)


@query("q4_audit_site", f"""WITH {_SITES}, t AS (SELECT host, count(*)::BIGINT AS pages_analyzed, count_if(r % 3 = 0)::BIGINT AS k FROM g GROUP BY host)
  SELECT host, pages_analyzed, k AS total_findings, 0::BIGINT AS critical, 0::BIGINT AS high, k AS medium, 0::BIGINT AS low, k AS pages_requiring_attention,
  CASE WHEN k > 0 THEN 'FALSE_URGENCY' ELSE '' END AS patterns FROM t""")
def _(spark, sf):
    """Every third page shows a timer; of each page there is a second form with a timer, to which no link leads."""
    g = site_graph(spark, sf)
    starts, links = graph_parts(g)
    timer = F.lit("<div class='timer'>04:32</div>")
    stored = g.select("page_id", "url", F.concat("html", F.when(F.col("r") % 3 == 0, timer).otherwise(F.lit(""))).alias("html"))
    unlinked = g.select((-1 - F.col("page_id")).alias("page_id"), F.concat("url", F.lit("/print")).alias("url"), F.concat("html", timer).alias("html"))
    return audit.audit_site(stored.unionByName(unlinked), links, starts)
