"""Queries over page text: rules, scores, coverage."""

from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.operators import evaluate, rules, scores
from pageaudit.operators.classify import page_state
from pageaudit.registry.base import any_of, query, rx
from pageaudit.registry.views import view
from pageaudit.sources import sinks
from pageaudit.sources.dims import dim_patterns, dim_rules
from pageaudit.sources.tables import table

STATE_SQL = f"""CASE WHEN {any_of('lower(url)', ['/cart', '/basket', '/bag', '/trolley'])} THEN 'cart'
 WHEN {any_of('lower(url)', ['/checkout', '/order-summary', '/review-order'])} THEN
   CASE WHEN {any_of('lower(visible_text)', ['pay now', 'place order', 'upi', 'card number'])} THEN 'payment' ELSE 'checkout' END
 WHEN {any_of('lower(url)', ['/product', '/item', '/dp/', '/p/'])} THEN 'product'
 WHEN {any_of('lower(visible_text)', ['add to cart', 'buy now'])} THEN 'product' ELSE 'unknown' END"""

CATALOGUE = {r[0]: r for r in X.RULES}


def findings_sql(source="v_text", rules_rx=None, client=False):
    """Findings of the text rules as SQL: one UNION ALL branch per rule."""
    parts = []
    for rule, pattern_rx in (rules_rx or X.TEXT_RULE_RX).items():
        _, pattern, _, methods, conf, sev, title, _, _ = CATALOGUE[rule]
        if client:
            conf, sev = X.CLIENT_CONFIDENCE.get(rule, (conf, sev))
            tier = "HIGH" if conf >= 0.85 else "MEDIUM" if conf >= 0.65 else "LOW"
        else:
            tier = "HIGH" if conf >= 0.85 and len(methods) > 1 else "MEDIUM" if conf >= 0.7 or len(methods) > 1 else "LOW"
        hits = f"regexp_extract_all(visible_text, {rx(pattern_rx)})"
        if rule in ("FU_SCARCITY_CLAIM", "DP_HIDDEN_FEE_CHECKOUT"):
            hits = f"list_sort(list_distinct({hits}))"
        extra = f"AND {STATE_SQL} IN ('cart', 'checkout')" if rule == "DP_HIDDEN_FEE_CHECKOUT" else ""
        parts.append(
            f"SELECT page_id, scan_id, stage, url, '{rule}' AS rule_id, '{pattern}' AS pattern, {conf}::DOUBLE AS confidence, "
            f"'{tier}' AS confidence_tier, '{sev}' AS severity, '{title}' AS title, "
            f"array_to_string({hits}, '|') AS snippets FROM {source} "
            f"WHERE regexp_matches(visible_text, {rx(pattern_rx)}) {extra}"
        )
    return " UNION ALL ".join(parts)


FINDINGS = f"f AS ({findings_sql()})"
# first finding per scan, pattern and title; what is kept of it is the same for all of them
DEDUPED = FINDINGS + ", d AS (SELECT scan_id, pattern, title, any_value(confidence) AS confidence, any_value(confidence_tier) AS confidence_tier, any_value(severity) AS severity FROM f GROUP BY scan_id, pattern, title)"
SCANS = "s AS (SELECT scan_id, bool_or(stage = 'product') AS has_p, bool_or(stage = 'cart') AS has_c, bool_or(stage = 'checkout') AS has_o FROM v_text GROUP BY scan_id)"
TIERS = """coalesce(count(pattern), 0)::BIGINT AS signals_found,
 count(*) FILTER (WHERE confidence_tier = 'HIGH' OR confidence >= 0.85)::BIGINT AS high_count,
 count(*) FILTER (WHERE confidence_tier = 'MEDIUM' OR (confidence >= 0.65 AND confidence < 0.85))::BIGINT AS medium_count,
 count(*) FILTER (WHERE confidence_tier = 'LOW' OR confidence < 0.65)::BIGINT AS low_count"""
WEIGHT = "CASE pattern " + " ".join(f"WHEN '{p[0]}' THEN {p[4]}" for p in X.PATTERNS if p[4]) + " ELSE 10 END"
DIM = "CASE pattern " + " ".join(f"WHEN '{p[0]}' THEN '{p[5]}'" for p in X.PATTERNS if p[5]) + " ELSE 'flow_transparency' END"


def pages(spark, sf):
    return view(spark, sf, "v_text")


def findings(spark, sf, **kw):
    return rules.detect_text(pages(spark, sf), **kw)


def deduped(spark, sf):
    from pageaudit.operators.journey import stage_ord
    f = findings(spark, sf).withColumn("stage_ord", stage_ord(F.col("stage")))
    return scores.dedup_findings(f)


def scans(spark, sf):
    return pages(spark, sf).groupBy("scan_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def flat(df):
    keep = ["page_id", "rule_id", "pattern", "confidence", "confidence_tier", "severity", "title"]
    return df.select(*keep, F.array_join("snippets", "|").alias("snippets"))


COLS = "page_id, rule_id, pattern, confidence, confidence_tier, severity, title, snippets"


@query("r_text_rules", f"WITH {FINDINGS} SELECT {COLS} FROM f")
def _(spark, sf):
    return flat(findings(spark, sf))


for _id, _rule in [("r2_scarcity", "FU_SCARCITY_CLAIM"), ("r3_deadline", "FU_DEADLINE_TEXT"), ("r4_social_proof", "FU_SOCIAL_PROOF"),
                   ("r8_subscription_trap", "ST_CANCELLATION_BARRIER"), ("r9_forced_action", "FA_MANDATORY_DOWNLOAD"),
                   ("r10_hidden_fee", "DP_HIDDEN_FEE_CHECKOUT"), ("r11_double_negative", "TW_DOUBLE_NEGATIVE")]:
    @query(_id, f"SELECT {COLS} FROM ({findings_sql(rules_rx={_rule: X.TEXT_RULE_RX[_rule]})}) x")
    def _(spark, sf, rule=_rule):
        return flat(findings(spark, sf).where(F.col("rule_id") == rule))

for _id, _rule in [("r18_mandatory_shipping", "DP_MANDATORY_SHIPPING"), ("r19_fear_copy", "CS_FEAR_BASED_COPY")]:
    @query(_id, f"SELECT {COLS} FROM ({findings_sql(rules_rx={_rule: X.EXTRA_TEXT_RULE_RX[_rule]})}) x")
    def _(spark, sf, rule=_rule):
        return flat(findings(spark, sf, extra=True).where(F.col("rule_id") == rule))


_PROSE = """prose AS (SELECT 'document' AS kind, doc_id AS page_id, '' AS scan_id, '' AS stage, '' AS url, text AS visible_text FROM documents
 UNION ALL SELECT 'turn', conv_id * 1000 + turn, '', '', '', text FROM conversations)"""


@query("r_prose_scan", f"""WITH {_PROSE}, f AS ({findings_sql('prose')}), h AS (SELECT page_id, stage, count(*) AS k FROM f GROUP BY page_id, stage),
  n AS (SELECT kind, visible_text, len(regexp_extract_all(visible_text, '[0-9][0-9,]*')) AS c, coalesce(h.k, 0) AS k FROM prose LEFT JOIN h ON h.page_id = prose.page_id AND h.stage = prose.kind)
SELECT kind, count(*)::BIGINT AS n_texts, sum(length(visible_text))::BIGINT AS n_chars, sum(c)::BIGINT AS n_numbers, sum(k)::BIGINT AS n_findings FROM n GROUP BY kind""".replace("'' AS stage", "'document' AS stage").replace("'turn', conv_id * 1000 + turn, '', ''", "'turn', conv_id * 1000 + turn, '', 'turn'"))
def _(spark, sf):
    """Rules and number extraction over whole prose texts."""
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("page_id"), F.col("text").alias("visible_text"))
    turns = table(spark, sf, "conversations").select(
        F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), F.col("text"))
    both = docs.union(turns).withColumn("url", F.lit(""))
    hits = F.size(rules.text_findings(F.col("visible_text"), page_state(F.col("url"), F.col("visible_text"))))
    return both.withColumn("n_hits", hits).groupBy("kind").agg(
        F.count("*").alias("n_texts"), F.sum(F.length("visible_text")).alias("n_chars"),
        F.sum(F.regexp_count("visible_text", F.lit("[0-9][0-9,]*"))).cast("bigint").alias("n_numbers"), F.sum("n_hits").alias("n_findings"))


@query("s1_snapshots", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, length(html)::BIGINT AS html_chars,
  visible_text IS NULL AS text_missing FROM (SELECT *, NULL AS visible_text FROM pages) p""")
def _(spark, sf):
    from pageaudit.sources.tables import read_pages
    p = read_pages(spark, f"{sf}/pages.parquet")
    return p.select("page_id", "host", F.length("html").alias("html_chars"), F.col("visible_text").isNull().alias("text_missing"))


@query("s2_rule_lookup", f"""WITH {FINDINGS} SELECT rule_id, title, severity, count(*)::BIGINT AS n_findings,
  bool_or(rule_id IN ({', '.join("'" + r[0] + "'" for r in X.RULES if r[8])})) AS requires_state FROM f GROUP BY rule_id, title, severity""")
def _(spark, sf):
    """Findings joined with the rule catalogue, which is small by construction."""
    n = findings(spark, sf).groupBy("rule_id").agg(F.count("*").alias("n_findings"))
    return n.join(F.broadcast(dim_rules(spark)), "rule_id").select("rule_id", "title", "severity", "n_findings", "requires_state")


@query("s3_pattern_lookup", f"""WITH {FINDINGS} SELECT pattern, {DIM} AS dimension, ({WEIGHT})::BIGINT AS weight, count(*)::BIGINT AS n
  FROM f GROUP BY pattern""")
def _(spark, sf):
    n = findings(spark, sf).groupBy("pattern").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(dim_patterns(spark)), "pattern").select("pattern", "dimension", "weight", "n")


@query("e1_user_facing", f"""SELECT doc_id, (NOT {any_of('text', X.CODE_MARKERS)} AND regexp_matches(text, '[A-Za-z0-9]')) AS user_facing FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.user_facing(F.col("text")).alias("user_facing"))


@query("e2_page_state", f"SELECT page_id, {STATE_SQL} AS page_state FROM v_text")
def _(spark, sf):
    return pages(spark, sf).select("page_id", page_state(F.col("url"), F.col("visible_text")).alias("page_state"))


@query("p3_prices_in_text", r"""SELECT doc_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(text, '(?i)[₹₨]?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:rs\.?|inr)?', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)),
  lambda v: v BETWEEN 1 AND 10000000))), lambda v: (v * 100)::BIGINT::VARCHAR), ' '), '') AS cents FROM documents""")
def _(spark, sf):
    cents = F.transform(T.prices_in_text(F.col("text")), lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(cents, " ").alias("cents"))


@query("a1_tier", f"WITH {FINDINGS} SELECT rule_id, confidence, confidence_tier, count(*)::BIGINT AS n FROM f GROUP BY rule_id, confidence, confidence_tier")
def _(spark, sf):
    f = findings(spark, sf).withColumn("tier2", rules.confidence_tier(F.col("confidence"), F.size("methods")))
    return f.groupBy("rule_id", "confidence", F.col("tier2").alias("confidence_tier")).agg(F.count("*").alias("n"))


RISK = f"""r AS (SELECT s.scan_id, any_value(has_c OR has_o) AS coverage_sufficient, {TIERS} FROM s LEFT JOIN d USING (scan_id) GROUP BY s.scan_id),
 rs AS (SELECT *, least(100, 30 * high_count + 15 * medium_count + 5 * low_count)::BIGINT AS risk_score FROM r),
 rl AS (SELECT *, CASE WHEN high_count >= 1 OR risk_score >= 50 THEN 'HIGH' WHEN medium_count >= 1 OR risk_score >= 20 THEN 'ELEVATED' ELSE 'LOW' END AS risk_level FROM rs)"""


@query("a2_risk", f"WITH {DEDUPED}, {SCANS}, {RISK} SELECT * FROM rl")
def _(spark, sf):
    return scores.risk(deduped(spark, sf), scans(spark, sf)).drop("stages", "summary")


_DIMS = ", ".join(f"(100 - least(100, coalesce(sum(pts) FILTER (WHERE dim = '{d}'), 0)))::BIGINT AS {d}" for d in X.DIMENSIONS)
TRANSPARENCY = f"""t AS (SELECT s.scan_id, greatest(0, least(100, 100 - round_even(coalesce(sum(pts), 0) * 0.5::DOUBLE, 0)))::BIGINT AS transparency, {_DIMS}
 FROM s LEFT JOIN (SELECT scan_id, round_even(({WEIGHT}) * confidence, 0) AS pts, {DIM} AS dim FROM d) x USING (scan_id) GROUP BY s.scan_id)"""


@query("a3_transparency", f"WITH {DEDUPED}, {SCANS}, {TRANSPARENCY} SELECT * FROM t")
def _(spark, sf):
    return scores.transparency(deduped(spark, sf), scans(spark, sf))


_CF = f"f AS ({findings_sql(client=True)})"


@query("a2_risk_client_profile", f"""WITH {_CF}, {SCANS}, d AS (SELECT * FROM f), r AS (SELECT s.scan_id, {TIERS} FROM s LEFT JOIN d USING (scan_id) GROUP BY s.scan_id),
 rs AS (SELECT *, least(100, 30 * high_count + 15 * medium_count + 5 * low_count)::BIGINT AS risk_score FROM r)
 SELECT scan_id, high_count, medium_count, low_count, risk_score, CASE WHEN high_count >= 1 OR risk_score >= 60 THEN 'HIGH'
  WHEN medium_count >= 1 OR risk_score >= 25 THEN 'ELEVATED' ELSE 'LOW' END AS risk_level FROM rs""")
def _(spark, sf):
    f = findings(spark, sf, profile="client")
    return scores.risk(f, scans(spark, sf), "client").select("scan_id", "high_count", "medium_count", "low_count", "risk_score", "risk_level")


_CW = "CASE pattern " + " ".join(f"WHEN '{p[0]}' THEN {p[4]}" for p in X.PATTERNS if p[4]) + " ELSE 15 END"


@query("a3_transparency_client_profile", f"""WITH {_CF}, {SCANS} SELECT s.scan_id,
  greatest(0, least(100, 100 - floor(coalesce(sum(floor(({_CW}) * confidence + 0.5)), 0) * 0.75::DOUBLE + 0.5)))::BIGINT AS transparency,
  greatest(0, 100 - 30 * count(*) FILTER (WHERE pattern IN ('DRIP_PRICING', 'SAAS_BILLING')))::BIGINT AS price_transparency,
  greatest(0, 100 - 25 * count(*) FILTER (WHERE pattern IN ('INTERFACE_INTERFERENCE', 'FORCED_ACTION')))::BIGINT AS choice_neutrality,
  greatest(0, 100 - 30 * count(*) FILTER (WHERE pattern IN ('BASKET_SNEAKING', 'SUBSCRIPTION_TRAP')))::BIGINT AS consent_clarity,
  greatest(0, 100 - 25 * count(*) FILTER (WHERE pattern IN ('FALSE_URGENCY', 'NAGGING')))::BIGINT AS urgency_signals,
  greatest(0, 100 - 25 * count(*) FILTER (WHERE pattern IN ('CONFIRM_SHAMING', 'TRICK_WORDING')))::BIGINT AS flow_transparency
  FROM s LEFT JOIN f USING (scan_id) GROUP BY s.scan_id""")
def _(spark, sf):
    return scores.client_transparency(findings(spark, sf, profile="client"), scans(spark, sf))


_HAS = {"product": "has_p", "cart": "has_c", "checkout": "has_o"}
_PAT = " UNION ALL ".join(
    f"SELECT '{p[0]}' AS pattern, {'product' in p[3]} AS np, {'cart' in p[3]} AS nc, {'checkout' in p[3]} AS no_" for p in X.PATTERNS)
COVERAGE = f"""pat AS ({_PAT}), c AS (SELECT s.scan_id, pat.pattern, CASE WHEN x.pattern IS NOT NULL THEN 'DETECTED'
  WHEN (NOT np OR has_p) AND (NOT nc OR has_c) AND (NOT no_ OR has_o) THEN 'EVALUATED_CLEAN' ELSE 'NOT_EVALUATED' END AS status
  FROM s CROSS JOIN pat LEFT JOIN (SELECT DISTINCT scan_id, pattern FROM f) x ON x.scan_id = s.scan_id AND x.pattern = pat.pattern)"""


@query("a4_coverage", f"WITH {FINDINGS}, {SCANS}, {COVERAGE} SELECT scan_id, pattern, status FROM c")
def _(spark, sf):
    return scores.coverage(findings(spark, sf), scans(spark, sf)).select("scan_id", "pattern", "status")


@query("a4_coverage_score", f"""WITH {FINDINGS}, {SCANS}, {COVERAGE} SELECT scan_id,
  round_even(count(*) FILTER (WHERE status <> 'NOT_EVALUATED') / 13 * 100, 0)::BIGINT AS coverage_score FROM c GROUP BY scan_id""")
def _(spark, sf):
    seen = findings(spark, sf).groupBy("scan_id").agg(F.collect_set("pattern").alias("seen"))
    s = scans(spark, sf).join(seen, "scan_id", "left")
    none = F.array().cast("array<string>")
    return s.select("scan_id", scores.coverage_score(F.coalesce("seen", none), F.col("stages")).alias("coverage_score"))


@query("a5_dedup", f"""WITH {FINDINGS} SELECT scan_id, pattern, title, page_id, snippets FROM (SELECT *, row_number() OVER
  (PARTITION BY scan_id, pattern, title ORDER BY CASE stage WHEN 'product' THEN 0 WHEN 'cart' THEN 1 ELSE 2 END, page_id) AS rn FROM f) x WHERE rn = 1""")
def _(spark, sf):
    return deduped(spark, sf).select("scan_id", "pattern", "title", "page_id", F.array_join("snippets", "|").alias("snippets"))


@query("a6_by_pattern", f"""WITH {FINDINGS} SELECT scan_id, string_agg(pattern || '=' || n, ',' ORDER BY pattern) AS by_pattern
  FROM (SELECT scan_id, pattern, count(*) AS n FROM f GROUP BY scan_id, pattern) x GROUP BY scan_id""")
def _(spark, sf):
    m = scores.findings_by_pattern(findings(spark, sf))
    pairs = F.transform(F.map_entries("by_pattern"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("scan_id", F.array_join(F.array_sort(pairs), ",").alias("by_pattern"))


@query("a14_local_summary", f"""WITH {FINDINGS} SELECT p.page_id, count(rule_id)::BIGINT AS signal_count,
  count(*) FILTER (WHERE severity = 'high')::BIGINT AS high_severity_count, count(rule_id) > 0 AS suspicious
  FROM v_text p LEFT JOIN f ON f.page_id = p.page_id GROUP BY p.page_id""")
def _(spark, sf):
    return scores.local_summary(findings(spark, sf, keep_clean=True))


@query("a16_rollup", f"""WITH {FINDINGS}, h AS (SELECT *, regexp_extract(url, '://([^/]+)', 1) AS host FROM f)
  SELECT stage, host, pattern, count(*)::BIGINT AS n_findings, grouping_id(stage, host, pattern)::BIGINT AS level FROM h GROUP BY ROLLUP (stage, host, pattern)""")
def _(spark, sf):
    f = findings(spark, sf).withColumn("host", T.host_of(F.col("url")))
    return scores.findings_rollup(f, "stage", "host", "pattern")


@query("f8_explanation", None)
def _(spark, sf):
    f = findings(spark, sf)
    return f.select("page_id", "rule_id", rules.explanation(F.col("pattern"), F.col("sub_signals"), F.col("snippets")).alias("text"))


@query("k9_stage_sets", f"""WITH {SCANS} SELECT scan_id, concat_ws(',', CASE WHEN NOT has_o THEN 'checkout' END, CASE WHEN NOT has_c THEN 'cart' END,
  CASE WHEN NOT has_p THEN 'product' END) AS missing, (has_c AND has_o) AS late_both FROM s""")
def _(spark, sf):
    need = F.array(*[F.lit(s) for s in ("checkout", "cart", "product")])
    late = F.array(F.lit("cart"), F.lit("checkout"))
    s = scans(spark, sf)
    return s.select("scan_id", F.array_join(F.array_except(need, F.col("stages")), ",").alias("missing"),
                    (F.size(F.array_intersect("stages", late)) == 2).alias("late_both"))


@query("k10_distinct_snippets", f"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(visible_text), {rx(X.RX_DEADLINE)}))), '|') AS snippets
  FROM v_text WHERE regexp_matches(visible_text, {rx(X.RX_DEADLINE)})""")
def _(spark, sf):
    hits = F.array_sort(F.array_distinct(T.matches(F.lower("visible_text"), X.RX_DEADLINE)))
    return pages(spark, sf).select("page_id", hits.alias("h")).where(F.size("h") > 0).select("page_id", F.array_join("h", "|").alias("snippets"))


@query("s6_scan_report", f"""WITH {DEDUPED}, {SCANS}, {RISK} SELECT rl.scan_id, risk_level, risk_score, coalesce(x.titles, '') AS titles
  FROM rl LEFT JOIN (SELECT scan_id, string_agg(pattern || ':' || title, '; ' ORDER BY pattern, title) AS titles FROM d GROUP BY scan_id) x ON x.scan_id = rl.scan_id""")
def _(spark, sf):
    d = deduped(spark, sf)
    rep = sinks.scan_report(scores.risk(d, scans(spark, sf)), d)
    titles = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["pattern"], f["title"])), "; ")
    return rep.select("scan_id", "risk_level", "risk_score", F.coalesce(titles, F.lit("")).alias("titles"))


@query("s7_audit_log", f"""WITH {DEDUPED}, {SCANS}, {RISK} SELECT scan_id, 1::BIGINT AS step, 'PAGES' AS stage,
   (has_p::INT + has_c::INT + has_o::INT) || ' stages' AS message FROM s
  UNION ALL SELECT scan_id, 2, 'COMPLETED', 'Risk: ' || risk_level || ' (' || signals_found || ')' FROM rl""")
def _(spark, sf):
    s = scans(spark, sf)
    r = scores.risk(deduped(spark, sf), s)
    return sinks.audit_log(
        sinks.log_step(s, 1, "PAGES", F.concat_ws("", F.size("stages"), F.lit(" stages"))),
        sinks.log_step(r, 2, "COMPLETED", F.concat_ws("", F.lit("Risk: "), "risk_level", F.lit(" ("), "signals_found", F.lit(")"))),
    )


_LAB = "lab AS (SELECT page_id, 'DRIP_PRICING' AS pattern, page_id % 3 = 0 AS expected, stage FROM v_text UNION ALL SELECT page_id, 'FALSE_URGENCY', page_id % 2 = 0, stage FROM v_text)"


@query("a12_evaluation_matrix", f"""WITH {FINDINGS}, {_LAB}, o AS (SELECT lab.*, x.page_id IS NOT NULL AS found FROM lab LEFT JOIN (SELECT DISTINCT page_id, pattern FROM f) x
   ON x.page_id = lab.page_id AND x.pattern = lab.pattern)
  SELECT pattern, stage, count(*) FILTER (WHERE expected AND found)::BIGINT AS tp, count(*) FILTER (WHERE NOT expected AND found)::BIGINT AS fp,
   count(*) FILTER (WHERE expected AND NOT found)::BIGINT AS fn, count(*) FILTER (WHERE NOT expected AND NOT found)::BIGINT AS tn,
   floor(count(*) FILTER (WHERE expected = found) / count(*) * 1000 + 0.5) / 10 AS pass_rate FROM o GROUP BY pattern, stage""")
def _(spark, sf):
    p = pages(spark, sf)
    lab = p.select("page_id", F.lit("DRIP_PRICING").alias("pattern"), (F.col("page_id") % 3 == 0).alias("expected"), "stage").unionByName(
        p.select("page_id", F.lit("FALSE_URGENCY").alias("pattern"), (F.col("page_id") % 2 == 0).alias("expected"), "stage"))
    return evaluate.matrix(evaluate.outcomes(lab, findings(spark, sf)), "pattern", "stage")


@query("q_shop_ranking", f"""WITH {FINDINGS}, h AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id FROM v_text),
 fh AS (SELECT *, regexp_extract(url, '://([^/]+)', 1) AS host FROM f),
 g AS (SELECT host, {TIERS}, sum(round_even(({WEIGHT}) * confidence, 0))::BIGINT AS points FROM fh GROUP BY host)
 SELECT h.host, count(*)::BIGINT AS n_pages, coalesce(any_value(signals_found), 0)::BIGINT AS signals_found, coalesce(any_value(high_count), 0)::BIGINT AS high_count,
  coalesce(any_value(medium_count), 0)::BIGINT AS medium_count, coalesce(any_value(low_count), 0)::BIGINT AS low_count, coalesce(any_value(points), 0)::BIGINT AS points
  FROM h LEFT JOIN g ON g.host = h.host GROUP BY h.host""")
def shop_ranking(spark, sf):
    """Signals and score points per shop in one pass over the page text."""
    f = findings(spark, sf, keep_clean=True).withColumn("host", T.host_of(F.col("url")))
    return f.groupBy("host").agg(
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("n_pages"), *scores.tier_counts(),
        F.coalesce(F.sum(scores.points(F.col("pattern"), F.col("confidence"))), F.lit(0)).alias("points"),
    )


@query("q_scan_scores", f"""WITH {DEDUPED}, {SCANS}, {RISK}, {TRANSPARENCY}, {COVERAGE}, cv AS (SELECT scan_id, round_even(count(*) FILTER (WHERE status <> 'NOT_EVALUATED') / 13 * 100, 0)::BIGINT AS coverage_score FROM c GROUP BY scan_id)
  SELECT scan_id, signals_found, risk_score, risk_level, transparency, coverage_score FROM rl JOIN t USING (scan_id) JOIN cv USING (scan_id)""")
def _(spark, sf):
    """All scores of a scan in one pass."""
    s = scores.scan_scores(findings(spark, sf, keep_clean=True))
    return s.select("scan_id", "signals_found", "risk_score", "risk_level", "transparency", "coverage_score")


@query("n7_coverage_matrix", f"WITH {FINDINGS}, {SCANS}, {COVERAGE} SELECT pattern, status, count(*)::BIGINT AS n_scans FROM c GROUP BY pattern, status")
def _(spark, sf):
    return scores.coverage(findings(spark, sf), scans(spark, sf)).groupBy("pattern", "status").agg(F.count("*").alias("n_scans"))


@query("k4_snippet_counts", f"WITH {FINDINGS} SELECT rule_id, len(string_split(snippets, '|'))::BIGINT AS n_snippets, count(*)::BIGINT AS n FROM f GROUP BY 1, 2")
def _(spark, sf):
    """Findings by the number of snippets kept, which is three at most."""
    f = findings(spark, sf)
    return f.groupBy("rule_id", F.size("snippets").cast("bigint").alias("n_snippets")).agg(F.count("*").alias("n"))
