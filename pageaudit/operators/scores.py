"""Risk, transparency, coverage and summaries over findings.

Every aggregate here is a plain grouped aggregate with map-side partial sums,
so one scan that holds a large share of all findings does not pile up in a
single task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X


def _lookup(pattern: Column, values: dict, default) -> Column:
    """Constant lookup by pattern as one CASE expression; no join needed for 13 entries."""
    return reduce(lambda acc, kv: F.when(pattern == kv[0], F.lit(kv[1])).otherwise(acc), values.items(), F.lit(default))


def pattern_weight(pattern: Column) -> Column:
    return _lookup(pattern, {p[0]: p[4] for p in X.PATTERNS if p[4] is not None}, X.DEFAULT_WEIGHT)


def pattern_dimension(pattern: Column) -> Column:
    return _lookup(pattern, {p[0]: p[5] for p in X.PATTERNS if p[5]}, X.DEFAULT_DIMENSION)


def points(pattern: Column, confidence: Column) -> Column:
    """Deduction of one finding, rounded half to even."""
    return F.bround(pattern_weight(pattern) * confidence, 0).cast("bigint")


def dedup_findings(findings: DataFrame, key="scan_id", order=("stage_ord", "page_id")) -> DataFrame:
    """First finding per scan, pattern and title."""
    rest = [c for c in findings.columns if c not in (key, "pattern", "title")]
    lead = F.struct(*[F.col(c) for c in order])
    first = F.min_by(F.struct(*rest), lead).alias("first")
    return findings.groupBy(key, "pattern", "title").agg(first).select(key, "pattern", "title", "first.*")


def _risk_level(high: Column, med: Column, score: Column, high_at: int, elevated_at: int) -> Column:
    return (
        F.when((high >= 1) | (score >= high_at), "HIGH").when((med >= 1) | (score >= elevated_at), "ELEVATED").otherwise("LOW")
    )


def tier_counts():
    """The three overlapping counters; a finding may count in two of them."""
    c, t = F.col("confidence"), F.col("confidence_tier")
    return [
        F.count_if(F.col("pattern").isNotNull()).alias("signals_found"),
        F.count_if((t == "HIGH") | (c >= 0.85)).alias("high_count"),
        F.count_if((t == "MEDIUM") | ((c >= 0.65) & (c < 0.85))).alias("medium_count"),
        F.count_if((t == "LOW") | (c < 0.65)).alias("low_count"),
    ]


def with_risk(df: DataFrame, profile: str = "default") -> DataFrame:
    """Score and level from the counters and the ``stages`` array of a scan."""
    high_at, elevated_at = (60, 25) if profile == "client" else (50, 20)
    score = F.least(F.lit(100), F.col("high_count") * 30 + F.col("medium_count") * 15 + F.col("low_count") * 5)
    stages = F.when(F.size("stages") == 0, F.array(F.lit("product"))).otherwise(F.col("stages"))
    n = F.size(stages)
    out = (
        df.withColumn("risk_score", score.cast("bigint"))
        .withColumn("risk_level", _risk_level(F.col("high_count"), F.col("medium_count"), F.col("risk_score"), high_at, elevated_at))
        .withColumn("coverage_sufficient", F.arrays_overlap(stages, F.array(F.lit("cart"), F.lit("checkout"))))
    )
    summary = (
        F.when(F.col("risk_level") == "HIGH",
               F.concat_ws("", "signals_found", F.lit(" signals, "), "high_count", F.lit(" with high confidence")))
        .when(F.col("risk_level") == "ELEVATED", F.concat_ws("", "signals_found", F.lit(" signals to verify")))
        .when(~F.col("coverage_sufficient"),
              F.concat_ws("", F.lit("no signal on "), n, F.lit(" stage(s); cart and checkout not reached")))
        .otherwise(F.concat_ws("", F.lit("no signal on "), n, F.lit(" stages")))
    )
    return out.withColumn("summary", summary)


def risk(findings: DataFrame, scans: DataFrame, profile: str = "default") -> DataFrame:
    """One row per scan; scans without findings are kept. ``scans`` has scan_id and stages."""
    counts = findings.groupBy("scan_id").agg(*tier_counts())
    filled = scans.join(counts, "scan_id", "left").fillna(
        0, ["signals_found", "high_count", "medium_count", "low_count"]
    )
    return with_risk(filled, profile)


def dimension_sums():
    p, c = F.col("pattern"), F.col("confidence")
    pts, dim = points(p, c), pattern_dimension(p)
    out = [F.coalesce(F.sum(pts), F.lit(0)).alias("points")]
    for d in X.DIMENSIONS:
        out.append(F.coalesce(F.sum(F.when(dim == d, pts)), F.lit(0)).alias(f"points_{d}"))
    return out


def with_transparency(df: DataFrame) -> DataFrame:
    total = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.bround(F.col("points") * 0.5, 0)))
    out = df.withColumn("transparency", total.cast("bigint"))
    for d in X.DIMENSIONS:
        out = out.withColumn(d, (100 - F.least(F.lit(100), F.col(f"points_{d}"))).cast("bigint"))
    return out.drop("points", *[f"points_{d}" for d in X.DIMENSIONS])


def transparency(findings: DataFrame, scans: DataFrame) -> DataFrame:
    sums = findings.groupBy("scan_id").agg(*dimension_sums())
    names = ["points"] + [f"points_{d}" for d in X.DIMENSIONS]
    return with_transparency(scans.select("scan_id").join(sums, "scan_id", "left").fillna(0, names))


def client_transparency(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Client profile: weight 15 by default, factor 0.75, fixed points per finding in a dimension."""
    weights = {p[0]: p[4] for p in X.PATTERNS if p[4] is not None}
    pts = F.floor(_lookup(F.col("pattern"), weights, 15) * F.col("confidence") + 0.5)
    per = [
        ("price_transparency", ["DRIP_PRICING", "SAAS_BILLING"], 30),
        ("choice_neutrality", ["INTERFACE_INTERFERENCE", "FORCED_ACTION"], 25),
        ("consent_clarity", ["BASKET_SNEAKING", "SUBSCRIPTION_TRAP"], 30),
        ("urgency_signals", ["FALSE_URGENCY", "NAGGING"], 25),
        ("flow_transparency", ["CONFIRM_SHAMING", "TRICK_WORDING"], 25),
    ]
    sums = findings.groupBy("scan_id").agg(
        F.sum(pts).alias("points"), *[F.count_if(F.col("pattern").isin(ps)).alias(d) for d, ps, _ in per]
    )
    df = scans.select("scan_id").join(sums, "scan_id", "left").fillna(0)
    total = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.floor(F.col("points") * 0.75 + 0.5)))
    return df.select(
        "scan_id", total.cast("bigint").alias("transparency"),
        *[F.greatest(F.lit(0), 100 - F.col(d) * k).cast("bigint").alias(d) for d, _, k in per],
    )


def pattern_entries() -> Column:
    """The 13 taxonomy entries as an array, exploded per scan instead of a join."""
    return F.array(*[
        F.struct(
            F.lit(p[0]).alias("pattern"), F.lit(p[1]).alias("pattern_title"), F.lit(p[2]).alias("section"),
            F.array(*[F.lit(s) for s in p[3]]).alias("required"),
        ) for p in X.PATTERNS
    ])


def coverage(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per scan and pattern with its evaluation status."""
    seen = findings.groupBy("scan_id").agg(F.collect_set("pattern").alias("seen"))
    df = scans.select("scan_id", "stages").join(seen, "scan_id", "left").select(
        "scan_id", "stages", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"),
        F.explode(pattern_entries()).alias("p"),
    )
    missing = F.array_except("p.required", "stages")
    status = (
        F.when(F.array_contains("seen", F.col("p.pattern")), "DETECTED")
        .when(F.size(missing) == 0, "EVALUATED_CLEAN")
        .otherwise("NOT_EVALUATED")
    )
    return df.select(
        "scan_id", "p.pattern", "p.pattern_title", "p.section", status.alias("status"),
        F.when(status == "NOT_EVALUATED", F.array_join(missing, ", ")).alias("missing_stages"),
    )


def coverage_score(seen: Column, stages: Column) -> Column:
    """Share of the taxonomy that was evaluated, in whole percent, without exploding."""
    done = reduce(
        lambda a, b: a + b,
        [
            F.when(
                F.array_contains(seen, p[0]) | (F.size(F.array_except(F.array(*[F.lit(s) for s in p[3]]), stages)) == 0), 1
            ).otherwise(0)
            for p in X.PATTERNS
        ],
    )
    return F.bround(done / F.lit(len(X.PATTERNS)) * 100, 0).cast("bigint")


def scan_scores(found: DataFrame, profile: str = "default") -> DataFrame:
    """Risk, transparency and coverage per scan in one pass over the pages.

    ``found``: findings with a row of NULLs for every clean page (scan_id,
    stage, pattern, title, confidence, confidence_tier). The first grouping
    also drops repeated findings; it leaves at most one row per rule and scan,
    and the second one works on those.
    """
    once = found.groupBy("scan_id", "pattern", "title").agg(
        F.collect_set("stage").alias("at"), F.max("confidence").alias("confidence"), F.min("confidence_tier").alias("confidence_tier")
    )
    g = once.groupBy("scan_id").agg(
        *tier_counts(), *dimension_sums(), F.collect_set("pattern").alias("seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("stages"),
    )
    scored = with_transparency(with_risk(g, profile))
    return scored.withColumn("coverage_score", coverage_score(F.col("seen"), F.col("stages"))).drop("seen")


def findings_by_pattern(findings: DataFrame) -> DataFrame:
    """Map pattern -> count per scan; the map has at most 13 entries."""
    n = findings.groupBy("scan_id", "pattern").agg(F.count("*").alias("n"))
    return n.groupBy("scan_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "n")))).alias("by_pattern")
    )


def access_gate(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """A scan without access or without a captured product has no verdict.

    ``gate`` has scan_id, access and product_reached; ``scores`` the scan's
    risk, transparency, verdict and coverage columns.
    """
    g = scores.join(gate, "scan_id", "left")
    product = F.coalesce("product_reached", F.lit(False))
    shut = (F.coalesce("access", F.lit("ACCESS_OK")) != "ACCESS_OK") | ~product
    out = (
        g.withColumn("risk_level", F.when(shut, "UNDETERMINED").otherwise(F.col("risk_level")))
        .withColumn("verdict", F.when(shut, "INCONCLUSIVE").otherwise(F.col("verdict")))
        .withColumn("coverage_score", F.when(~product, F.lit(0)).otherwise(F.col("coverage_score")).cast("bigint"))
    )
    zeroed = ["signals_found", "high_count", "medium_count", "low_count", "risk_score", "transparency", *X.DIMENSIONS]
    for c in zeroed:
        if c in out.columns:
            out = out.withColumn(c, F.when(shut, F.lit(0)).otherwise(F.col(c)).cast("bigint"))
    return out


def listing_transparency(evaluated: Column, seen: Column, coverage_pct: Column):
    """Seven listing dimensions; NOT_EVALUATED unless the product was captured."""
    cols = []
    for name, patterns in X.LISTING_DIMENSIONS:
        hit = F.arrays_overlap(seen, F.array(*[F.lit(p) for p in patterns]))
        cols.append(F.when(~evaluated, "NOT_EVALUATED").when(hit, "SIGNAL").otherwise("CLEAR").alias(name))
    return cols + [F.when(evaluated, coverage_pct).otherwise(F.lit(0)).cast("bigint").alias("journey_coverage")]


def local_summary(findings_outer: DataFrame, key="page_id") -> DataFrame:
    """Signals, severe signals and the escalation flag per page; pages without findings are kept."""
    return findings_outer.groupBy(key).agg(
        F.count("rule_id").alias("signal_count"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
        (F.count("rule_id") > 0).alias("suspicious"),
    )


def scan_list(scans: DataFrame) -> DataFrame:
    """Display row per scan: title, else host, else address."""
    return scans.withColumn(
        "display_name",
        F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.try_parse_url("url", F.lit("HOST")), F.col("url")),
    )


def recent_scans(scans: DataFrame, k: int) -> DataFrame:
    """The k newest scans; k is the size of the list that is asked for."""
    return scans.orderBy(F.col("started_at").desc(), "scan_id").limit(k)


def findings_rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts for every prefix of the keys."""
    return findings.rollup(*keys).agg(F.count("*").alias("n_findings"), F.grouping_id().alias("level"))
