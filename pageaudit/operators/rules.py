"""Text rules: one projection over the page text evaluates every rule."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import matches
from pageaudit.operators.classify import page_state

RULE_BY_ID = {r[0]: r for r in X.RULES}


def confidence_tier(confidence: Column, n_sources: Column) -> Column:
    """Tier from the confidence and the number of independent evidence sources."""
    return (
        F.when((confidence >= 0.85) & (n_sources >= 2), "HIGH")
        .when((confidence >= 0.70) | (n_sources >= 2), "MEDIUM")
        .otherwise("LOW")
    )


def client_tier(confidence: Column) -> Column:
    """Tier of the client profile, which ignores the number of sources."""
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.65, "MEDIUM").otherwise("LOW")


def rule_values(rule_id: str, profile: str = "default"):
    """The catalogue entry of a rule as literal columns."""
    _, pattern, subs, methods, conf, sev, title, _, _ = RULE_BY_ID[rule_id]
    if profile == "client":
        conf, sev = X.CLIENT_CONFIDENCE.get(rule_id, (conf, sev))
    confidence = F.lit(conf)
    tier = client_tier(confidence) if profile == "client" else confidence_tier(confidence, F.lit(len(methods)))
    return [
        F.lit(rule_id).alias("rule_id"),
        F.lit(pattern).alias("pattern"),
        F.array(*[F.lit(s) for s in subs]).alias("sub_signals"),
        F.array(*[F.lit(m) for m in methods]).alias("methods"),
        confidence.alias("confidence"),
        tier.alias("confidence_tier"),
        F.lit(sev).alias("severity"),
        F.lit(title).alias("title"),
    ]


def rule_finding(rule_id: str, snippets: Column, profile: str = "default") -> Column:
    """Finding struct of a rule with constant catalogue values and these snippets."""
    return F.struct(*rule_values(rule_id, profile), snippets.alias("snippets"))


def text_findings(text: Column, state: Column, extra: bool = False, profile: str = "default") -> Column:
    """Array of findings that the text rules raise on one page; all whole matches."""
    rules = dict(X.TEXT_RULE_RX)
    if extra:
        rules.update(X.EXTRA_TEXT_RULE_RX)
    found = []
    for rule_id, rx in rules.items():
        hits = matches(text, rx)
        if rule_id == "DP_HIDDEN_FEE_CHECKOUT":
            hits = F.when(state.isin("cart", "checkout"), hits).otherwise(F.array().cast("array<string>"))
        if rule_id in ("FU_SCARCITY_CLAIM", "DP_HIDDEN_FEE_CHECKOUT"):
            hits = F.array_sort(F.array_distinct(hits))
        found.append(rule_finding(rule_id, hits, profile))
    return F.filter(F.array(*found), lambda f: F.size(f["snippets"]) > 0)


def detect_text(pages: DataFrame, extra: bool = False, profile: str = "default", keep_clean: bool = False) -> DataFrame:
    """Findings of the text rules, one row each.

    ``keep_clean`` keeps one row with NULL finding columns for a page without
    findings, so that scans can be scored in the same pass; ``nth`` numbers the
    findings of a page from 0 (NULL for a clean page).
    """
    staged = pages.withColumn("page_state", page_state(F.col("url"), F.col("visible_text")))
    found = text_findings(F.col("visible_text"), F.col("page_state"), extra, profile)
    keep = [c for c in ("page_id", "scan_id", "stage", "url") if c in pages.columns]
    if keep_clean:
        return staged.select(*keep, "page_state", F.posexplode_outer(found).alias("nth", "f")).select(*keep, "page_state", "nth", "f.*")
    return staged.select(*keep, "page_state", F.explode(found).alias("f")).select(*keep, "page_state", "f.*")


SIGNAL_TEXT = [
    (["COUNTDOWN_TIMER"], "Countdown shown: '", "'. Whether the deadline is real cannot be checked from the page."),
    (["SCARCITY_CLAIM"], "Low stock claimed: '", "'. The stock figure cannot be confirmed."),
    (["DEADLINE_LANGUAGE"], "Deadline wording used: '", "'. It pushes for a fast decision."),
    (["SOCIAL_PROOF_PRESSURE"], "Crowd activity claimed: '", "'. Such numbers are rarely verifiable."),
    (["PRE_TICKED_CHECKBOX"], "Add-on selected in advance: '", "'. Add-ons need an active choice."),
    (["SHAME_LANGUAGE"], "Declining is worded to cause guilt or fear: '", "'."),
    (["MANDATORY_FEE", "HIDDEN_FEE"], "Fee not disclosed early: ", ". Mandatory charges belong in the first price."),
    (["VISUAL_ASYMMETRY", "OBSCURED_DECLINE_OPTION"], "The alternative is visually obscured: '", "'."),
    (["HIDDEN_RECURRING_BILLING", "CANCELLATION_BARRIER"], "Recurring billing or a barrier to cancelling: '", "'."),
    (["MANDATORY_APP_DOWNLOAD", "UNRELATED_PERMISSION"], "An unrelated action is required: '", "'."),
    (["DOUBLE_NEGATIVE"], "Double negative in a choice: '", "'. Consent may be given by mistake."),
]


def explanation(pattern: Column, sub_signals: Column, snippets: Column) -> Column:
    """One sentence per kind of evidence, quoting the first snippet (fees: the first two)."""
    first = F.coalesce(F.get(snippets, F.lit(0)), F.lit("no text"))
    parts = []
    for signals, head, tail in SIGNAL_TEXT:
        quoted = F.array_join(F.slice(snippets, 1, 2), "; ") if "HIDDEN_FEE" in signals else first
        hit = F.arrays_overlap(sub_signals, F.array(*[F.lit(s) for s in signals]))
        parts.append(F.when(hit, F.concat(F.lit(head), quoted, F.lit(tail))))
    text = F.concat_ws(" ", *parts)
    fallback = F.concat(
        F.lit("Evidence of potential "), F.lower(F.replace(pattern, F.lit("_"), F.lit(" "))), F.lit(" on this page.")
    )
    return F.when(text == "", fallback).otherwise(text)
