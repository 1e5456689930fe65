"""Element rules as expressions over a parsed page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import found, icase, plain_spaces, user_facing
from pageaudit.operators import structure as H
from pageaudit.operators.classify import page_state
from pageaudit.operators.rules import rule_finding, text_findings

SHAME_TAGS = ["button", "a", "label", "span", "div", "p"]
CHOICE_TAGS = ["a", "button", "span", "div"]


def _not_schedule(t: Column) -> Column:
    return ~(found(t, X.RX_TIME_OF_DAY) & ~found(t, X.RX_TIMER_CONTEXT))


def timer_snippets() -> Column:
    """Timer texts: elements marked as timers first; only without any, text nodes that read like one."""
    marked = lambda e: H.visible(e) & (
        H.class_has(e, "countdown") | H.class_has(e, "timer")
        | F.coalesce(e["id"].contains("countdown") | e["id"].contains("timer"), F.lit(False))
        | F.map_contains_key(e["attrs"], "data-countdown")
    )
    first = F.filter(
        F.transform(F.filter(H.ELEMENTS, marked), lambda e: H.element_text(e)),
        lambda t: found(t, X.RX_CLOCK) & user_facing(t) & _not_schedule(t),
    )
    second = F.filter(
        F.transform(F.filter(H.NODES, lambda n: ~n["hidden"] & ~n["tag"].isin("code", "pre")), lambda n: n["text"]),
        lambda t: found(t, X.RX_COUNTDOWN) & user_facing(t) & _not_schedule(t),
    )
    return F.when(F.size(first) > 0, first).otherwise(second)


def preticked_labels() -> Column:
    """Labels of checkboxes for paid extras that are ticked in advance."""
    ticked = F.filter(H.ELEMENTS, lambda e: H.is_checkbox(e) & H.is_checked(e) & H.visible(e))
    return F.filter(
        F.transform(ticked, lambda e: H.label_text(e)),
        lambda t: (t != "") & ~found(t, X.RX_BENIGN_OPT_IN) & found(t, X.RX_ADDON),
    )


def shame_text() -> Column:
    """First element whose text declines with guilt or fear; the page text is tested before any element."""
    tight = H.page_text("")
    texts = F.transform(F.filter(H.ELEMENTS, lambda e: H.visible(e) & e["tag"].isin(SHAME_TAGS)), lambda e: H.element_text(e, ""))
    rx = r"\b" + X.RX_SHAME_CORE + r"\b"
    hit = F.get(F.filter(texts, lambda t: found(t, rx)), F.lit(0))
    return F.when(tight.rlike(icase(X.RX_SHAME_CORE)), hit)


def obscured_choice() -> Column:
    """First choice styled tiny or nearly transparent that declines or is short."""
    styled = F.filter(
        H.ELEMENTS,
        lambda e: H.visible(e) & e["tag"].isin(CHOICE_TAGS)
        & F.coalesce(found(H.attr(e, "style"), X.RX_TINY_FONT) | found(H.attr(e, "style"), X.RX_LOW_OPACITY), F.lit(False)),
    )
    described = F.transform(styled, lambda e: F.struct(H.element_text(e, "").alias("t"), H.attr(e, "style").alias("s")))
    hit = F.get(F.filter(described, lambda d: found(d["t"], X.RX_DECLINE) | F.length(d["t"]).between(1, 39)), F.lit(0))
    return F.when(hit.isNotNull(), F.concat(hit["t"], F.lit(" (style: "), hit["s"], F.lit(")")))


def element_findings(profile: str = "default") -> Column:
    """Array of findings that the element rules raise on one parsed page."""
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    pages = F.array(
        rule_finding("FU_COUNTDOWN_TIMER", timer_snippets(), profile),
        rule_finding("CS_SHAME_DECLINE", one(shame_text()), profile),
        rule_finding("II_VISUAL_ASYMMETRY", one(obscured_choice()), profile),
    )
    boxes = F.transform(preticked_labels(), lambda t: rule_finding("BS_PRE_TICKED_CHECKBOX", F.array(t), profile))
    return F.concat(F.filter(pages, lambda f: F.size(f["snippets"]) > 0), boxes)


def detect_elements(parsed: DataFrame, profile: str = "default") -> DataFrame:
    """Findings of the element rules, one row each; a page may have several ticked boxes."""
    keep = [c for c in ("page_id", "scan_id", "stage", "url") if c in parsed.columns]
    return parsed.select(*keep, F.explode(element_findings(profile)).alias("f")).select(*keep, "f.*")


def page_findings(text: Column, state: Column, profile: str = "default") -> Column:
    """Array of all findings of one parsed page: element rules first, then text rules."""
    return F.concat(element_findings(profile), text_findings(text, state, profile=profile))


def with_page_text(parsed: DataFrame) -> DataFrame:
    """Adds the text the rules read and the page state that follows from it."""
    text = plain_spaces(H.snapshot_text())
    return parsed.withColumn("text", text).withColumn("page_state", page_state(F.col("url"), F.col("text")))


def detect_all(parsed: DataFrame, profile: str = "default", keep_clean: bool = False) -> DataFrame:
    """Findings of text and element rules together, in one pass over the parsed pages."""
    explode = F.explode_outer if keep_clean else F.explode
    keep = [c for c in ("page_id", "scan_id", "stage", "url") if c in parsed.columns]
    found = page_findings(F.col("text"), F.col("page_state"), profile)
    return with_page_text(parsed).select(*keep, "page_state", explode(found).alias("f")).select(*keep, "page_state", "f.*")


def may_raise() -> Column:
    """Necessary condition for any finding of ``detect_all`` on a parsed page with its text (``with_page_text``).

    Each rule needs one of these: a phrase of the text rules, a clock, a ticked checkbox, a styled
    element, or a shaming phrase. They are tested on the parsed text, so no markup can hide one.
    """
    ticked = F.exists(H.ELEMENTS, H.having(lambda e: H.is_checkbox(e) & H.is_checked(e)))
    styled = F.exists(H.ELEMENTS, H.having(lambda e: found(H.attr(e, "style"), X.RX_TINY_FONT) | found(H.attr(e, "style"), X.RX_LOW_OPACITY)))
    phrase = found(F.col("text"), "|".join(X.TEXT_RULE_RX.values()))
    return phrase | found(H.page_text(), r"\d:\d") | ticked | styled | H.page_text("").rlike(icase(X.RX_SHAME_CORE))
