"""Price candidates, stage totals and fee components from parsed pages."""

import json
import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.functions.jsonrows import json_rows
from pageaudit.functions.marks import bit_of
from pageaudit.functions.windows import top_k
from pageaudit.operators import structure as H

#: Reachable sums of fees are kept as a set up to this number, as bits beyond it.
MANY_SUMS = 1 << 14


def candidate(amount: Column, source, confidence, label, is_mrp=False, belongs=True, currency="INR") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        amount.cast(T.MONEY).alias("amount"), lit(currency).alias("currency"), lit(source).alias("source"),
        lit(confidence).cast("double").alias("confidence"), lit(label).cast("string").alias("label"),
        lit(is_mrp).alias("is_mrp"), F.lit(False).alias("is_discount"), lit(belongs).alias("belongs_to_product"),
    )


def nested_type() -> str:
    """Type of an array of candidates."""
    return (
        "array<struct<amount:decimal(14,2),currency:string,source:string,confidence:double,label:string,"
        "is_mrp:boolean,is_discount:boolean,belongs_to_product:boolean>>"
    )


def _usable(found: Column) -> Column:
    return F.filter(found, lambda c: c.isNotNull() & (c["amount"] > 0))


def candidate_rows(parsed: DataFrame, found: Column) -> DataFrame:
    return parsed.select("page_id", F.posexplode(found).alias("seq", "c")).select("page_id", "seq", "c.*")


# --- JSON-LD -------------------------------------------------------------------

def variant_price(v: Column, path: str) -> Column:
    """Positive price at ``path`` of a variant; strings lose everything but digits and dots."""
    inner = F.try_variant_get(v, path, "variant")
    number = F.try_variant_get(v, path, "double")
    as_text = T.clean_price(F.try_variant_get(v, path, "string"))
    return F.when(F.schema_of_variant(inner) == "STRING", as_text).otherwise(F.when(number > 0, number))


def _list_at(v: Column, path: str) -> Column:
    """Array at ``path``; a single value counts as an array of one."""
    inner = F.try_variant_get(v, path, "variant")
    single = F.when(inner.isNotNull() & ~F.is_variant_null(inner), F.array(inner)).otherwise(F.array().cast("array<variant>"))
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), single)


def jsonld_objects() -> Column:
    """Array of the JSON-LD objects of a page in document order; graphs are unfolded."""
    none = F.array().cast("array<variant>")
    blobs = F.transform(F.filter("scripts", lambda s: s["type"] == "application/ld+json"), lambda s: F.try_parse_json(F.trim(s["body"])))
    items = F.flatten(F.transform(F.filter(blobs, lambda v: v.isNotNull()), lambda v: _list_at(v, "$")))
    return F.coalesce(
        F.flatten(F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v)))), none
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.lit(""))


def jsonld_array() -> Column:
    """Candidates of JSON-LD products and offers; the specifications of an offer come before its own price."""
    def direct(o, conf, label):
        currency = F.coalesce(F.try_variant_get(o, "$.priceCurrency", "string"), F.lit("INR"))
        amount = F.coalesce(variant_price(o, "$.price"), variant_price(o, "$.lowPrice"))
        return F.array(candidate(amount, "json_ld", conf, label, currency=currency))

    def by_spec(o):
        currency = F.coalesce(F.try_variant_get(o, "$.priceCurrency", "string"), F.lit("INR"))
        specs = F.coalesce(F.try_variant_get(o, "$.priceSpecification", "array<variant>"), F.array().cast("array<variant>"))

        def one(x):
            kind = F.coalesce(F.try_variant_get(x, "$.priceType", "string"), F.lit(""))
            is_mrp = kind.contains("ListPrice") | F.lower(kind).contains("mrp")
            return candidate(variant_price(x, "$.price"), "json_ld", F.when(is_mrp, 0.4).otherwise(0.96),
                             F.when(is_mrp, "JSON-LD list price").otherwise("JSON-LD sale price"), is_mrp, currency=currency)

        return F.transform(specs, one)

    def of_object(v):
        nested = F.flatten(F.transform(_list_at(v, "$.offers"), lambda o: F.concat(by_spec(o), direct(o, 0.95, "JSON-LD offer price"))))
        return (
            F.when(_kind(v).contains("Product"), nested)
            .when(_kind(v).contains("Offer"), direct(v, 0.92, "JSON-LD standalone offer price"))
            .otherwise(F.array().cast(nested_type()))
        )

    return _usable(F.flatten(F.transform(jsonld_objects(), of_object)))


def jsonld_title() -> Column:
    """Name or headline of the first JSON-LD product that has one."""
    products = F.filter(jsonld_objects(), lambda v: _kind(v).contains("Product"))
    names = F.transform(products, lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.headline", "string")))
    return F.trim(F.get(F.filter(names, lambda t: t.isNotNull() & (t != "")), F.lit(0)))


def jsonld_candidates(parsed: DataFrame) -> DataFrame:
    return candidate_rows(parsed, jsonld_array())


# --- embedded state and captured responses ---------------------------------------

def json_entries(blobs: DataFrame, blocked, max_depth=None, max_items=None) -> DataFrame:
    """Key/value entries of every JSON document in ``json``; other columns come along. Malformed ones give none."""
    keep = [f for f in blobs.schema.fields if f.name != "json"]
    names = [f.name for f in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    blocked = list(blocked)

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("json").to_pylist()):
                try:
                    entries = list(json_rows(json.loads(text), blocked, max_depth, max_items))
                except (ValueError, TypeError, RecursionError):
                    continue
                for n, (depth, path, key, kind, value) in enumerate(entries):
                    at.append(i)
                    out.append({"ord": n, "depth": depth, "path": path, "key": key, "kind": kind, "value": value})
            idx = pa.array(at, pa.int64())
            cols = [batch.column(c).take(idx) for c in names]
            fields = [("ord", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("key", pa.string()),
                      ("kind", pa.string()), ("value", pa.string())]
            cols += [pa.array([o[f] for o in out], t) for f, t in fields]
            yield pa.RecordBatch.from_arrays(cols, names=names + [f for f, _ in fields])

    extra = "ord int, depth int, path string, key string, kind string, value string"
    return blobs.mapInArrow(run, f"{schema}, {extra}")


def entry_price(kind: Column, value: Column) -> Column:
    """Positive price of an entry."""
    n = value.try_cast("double")
    return F.when(kind == "string", T.clean_price(value)).when(kind == "number", F.when(n > 0, n))


def _first_key(key: Column, table, value: int) -> Column:
    out = None
    for row in table:
        hit = key.contains(row[0])
        out = F.when(hit, F.lit(row[value])) if out is None else out.when(hit, F.lit(row[value]))
    return out


def hydration_array() -> Column:
    """Candidates of the framework state of a page: page data, product JSON, window state, in this order."""
    negative = [k for k, _ in X.HYDRATION_NEGATIVE]

    def one(e):
        key = F.lower(F.replace(e["key"], F.lit("_"), F.lit("")))
        bad = T.contains_any(key, negative)
        score = _first_key(key, X.HYDRATION_POSITIVE, 1)
        price = entry_price(e["kind"], e["value"])
        paise = (e["source"] == "shopify_embedded") & (price > 10000) & (price % 100 == 0)
        conf = F.when(bad, 0.3).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.5), score / 120.0)))
        label = F.when(bad, _first_key(key, X.HYDRATION_NEGATIVE, 1)).otherwise(_first_key(key, X.HYDRATION_POSITIVE, 2))
        made = candidate(F.when(~bad & paise, price / 100).otherwise(price), e["source"], conf, label, bad)
        return F.when(bad | score.isNotNull(), made)

    return _usable(F.transform("state", one))


def hydration_candidates(parsed: DataFrame) -> DataFrame:
    return candidate_rows(parsed, hydration_array())


def network_candidates(responses: DataFrame, limit=None, low=None, high=None, max_bytes=None) -> DataFrame:
    """Candidates from captured JSON responses: session_id, seq, url, content_type, body.

    Of an address that a session fetched again the first response counts. Bodies are taken
    apart where they are and only candidates are shuffled. All limits are open unless given: candidates per
    session, amounts between ``low`` and ``high`` (both exclusive), bytes of a body.
    """
    u = F.lower("url")
    ok = T.contains_any(u, X.NETWORK_URL_WORDS) & T.contains_any(F.lower("content_type"), X.NETWORK_CONTENT_TYPES)
    if max_bytes is not None:
        ok = ok & (F.octet_length("body") <= max_bytes)
    kept = responses.where(ok)
    entries = json_entries(kept.select("session_id", "url", "seq", F.col("body").alias("json")), X.NETWORK_NEGATIVE)
    key = F.lower(F.replace("key", F.lit("_"), F.lit("")))
    price = entry_price(F.col("kind"), F.col("value"))
    usable = T.contains_any(key, X.NETWORK_POSITIVE) & ~T.contains_any(key, X.NETWORK_NEGATIVE) & (price > (0 if low is None else low))
    if high is not None:
        usable = usable & (price < high)
    first = kept.groupBy("session_id", "url").agg(F.min("seq").alias("seq"))
    hits = (
        entries.where(usable)
        .select("session_id", "seq", "ord", "url", "key", candidate(price, "network_json", 0.95, F.concat(F.lit("Network JSON "), F.col("key"))).alias("c"))
        .join(first, ["session_id", "url", "seq"], "left_semi").dropDuplicates(["session_id", "url", "seq", "ord"])
    )
    if limit is not None:
        hits = top_k(hits, ["session_id"], ["seq", "ord"], limit)
    return hits.select("session_id", "seq", "ord", "url", "key", "c.*")


# --- meta tags and platform selectors ----------------------------------------------

def _meta(test) -> Column:
    return H.first_where(lambda e: (e["tag"] == "meta") & test(e))


def meta_array() -> Column:
    """First usable price meta tag, as an array of at most one."""
    tries = []
    for prop in [*X.META_PRICE_PROPS, "itemprop:price"]:
        el = F.coalesce(
            _meta(lambda e: H.attr(e, "property") == prop), _meta(lambda e: H.attr(e, "name") == prop),
            _meta(lambda e: H.attr(e, "itemprop") == "price"),
        )
        tries.append(T.parse_inr(H.attr(el, "content")))
    has_meta = F.exists(H.ELEMENTS, H.having(lambda e: (e["tag"] == "meta") & (
        H.attr(e, "property").contains("price:amount") | H.attr(e, "name").contains("price") | (H.attr(e, "itemprop") == "price"))))
    found = F.transform(F.array(F.coalesce(*tries)), lambda a: candidate(a, "meta_tag", 0.94, "Meta price tag"))
    return F.when(has_meta, _usable(found)).otherwise(F.array().cast(nested_type()))


def meta_candidates(parsed: DataFrame) -> DataFrame:
    return candidate_rows(parsed, meta_array())


def _mark(e: str, m: str) -> str:
    if m.startswith("#"):
        return f"{e}.id = '{m[1:]}'"
    if m.startswith("-"):
        return f"NOT array_contains({e}.classes, '{m[1:]}')"
    if m.startswith("~"):
        return f"contains({e}.cls, '{m[1:]}')"
    if m.startswith("@"):
        if "=" in m:
            name, value = m[1:].split("=")
            return f"element_at({e}.attrs, '{name}') = '{value}'"
        if "*" in m:
            name, part = m[1:].split("*")
            return f"contains(element_at({e}.attrs, '{name}'), '{part}')"
        return f"map_contains_key({e}.attrs, '{m[1:]}')"
    return f"array_contains({e}.classes, '{m}')"


def fits(e: str, steps) -> str:
    """SQL test: element ``e`` passes the last step and has ancestors that pass the others, in order.

    What the ancestors pass is in the element's marks. Text instead of Column calls: the selector tables make hundreds of these.
    """
    tag, *marks = steps[-1]
    tests = [f"{e}.tag = '{tag}'"] if tag else []
    tests += [_mark(e, m) for m in marks if m]
    if len(steps) > 1:
        tests.append(f"({e}.up & {bit_of(steps[:-1])}L) <> 0")
    return "coalesce(" + " AND ".join(tests or ["true"]) + ", false)"


def any_fit(e: str, alternatives) -> str:
    return "(" + (" OR ".join(fits(e, alt) for alt in alternatives) or "false") + ")"


def elements_fitting(alternatives) -> Column:
    """Elements that fit one of the alternatives, in document order."""
    return F.expr(f"filter(elements, e -> {any_fit('e', alternatives)})")


def some_fitting(alternatives) -> Column:
    return F.expr(f"exists(elements, e -> {any_fit('e', alternatives)})")


def first_fitting(alternatives) -> Column:
    return F.get(elements_fitting(alternatives), F.lit(0))


def platform_array() -> Column:
    """Candidates by the selectors of the page's shop system; needs the ``platform`` column."""
    none = F.array().cast(nested_type())
    table = {(p, label): alts for p, label, _, _, alts in X.SELECTORS}
    out = []
    for p, label, conf, is_mrp, alts in X.SELECTORS:
        first = F.slice(elements_fitting(alts), 1, 1)
        mrp, weight = F.lit(is_mrp), F.lit(conf)
        own = F.col("platform") == p
        if (p, label) == ("shopify", "regular"):  # next to a sale price the regular one is the struck price
            mrp = some_fitting(table[("shopify", "sale")])
            weight = F.when(mrp, 0.35).otherwise(conf)
        if label == "plain":
            own = own & ~some_fitting(table[(p, "sale")])
        made = F.transform(
            F.transform(first, lambda e: T.clean_price(H.element_text(e, ""))),
            lambda a: candidate(a, "adapter", weight, f"{p} {label} price", mrp),
        )
        if (p, label) == ("generic", "amazon"):
            made = F.filter(made, lambda c: c["amount"] > 40)
        out.append(F.when(own, made).otherwise(none))
    og = F.coalesce(
        _meta(lambda e: H.attr(e, "property") == "og:price:amount"), _meta(lambda e: H.attr(e, "property") == "product:price:amount"),
        _meta(lambda e: H.attr(e, "itemprop") == "price"))
    meta = F.array(candidate(T.clean_price(H.attr(og, "content")), "adapter", 0.95, "shopify meta price"))
    out.append(F.when(F.col("platform") == "shopify", meta).otherwise(none))
    return _usable(F.concat(*out))


def platform_candidates(parsed: DataFrame) -> DataFrame:
    return candidate_rows(parsed, platform_array())


# --- page price, stage total ----------------------------------------------------------

def _page_price(amount, source, label) -> Column:
    return F.when(amount.isNotNull(), F.struct(
        amount.cast(T.MONEY).alias("amount"), F.lit(source).alias("source"), F.lit(label).alias("confidence")))


def _nothing() -> Column:
    return F.struct(F.lit(None).cast(T.MONEY).alias("amount"), F.lit("NONE").alias("source"), F.lit("FAILED").alias("confidence"))


def _first_value(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _preferred(tests, price, only: str) -> Column:
    """Price of the element that passes the earliest test, in document order among equals.

    One pass over the elements for which ``only`` holds: each is priced once,
    whatever tests it passes. ``tests`` are SQL tests of an element ``e``.
    """
    ranks = " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tests))
    ranked = F.expr(
        f"filter(transform(filter(elements, e -> {only}), e -> named_struct('rank', CASE {ranks} END, 'e', e)), r -> r.rank IS NOT NULL)"
    )
    priced = F.transform(
        ranked, lambda r: F.struct(r["rank"].alias("rank"), r["e"]["pos"].alias("pos"), price(r["e"]).alias("amount"))
    )
    return F.array_min(F.filter(priced, lambda r: r["amount"].isNotNull()))["amount"]


def _jsonld_inline() -> Column:
    """First plausible price of a JSON-LD offer or priced object of the page."""
    parsed = F.transform(F.filter("scripts", lambda s: s["type"] == "application/ld+json"), lambda s: F.try_parse_json(s["body"]))
    items = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: _list_at(v, "$")))

    def prices(v):
        offers = F.transform(_list_at(v, "$.offers"), lambda o: T.parse_inr(F.try_variant_get(o, "$.price", "string")))
        typed = _kind(v).isin("Offer", "Product", "AggregateOffer") | F.try_variant_get(v, "$.priceCurrency", "string").isNotNull()
        return F.concat(offers, F.array(F.when(typed, T.parse_inr(F.try_variant_get(v, "$.price", "string")))))

    return _first_value(F.flatten(F.transform(items, prices)))


def clean_lines() -> Column:
    """Lines of the page outside header, navigation, footer, selects and asides."""
    texts = F.transform(F.filter(H.NODES, lambda n: ~n["chrome"]), lambda n: n["text"])
    return T.lines(F.array_join(texts, "\n"))


def product_price_struct() -> Column:
    """Advertised price by strict priority: JSON-LD, microdata, sale selectors, anchored line, clean line.

    Later sources are evaluated only when the earlier ones give nothing.
    """
    micro = F.transform(
        F.filter(H.ELEMENTS, lambda e: H.attr(e, "itemprop") == "price"),
        lambda e: F.coalesce(T.parse_inr(H.attr(e, "content")), T.first_inr(H.element_text(e, with_hidden=True))),
    )
    sale = _preferred(
        [fits("e", steps) for steps in X.SALE_SELECTORS],
        lambda e: F.coalesce(*[T.parse_inr(H.attr(e, a)) for a in X.DATA_PRICE_ATTRS], T.first_inr(H.element_text(e, with_hidden=True))),
        "NOT e.struck",
    )
    lines = clean_lines()
    anchored = F.transform(
        F.filter(lines, lambda x: ~T.contains_any(F.lower(x), X.LINE_MRP_WORDS)),
        lambda x: F.coalesce(*[T.parse_inr(T.first_group(x, rx)) for rx in X.RX_PRODUCT_ANCHORS]),
    )
    loose = F.transform(
        F.filter(lines, lambda x: ~T.found(x, X.RX_PRICE_EXCLUSION)), lambda x: T.first_inr(x)
    )
    return F.coalesce(
        _page_price(_jsonld_inline(), "JSON_LD", "HIGH"), _page_price(_first_value(micro), "MICRODATA", "HIGH"),
        _page_price(sale, "SEMANTIC_SELECTOR", "HIGH"), _page_price(_first_value(anchored), "REGEX_PROXIMITY", "MEDIUM"),
        _page_price(_first_value(loose), "FALLBACK", "LOW"), _nothing(),
    )


def _price_rows(parsed: DataFrame, price: Column, *more) -> DataFrame:
    return parsed.select("page_id", price.alias("b"), *more).select(
        "page_id", F.col("b.amount").alias("total"), F.col("b.source").alias("extraction_source"),
        F.col("b.confidence").alias("extraction_confidence"), *[c for c in ("n_rejected",) if more],
    )


def product_price(parsed: DataFrame) -> DataFrame:
    """Advertised price per page, and how many struck elements were left out."""
    rejected = F.size(F.filter(H.ELEMENTS, lambda e: e["struck"])).alias("n_rejected")
    return _price_rows(parsed, product_price_struct(), rejected)


def stage_total_struct() -> Column:
    """Cart or checkout total: summary containers, then strong anchor lines, then a plain total line.

    The text lines are those of the stored visible text, else of the page.
    """
    def anchored(x, rxs):
        return F.coalesce(*[T.parse_inr(T.first_group(x, rx)) for rx in rxs])

    def boxed(e):
        return T.let(H.element_text(e, with_hidden=True), lambda t: anchored(t, X.RX_TOTAL_ANCHORS))

    box = _preferred([fits("e", steps) for steps in X.SUMMARY_SELECTORS], boxed, "true")
    stored = F.when(F.col("visible_text") != "", F.col("visible_text"))
    lines = T.lines(F.coalesce(stored, H.page_text("\n")))
    strong = _first_value(F.transform(lines, lambda x: anchored(x, X.RX_TOTAL_ANCHORS[:2])))
    weak = _first_value(F.transform(lines, lambda x: anchored(x, X.RX_TOTAL_ANCHORS[2:])))
    return F.coalesce(
        _page_price(box, "DOM_SUMMARY_CONTAINER", "HIGH"), _page_price(strong, "TOTAL_ANCHOR", "HIGH"),
        _page_price(weak, "TOTAL_ANCHOR", "MEDIUM"), _nothing(),
    )


def stage_total(parsed: DataFrame) -> DataFrame:
    return _price_rows(parsed, stage_total_struct())


# --- components ---------------------------------------------------------------------

def _component(kind, label, amount, mandatory, by_default, delivery, raw) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(kind).alias("component_type"), lit(label).alias("label"), amount.cast(T.MONEY).alias("amount"),
        lit(mandatory).alias("is_mandatory"), lit(by_default).alias("selected_by_default"),
        lit(delivery).alias("is_delivery_dependent"), raw.alias("raw"),
    )


def _typed(text: Column, table, build) -> Column:
    low, out = F.lower(text), None
    for row in table:
        hit = T.contains_any(low, row[1])
        out = F.when(hit, build(row)) if out is None else out.when(hit, build(row))
    return out


def raw_components() -> Column:
    """Array of fee components of one page: checkbox add-ons first, then fee rows."""
    boxes = F.transform(
        F.filter(H.ELEMENTS, lambda e: H.is_checkbox(e)),
        lambda e: F.struct(H.label_text(e, False).alias("t"), H.is_checked(e).alias("on")),
    )
    from_boxes = F.transform(
        F.filter(boxes, lambda b: (b["t"] != "") & ~T.contains_any(F.lower(b["t"]), X.BASE_TOTAL_WORDS)),
        lambda b: _typed(b["t"], X.CHECKBOX_TYPES,
                         lambda r: _component(r[0], r[2], T.first_inr(b["t"]), False, b["on"], False, b["t"])),
    )
    # a row text of at most 180 characters has at most 90 pieces
    small = F.filter(H.ELEMENTS, lambda e: e["tag"].isin(X.FEE_ROW_TAGS) & (e["t1"] > e["t0"]) & (e["t1"] - e["t0"] <= 90))
    read = F.filter(
        F.transform(small, lambda e: F.struct(e.alias("e"), H.element_text(e, " ", True).alias("t"))),
        lambda r: (F.length(r["t"]) <= 180) & (
            T.contains_any(r["e"]["cls"], X.FEE_ROW_CLASSES)
            | T.contains_any(F.lower(H.element_text(r["e"], "", True)), X.FEE_ROW_WORDS)),
    )
    rows = F.transform(
        F.filter(read, lambda r: ~T.contains_any(F.lower(r["t"]), X.BASE_TOTAL_WORDS)
                 & ~r["e"]["box"] & ~H.inside(r["e"], ("label",))),
        lambda r: r["t"],
    )
    from_rows = F.transform(rows, lambda t: _typed(
        t, X.ROW_TYPES, lambda r: _component(r[0], r[2], T.first_inr(t), r[3], True, r[4], t)))
    return F.filter(F.concat(from_boxes, from_rows), lambda c: c.isNotNull() & (c["amount"] > 0))


def dedup_components(components: Column) -> Column:
    """First component per type and amount, order kept; sorted once, so that many components are no trouble."""
    keyed = F.array_sort(F.transform(components, lambda c, i: F.struct(c["component_type"].alias("k"), c["amount"].alias("a"), i.alias("i"), c.alias("c"))))

    def first_of_each(rows):
        before = lambda i: F.get(rows, i - 1)
        return F.filter(rows, lambda r, i: (i == 0) | (before(i)["k"] != r["k"]) | (before(i)["a"] != r["a"]))

    firsts = T.let(keyed, first_of_each)
    return F.transform(F.array_sort(F.transform(firsts, lambda r: F.struct(r["i"], r["c"]))), lambda r: r["c"])


def summed_from_smaller(cents: list[int]) -> list[bool]:
    """For each amount whether two or more of the strictly smaller ones add up to it within half a unit. Amounts are positive hundredths.

    Exact. One pass in ascending order serves all amounts: the reachable sums are a set while they are few, then one bit per
    multiple of the greatest common divisor, so they take at most an eighth of the largest amount's hundredths in bytes.
    """
    unit = math.gcd(*cents) or 1
    near = 49 // unit
    top = max(cents, default=0) // unit + near
    one, many, bits, found = set(), set(), None, {}
    for a, times in sorted(Counter(c // unit for c in cents).items()):
        low, high = max(a - near, 0), a + near
        if bits is None:
            found[a] = any(s in many for s in range(low, high + 1))
        else:
            found[a] = bool((bits >> low) & ((1 << (high - low + 1)) - 1))
        for _ in range(times):
            if bits is None:
                many.update([s + a for s in many | one if s + a <= top])
                one.add(a)
                if len(many) > MANY_SUMS:
                    bits, singles = as_bits(many, top), as_bits(one, top)
            else:
                bits |= ((bits | singles) << a) & ((1 << (top + 1)) - 1)
                singles |= 1 << a
    return [found[c // unit] for c in cents]


def as_bits(places: set[int], top: int) -> int:
    out = bytearray(top // 8 + 1)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


@F.pandas_udf(ArrayType(BooleanType()))
def _repeats_a_sum(cents: pd.Series) -> pd.Series:
    return cents.map(lambda c: None if c is None else summed_from_smaller([int(x) for x in c]) if len(c) > 2 else [False] * len(c))


def drop_aggregates(components: Column) -> Column:
    """Without rows that only repeat the sum of others or bundle several of them. Amounts are positive, as ``dedup_components`` gives them.

    The sums are worked out in an Arrow batch: give the components as a column of a narrow table, not among whole pages.
    """
    # a deterministic one would be copied into filters on the result, where it cannot be evaluated
    sums = _repeats_a_sum.asNondeterministic()(F.transform(components, lambda c: (c["amount"] * 100).cast("bigint")))

    def keep(c, repeats):
        bundle = T.contains_any(F.lower(c["raw"]), X.AGGREGATE_WORDS) & (F.size(F.filter(components, lambda o: o["amount"] < c["amount"])) >= 2)
        return ~(bundle | repeats)

    paired = F.zip_with(components, sums, lambda c, r: F.struct(c.alias("c"), r.alias("repeats")))
    return F.transform(F.filter(paired, lambda x: keep(x["c"], x["repeats"])), lambda x: x["c"])


def stage_components(parsed: DataFrame) -> DataFrame:
    """Fee components of every page: deduplicated, without aggregates, in page order."""
    d = parsed.select("page_id", dedup_components(raw_components()).alias("c"))
    return d.select("page_id", F.posexplode(drop_aggregates(F.col("c"))).alias("seq", "x")).select("page_id", "seq", "x.*")


# --- selection ------------------------------------------------------------------------

def source_weight(source: Column) -> Column:
    out = F.lit(X.DEFAULT_SOURCE_WEIGHT)
    for name, w in X.SOURCE_WEIGHTS:
        out = F.when(source == name, F.lit(w)).otherwise(out)
    return out


def rank_candidates(candidates: DataFrame, stage: str = "product") -> DataFrame:
    """Selected price per page, its source and whether strong sources disagree.

    Struck prices, discounts and foreign elements are out unless nothing else
    is left. One grouped aggregate, no sort and no window.
    """
    c = F.col
    ok = ~c("is_mrp") & ~c("is_discount") & (c("amount") > 0) & c("belongs_to_product")
    spare = ~c("is_discount") & (c("amount") > 0)
    score = c("confidence") * source_weight(c("source")) * F.when(c("stage") == stage, 1.0).otherwise(0.85)
    pick = lambda cond: F.min(F.when(cond, F.struct(-c("score"), "seq", "amount", "source", "confidence")))
    strong = (c("score") >= 0.75) & c("source").isin(X.CONFLICT_SOURCES)
    lo = lambda cond: F.min(F.when(cond & strong, c("amount")))
    hi = lambda cond: F.max(F.when(cond & strong, c("amount")))
    g = candidates.withColumn("score", score).groupBy("page_id").agg(
        F.count("*").alias("n_candidates"), pick(ok).alias("a"), pick(spare).alias("b"),
        F.coalesce(lo(ok) < hi(ok), F.lit(False)).alias("ca"), F.coalesce(lo(spare) < hi(spare), F.lit(False)).alias("cb"),
    )
    best = F.coalesce("a", "b")
    return g.select(
        "page_id", "n_candidates", best["amount"].alias("price"), F.coalesce(best["source"], F.lit("NONE")).alias("source"),
        F.coalesce(F.least(F.lit(0.99), best["confidence"]), F.lit(0.0)).alias("confidence"),
        F.when(F.col("a").isNotNull(), F.col("ca")).otherwise(F.col("cb")).alias("has_conflict"),
    )


def best_candidate(candidates: Column, fallback: Column) -> Column:
    """Selected price of one page from its candidate array: amount, source, confidence, has_conflict.

    Row form of ``rank_candidates`` for candidates of the page's own stage;
    without any usable one the fallback price counts with confidence 0.75.
    """
    spare = F.filter(candidates, lambda c: ~c["is_discount"] & (c["amount"] > 0))
    good = F.filter(spare, lambda c: ~c["is_mrp"] & c["belongs_to_product"])
    chosen = F.when(F.size(good) > 0, good).otherwise(spare)
    score = lambda c: c["confidence"] * source_weight(c["source"])
    best = F.array_min(F.transform(chosen, lambda c, i: F.struct(
        (-score(c)).alias("score"), i.alias("i"), c["amount"].alias("amount"), c["source"].alias("source"), c["confidence"].alias("confidence"))))
    strong = F.transform(F.filter(chosen, lambda c: (score(c) >= 0.75) & c["source"].isin(X.CONFLICT_SOURCES)), lambda c: c["amount"])
    made = lambda amount, source, conf, conflict: F.struct(
        amount.alias("amount"), source.alias("source"), conf.alias("confidence"), conflict.alias("has_conflict"))
    return (
        F.when(best.isNotNull(), made(best["amount"], best["source"], F.least(F.lit(0.99), best["confidence"]),
                                      F.coalesce(F.array_min(strong) < F.array_max(strong), F.lit(False))))
        .when(fallback["amount"].isNotNull(), made(fallback["amount"], fallback["source"], F.lit(0.75), F.lit(False)))
        .otherwise(made(F.lit(None).cast(T.MONEY), F.lit("NONE"), F.lit(0.0), F.lit(False)))
    )


def with_fallback(ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pages without any candidate take the fallback price with confidence 0.75. ``fallback``: page_id, total, extraction_source."""
    j = fallback.join(ranked, "page_id", "left")
    use = F.col("price").isNull() & F.col("total").isNotNull()
    return j.select(
        "page_id", F.coalesce("price", "total").alias("price"),
        F.when(use, F.col("extraction_source")).otherwise(F.coalesce("source", F.lit("NONE"))).alias("source"),
        F.when(use, 0.75).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
    )


def candidate_array() -> Column:
    """Candidates of all sources of a parsed page, in a fixed source order."""
    return F.concat(jsonld_array(), hydration_array(), meta_array(), platform_array())


def all_candidates(parsed: DataFrame) -> DataFrame:
    return candidate_rows(parsed, candidate_array()).withColumn("stage", F.lit("product"))
