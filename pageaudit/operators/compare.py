"""Product comparison: fingerprints, matching, offers, prices and reviews.

Comparisons of at most MOST_PAIRED listings are dealt out by comparison once and
matched pair by pair within the task; no key or pair is shuffled or written.

Matching never builds the pairs of a larger group. Whether two listings match depends
only on which identifiers and attributes both of them carry, and on the values
of those. So every listing publishes one key per usable set of common fields
(at most 3 identifiers and 11 attribute sets); listings are counted and their
cheapest price kept per key and kind of listing; and each listing reads its
partners' totals from there with an equality join. The work is linear in the
number of listings however large a group is, and the totals are those of all
pairs.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import text as T
from pageaudit.functions.windows import crowded_keys
from pageaudit.session import cut_lineage, dealt, written  # noqa: F401


def _present(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", F.lower(F.trim(c)))


# --- fingerprints ----------------------------------------------------------

def with_fingerprint(listings: DataFrame) -> DataFrame:
    """Adds the product fingerprint of a listing: needs title, brand, sku, mpn, gtin (raw_text optional)."""
    raw = F.coalesce(F.col("raw_text"), F.lit("")) if "raw_text" in listings.columns else F.lit("")
    title = F.coalesce(F.col("title"), F.lit(""))
    df = listings.withColumn("_text", F.concat(title, F.lit(" "), raw))
    df = df.withColumn("storage", T.storage_of(F.col("_text")))
    first_word = F.get(T.words(title), F.lit(0))
    brand = F.coalesce(
        F.when(F.coalesce(F.col("brand"), F.lit("")) != "", F.col("brand")), F.when(F.length(first_word) > 2, first_word)
    )
    df = (
        df.withColumn("ram", T.ram_of(F.col("_text"), F.col("storage")))
        .withColumn("processor", T.processor_of(F.col("_text")))
        .withColumn("screen_size", T.screen_of(F.col("_text")))
        .withColumn("color", T.color_of(F.col("_text")))
        .withColumn("brand", brand)
    )
    at = F.expr("locate(lower(brand), lower(coalesce(title, '')))")
    after = F.when(at > 0, F.substring(title, at + F.length("brand"), F.length(title))).otherwise(title)
    model = F.array_join(F.slice(T.words(after), 1, 4), " ")
    filled = reduce(
        lambda a, b: a + b,
        [F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("sku", "mpn", "gtin", "ram", "storage", "processor")],
    )
    base = F.lit(0.35) + filled * 0.10 + F.when(F.col("brand").isNotNull(), 0.15).otherwise(0.0)
    return (
        df.withColumn("model", F.when(F.col("brand").isNotNull() & (title != "") & (model != ""), model))
        .withColumn("normalized_title", T.normalise_title(title))
        .withColumn("extraction_confidence", F.round(F.least(F.lit(0.95), base), 2))
        .drop("_text")
    )


def match_verdict(a, b) -> Column:
    """Verdict on two fingerprints; ``a`` and ``b`` map a field name to its column."""
    out = None
    for f in X.MATCH_IDS:
        x, y = _present(a(f)), _present(b(f))
        both = x.isNotNull() & y.isNotNull()
        result = F.when(x == y, "MATCHED").otherwise("NOT_MATCHED")
        out = F.when(both, result) if out is None else out.when(both, result)
    same, conflict = F.lit(0), F.lit(0)
    for f in X.MATCH_ATTRS:
        x, y = _present(a(f)), _present(b(f))
        same = same + F.when(x == y, 1).otherwise(0)
        conflict = conflict + F.when(x != y, 1).otherwise(0)
    brand = F.coalesce(_present(a("brand")) == _present(b("brand")), F.lit(False))
    ta, tb = a("normalized_title"), b("normalized_title")
    titled = (ta != "") & (tb != "")
    sim = T.title_similarity(ta, tb)
    return (
        out.when(conflict >= 1, "NOT_MATCHED")
        .when(brand & (same >= 3), "MATCHED")
        .when(brand & (same == 2), "PROBABLE_MATCH")
        .when(brand & (same == 1), "POSSIBLE_MATCH")
        .when(titled & (sim >= X.TITLE_SAME), "POSSIBLE_MATCH")
        .when(titled & (sim < X.TITLE_DIFFERENT), "NOT_MATCHED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def match_evidence(a, b) -> Column:
    """Fields that agree or conflict, as text."""
    parts = []
    for f in [*X.MATCH_IDS, "brand", *X.MATCH_ATTRS]:
        x, y = _present(a(f)), _present(b(f))
        parts.append(F.when(x == y, F.concat(F.lit(f + " match: "), a(f)))
                     .when(x != y, F.concat(F.lit(f + " conflict: "), a(f), F.lit(" vs "), b(f))))
    return F.concat_ws("; ", *parts)


FP_FIELDS = ["brand", "model", "normalized_title", *X.MATCH_IDS, *X.MATCH_ATTRS]


def canonical_match(fingerprints: DataFrame) -> DataFrame:
    """Every listing against the listing of its comparison with the most complete fingerprint.

    One row per listing; the reference listing matches itself. Ties go to the
    lower listing id. The per-comparison pick is a partial aggregate, and the
    join back has one row per comparison on its right side.
    """
    lead = F.struct(F.col("extraction_confidence"), (-F.col("listing_id")).alias("first"))
    best = fingerprints.groupBy("compare_id").agg(
        F.max_by(F.struct("listing_id", *FP_FIELDS), lead).alias("best")
    )
    j = fingerprints.join(best, "compare_id")
    a, b = (lambda f: F.col(f"best.{f}")), (lambda f: F.col(f))
    is_ref = F.col("listing_id") == F.col("best.listing_id")
    return j.select(
        "compare_id", "listing_id", F.col("best.listing_id").alias("canonical_listing"),
        F.when(is_ref, "MATCHED").otherwise(match_verdict(a, b)).alias("match_confidence"),
        F.when(is_ref, "Reference listing").otherwise(match_evidence(a, b)).alias("match_evidence"),
    )


# --- matching within a comparison, without pairs -----------------------------

def _masks(df: DataFrame) -> DataFrame:
    """Bit masks of the identifiers and attributes a listing carries."""
    bits = lambda fields: reduce(
        lambda a, b: a + b, [F.when(_present(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)]
    )
    return df.withColumn("id_mask", bits(X.MATCH_IDS)).withColumn("attr_mask", bits(X.MATCH_ATTRS))


def _published_keys() -> Column:
    """(code, key) for every identifier and every set of two or more attributes.

    Code of an identifier: its bit. Code of an attribute set: 8 plus its bits.
    """
    entries = []
    for i, f in enumerate(X.MATCH_IDS):
        entries.append(F.struct(F.lit(1 << i).alias("code"), _present(f).alias("key")))
    for n in (2, 3, 4):
        for combo in combinations(range(len(X.MATCH_ATTRS)), n):
            values = [_present("brand")] + [_present(X.MATCH_ATTRS[i]) for i in combo]
            # concat is NULL as soon as one field is missing
            key = F.concat(*[v for value in values for v in (value, F.lit("\u001f"))])
            entries.append(F.struct(F.lit(8 + sum(1 << i for i in combo)).alias("code"), key.alias("key")))
    return F.filter(F.array(*entries), lambda e: e["key"].isNotNull())


def _short_key(entry) -> Column:
    """A published key as 16 bytes: keys are only compared, and they are most of what a row carries to the shuffle."""
    return F.struct(entry["code"].alias("code"), F.unhex(F.md5(entry["key"].cast("binary"))).alias("key"))


#: Listings of a comparison, at most, that are matched pair by pair; of larger ones keys and totals are matched. Both give the same rows.
MOST_PAIRED = 256
MATCH_FIELDS = ["brand", *X.MATCH_IDS, *X.MATCH_ATTRS]


def _match_fields() -> list[Column]:
    """What listings are matched by, as it is compared; the functions above read these as they read the fields themselves."""
    return [_present(f).alias(f) for f in MATCH_FIELDS]


def _by_size(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings of comparisons to match pair by pair, and of those to match by keys."""
    crowded = crowded_keys(slim, "compare_id", MOST_PAIRED)
    return slim.join(crowded, "compare_id", "left_anti"), slim.join(crowded, "compare_id", "left_semi")


def _matched_pairs(listings: DataFrame, columns: list[str], condition: Column = None) -> DataFrame:
    """Each listing with each that it matches in its comparison, itself included (columns with ``p_``), and whether as MATCHED (``strong``).

    Both sides are the same rows, dealt out by comparison once (with renamed columns on both, so that Spark sees it); what
    follows per comparison stays in the task.
    """
    side = lambda s: listings.select("compare_id", *[F.col(c).alias(f"{s}_{c}") for c in [*columns, *MATCH_FIELDS]])
    either = lambda f, out: F.when(F.col(f).isNotNull() & F.col(f"p_{f}").isNotNull(), out)
    equal = lambda f: F.col(f) == F.col(f"p_{f}")
    by_id = F.coalesce(*[either(f, equal(f)) for f in X.MATCH_IDS])
    same = reduce(lambda a, b: a + b, [F.when(equal(f), 1).otherwise(0) for f in X.MATCH_ATTRS])
    conflict = reduce(lambda a, b: a | b, [F.coalesce(~equal(f), F.lit(False)) for f in X.MATCH_ATTRS])
    by_attrs = F.coalesce(equal("brand"), F.lit(False)) & ~conflict & (same >= 2)
    both = side("m").join(side("p"), "compare_id").withColumnsRenamed({f"m_{c}": c for c in [*columns, *MATCH_FIELDS]})
    pairs = both.where(F.coalesce(by_id, by_attrs))
    return (pairs if condition is None else pairs.where(condition)).withColumn("strong", by_id.isNotNull() | (same >= 3))


def _deciding_code(id_a, attr_a, id_b, attr_b) -> Column:
    """The fields that decide a pair: the first common identifier, else all common attributes."""
    ids, attrs = id_a.bitwiseAND(id_b), attr_a.bitwiseAND(attr_b)
    return F.when(ids > 0, ids.bitwiseAND(-ids)).when(F.bit_count(attrs) >= 2, attrs + 8)


def comparable_partners(fingerprints: DataFrame, payload=()) -> DataFrame:
    """Per listing: number of MATCHED and PROBABLE_MATCH partners, and its cheapest comparable listing.

    ``payload`` columns come along twice: of the listing in ``own``, of the
    cheapest partner in ``cheapest``. The listing itself takes part, so
    ``cheapest`` may be the listing. The slim table of match fields is read by both
    sides of the joins; it is written once to the shared folder so
    that titles are not taken apart twice.
    """
    slim = written(fingerprints.select(
        "compare_id", "listing_id", *_match_fields(), F.struct("listed_price", "listing_id", *payload).alias("own"),
        F.monotonically_increasing_id().alias("row"),
    ), "listings")
    few, many = _by_size(slim)
    columns = ["compare_id", "listing_id", "own", "n_matched", "n_probable", "best.cheapest", F.when(F.col("best.strong"), "MATCHED").otherwise("PROBABLE_MATCH").alias("product_match")]
    return _partners_by_pairs(few).select(*columns).unionByName(_partners_by_keys(many).select(*columns))


def _partners_by_pairs(few: DataFrame) -> DataFrame:
    pairs = _matched_pairs(few, ["listing_id", "own", "row"])
    other = F.struct("row", "listing_id") != F.struct("p_row", "p_listing_id")
    return pairs.groupBy("compare_id", "listing_id").agg(
        F.any_value("own").alias("own"),
        F.sum(F.when(F.col("strong") & other, 1).otherwise(0)).alias("n_matched"),
        F.sum(F.when(~F.col("strong") & other, 1).otherwise(0)).alias("n_probable"),
        F.min(F.struct(F.col("p_own.listed_price").alias("price"), F.col("p_own.listing_id").alias("id"), F.col("p_own").alias("cheapest"), F.col("strong"))).alias("best"),
    )


def _partners_by_keys(many: DataFrame) -> DataFrame:
    side = _masks(many).select("*", F.explode(F.transform(_published_keys(), _short_key)).alias("k")).select(
        "compare_id", "listing_id", "id_mask", "attr_mask", "own", "k.code", "k.key")
    totals = side.groupBy("compare_id", "code", "key", F.col("id_mask").alias("p_id"), F.col("attr_mask").alias("p_attr")).agg(
        F.count("*").alias("n"), F.min("own").alias("cheapest")
    )
    seen = side.join(totals, ["compare_id", "code", "key"]).where(
        F.col("code") == _deciding_code(F.col("id_mask"), F.col("attr_mask"), F.col("p_id"), F.col("p_attr"))
    )
    strong = (F.col("code") < 8) | (F.bit_count(F.col("code") - 8) >= 3)
    own = _deciding_code(F.col("id_mask"), F.col("attr_mask"), F.col("id_mask"), F.col("attr_mask")) == F.col("code")
    own = own & (F.col("p_id") == F.col("id_mask")) & (F.col("p_attr") == F.col("attr_mask"))
    others = F.col("n") - F.when(own, 1).otherwise(0)
    return seen.groupBy("compare_id", "listing_id").agg(
        F.any_value("own").alias("own"),
        F.sum(F.when(strong, others).otherwise(0)).alias("n_matched"),
        F.sum(F.when(strong, 0).otherwise(others)).alias("n_probable"),
        F.min(F.struct(F.col("cheapest.listed_price").alias("price"), F.col("cheapest.listing_id").alias("id"),
                       F.col("cheapest"), strong.alias("strong"))).alias("best"),
    )


def _units(c) -> Column:
    """Money in ten-thousandths, as a whole number; unknown is zero."""
    return (F.coalesce(F.col(c).cast("decimal(18,4)"), F.lit(0)) * 10000).cast("bigint")


def _at_or_above(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per (cls, t) of ``wanted``: the point (struct) of that class in ``points`` (cls, v, point) with the least v >= t.

    Both sides are distinct values, so a class that many listings share has at most as many rows as there are prices.
    """
    line = points.select("cls", "v", "point", F.lit(0).alias("asked")).unionByName(
        wanted.select("cls", F.col("t").alias("v"), F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.lit(1).alias("asked"))
    )
    down = Window.partitionBy("cls").orderBy(F.desc("v"), "asked")
    return line.withColumn("point", F.last("point", ignorenulls=True).over(down)).where("asked = 1 AND point IS NOT NULL").select("cls", F.col("v").alias("t"), "point")


def price_inconsistencies(fingerprints: DataFrame, best_offers: DataFrame) -> DataFrame:
    """Listings priced at least 5 % above comparable listings: one row per listing and explanation, against the cheapest such partner.

    Explanations of a gap, the first that holds: other attribute values (variant), another condition, an offer of either
    side worth three quarters of it, delivery charges that differ by as much, none of these (unexplained). So a
    gap that something explains does not hide an unexplained one against another partner.

    Listings of comparisons of at most MOST_PAIRED are compared pair by pair within the task (``_dearer_by_pairs``). Of larger ones
    partners are not listed: per key, kind, attribute values, condition, offer and charge (a class) the cheapest listing is
    kept by a partial aggregate, and each listing reads its classes with an equality join. Within a class of its own values and
    condition the gap is explained by an offer from some price upwards, likewise by charges; the cheapest partner there comes
    from one sorted pass over the distinct prices of the class. Rows grow with listings times classes of a key (distinct
    values, not listings). ``best_offers``: listing_id, best_offer (highest discount value). Sums are compared as whole
    ten-thousandths.
    """
    captured = fingerprints.where(F.col("status").isin("PRODUCT_CAPTURED", "CAPTURED") & (F.col("listed_price") > 0))
    values = F.array(*[F.coalesce(_present(f), F.lit("")) for f in X.MATCH_ATTRS])
    slim = written(_masks(captured.join(dealt(best_offers), "listing_id", "left")).select(
        "compare_id", "listing_id", "id_mask", "attr_mask", F.transform(_published_keys(), _short_key).alias("keys"),
        F.col("listed_price").cast(T.MONEY).alias("price"), _units("listed_price").alias("u"),
        values.alias("values"), F.coalesce(_present("condition"), F.lit("new")).alias("condition"), _units("best_offer").alias("offer"), _units("delivery_charge").alias("fee"),
        _present("seller").alias("seller"), *_match_fields(),
    ), "listings")
    few, many = _by_size(slim)
    return _explained(_dearer_by_pairs(few), slim, True).unionByName(_explained(_dearer_by_keys(many), many, False))


def _cheapest_partners(found: DataFrame) -> DataFrame:
    """Per listing and explanation the cheapest of the partners (struct of price and id) found that are cheaper by enough."""
    delta = (F.col("price") - F.col("partner.price")).cast(T.MONEY)
    pct = delta.cast("double") / F.col("partner.price").cast("double") * 100
    return found.where((delta > 0) & (pct >= X.MATERIAL_PCT)).groupBy("compare_id", "listing_id", "explanation").agg(
        F.any_value("price").alias("hi"), F.min(F.struct(F.col("partner.price").alias("lo"), F.col("partner.id").alias("id"), "strong")).alias("b")
    )


def _dearer_by_pairs(few: DataFrame) -> DataFrame:
    pairs = _matched_pairs(few, ["listing_id", "price", "u", "condition", "offer", "fee"], F.col("p_u") < F.col("u"))
    variant = reduce(lambda a, b: a | b, [F.coalesce(F.col(f) != F.col(f"p_{f}"), F.lit(False)) for f in X.MATCH_ATTRS])
    gap = 3 * (F.col("u") - F.col("p_u"))
    why = (
        F.when(variant, "variant").when(F.col("condition") != F.col("p_condition"), "condition").when(4 * F.greatest("offer", "p_offer") >= gap, "offer")
        .when(4 * F.abs(F.col("fee") - F.col("p_fee")) >= gap, "fee").otherwise("unexplained")
    )
    return _cheapest_partners(pairs.select(
        "compare_id", "listing_id", "price", F.struct(F.col("p_price").alias("price"), F.col("p_listing_id").alias("id")).alias("partner"), "strong", why.alias("explanation")
    ))


def _dearer_by_keys(many: DataFrame) -> DataFrame:
    slim = many.drop("seller", *MATCH_FIELDS)
    kind = ["id_mask", "attr_mask", "values", "condition", "offer", "fee"]
    side = slim.select("*", F.explode("keys").alias("k")).select("compare_id", "listing_id", *kind, "price", "u", "k.code", "k.key")
    cls = F.unhex(F.md5(F.to_json(F.struct("compare_id", "code", F.hex("key").alias("key"), *kind)).cast("binary")))
    classes = side.groupBy("compare_id", "code", "key", *[F.col(c).alias(f"p_{c}") for c in kind]).agg(F.min(F.struct("price", F.col("listing_id").alias("id"), "u")).alias("low"))
    seen = side.join(classes, ["compare_id", "code", "key"]).where(
        F.col("code") == _deciding_code(F.col("id_mask"), F.col("attr_mask"), F.col("p_id_mask"), F.col("p_attr_mask"))
    ).where(F.col("low.u") < F.col("u"))
    variant = F.exists(F.zip_with("values", "p_values", lambda a, b: (a != "") & (b != "") & (a != b)), lambda x: x)
    # a partner at v = 3 units or more is explained from these on: 4 * offer >= 3 * (price - partner's price)
    p_cls = F.unhex(F.md5(F.to_json(F.struct("compare_id", "code", F.hex("key").alias("key"), *[F.col(f"p_{c}").alias(c) for c in kind])).cast("binary")))
    seen = written(seen.select(
        "compare_id", "listing_id", "price", F.when(~variant & (F.col("condition") == F.col("p_condition")), p_cls).alias("cls"), "code", "low", F.when(variant, "variant").when(F.col("condition") != F.col("p_condition"), "condition").alias("plain"),
        (3 * F.col("u") - 4 * F.greatest("offer", "p_offer")).alias("t_offer"), (3 * F.col("u") - 4 * F.abs(F.col("fee") - F.col("p_fee"))).alias("t_fee"), (3 * F.col("u")).alias("top"),
    ), "partners")
    low = 3 * F.col("low.u")
    direct = seen.select(
        "compare_id", "listing_id", "price", "code", F.col("low").alias("partner"),
        F.coalesce("plain", F.when(low >= F.col("t_offer"), "offer").when(low >= F.col("t_fee"), "fee").otherwise("unexplained")).alias("explanation"),
    )
    open_ = seen.where("plain IS NULL")
    asked = open_.where((low < F.col("t_offer")) & (F.col("t_offer") < F.col("top"))).select("*", F.col("t_offer").alias("t"), F.lit("offer").alias("explanation")).unionByName(
        open_.where((low < F.col("t_fee")) & (F.col("t_fee") < F.col("t_offer"))).select("*", F.col("t_fee").alias("t"), F.lit("fee").alias("explanation")))
    wanted = asked.select("cls", "t").distinct()
    members = side.select(cls.alias("cls"), (3 * F.col("u")).alias("v"), F.struct("price", F.col("listing_id").alias("id"), "u").alias("point"))
    prices = members.join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls", "v").agg(F.min("point").alias("point"))
    above = asked.join(_at_or_above(prices, wanted), ["cls", "t"]).where((F.col("explanation") == "offer") | (3 * F.col("point.u") < F.col("t_offer")))
    found = direct.unionByName(above.select("compare_id", "listing_id", "price", "code", F.col("point").alias("partner"), "explanation"))
    return _cheapest_partners(found.withColumn("strong", (F.col("code") < 8) | (F.bit_count(F.col("code") - 8) >= 3)))


def _explained(best: DataFrame, slim: DataFrame, small: bool) -> DataFrame:
    """The rows of the result, with the facts of both listings. In ``small`` comparisons the listings are looked up within the comparison, where ``best`` is already."""
    facts = ["seller", "values", "condition", "offer", "fee"]
    mine = slim.select("compare_id", "listing_id", *[F.col(c).alias(f"a_{c}") for c in facts])
    theirs = slim.select(F.col("compare_id"), F.col("listing_id").alias("cheapest_listing"), *[F.col(c).alias(f"b_{c}") for c in facts])
    j = best.select("compare_id", "listing_id", "explanation", F.col("hi"), F.col("b.lo").alias("lo"), F.col("b.id").alias("cheapest_listing"), F.col("b.strong").alias("strong"))
    if small:
        for df, c in ((mine, "listing_id"), (theirs, "cheapest_listing")):
            # not an equality: that would deal both sides out anew, by both columns
            j = j.join(df.withColumnRenamed(c, "looked_up"), "compare_id").where((F.col(c) >= F.col("looked_up")) & (F.col(c) <= F.col("looked_up"))).drop("looked_up")
    else:
        j = j.join(mine, ["compare_id", "listing_id"]).join(theirs, ["compare_id", "cheapest_listing"])
    gap = (F.col("hi") - F.col("lo")).cast(T.MONEY)
    three = (gap.cast("decimal(18,4)") * 30000).cast("bigint")
    differs = F.exists(F.zip_with("a_values", "b_values", lambda a, b: (a != "") & (b != "") & (a != b)), lambda x: x)
    return j.select(
        "compare_id", "listing_id", "cheapest_listing", F.when(F.col("strong"), "MATCHED").otherwise("PROBABLE_MATCH").alias("product_match"),
        F.col("hi").alias("price_high"), F.col("lo").alias("price_low"), gap.alias("price_delta"),
        (F.floor(gap.cast("double") / F.col("lo").cast("double") * 100 * 10 + 0.5) / 10).alias("price_delta_pct"),
        same_seller(F.col("a_seller"), F.col("b_seller")).alias("same_seller"), (~differs).alias("same_variant"), (F.col("a_condition") == F.col("b_condition")).alias("same_condition"),
        (4 * F.greatest("a_offer", "b_offer") >= three).alias("offer_explains"), (4 * F.abs(F.col("a_fee") - F.col("b_fee")) >= three).alias("fee_explains"), "explanation",
    )


def same_seller(a: Column, b: Column) -> Column:
    """Both known, and equal or one name inside the other."""
    return F.coalesce((a == b) | a.contains(b) | b.contains(a), F.lit(False))


# --- offers ------------------------------------------------------------------

def _offer(kind, title, line, key, **fields) -> Column:
    types = {
        "coupon_code": "string", "discount_value": "double", "discount_percentage": "double",
        "minimum_purchase": "double", "bank": "string", "membership": "string",
        "is_conditional": "boolean", "is_applicable": "boolean",
    }
    cols = [F.lit(kind).alias("offer_type"), title.alias("offer_title"),
            line.alias("offer_text"), key.alias("offer_key")]
    for name, t in types.items():
        v = fields.get(name)
        cols.append((F.lit(v) if not isinstance(v, Column) else v).cast(t).alias(name))
    return F.struct(*cols)


def offer_marks(lined: DataFrame) -> DataFrame:
    """Adds what the offer patterns find in ``line``.

    Each pattern runs once, and only on lines that hold a word it needs.
    """
    line, low = F.col("line"), F.lower("line")
    if_any = lambda words, c: F.when(T.contains_any(low, words), c)
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    cut = ["off", "discount", "cashback"]
    marked = lined.select(
        "*", if_any(cut, T.first_group(line, X.RX_OFFER_INSTANT)).alias("inst_text"),
        if_any(["%"], T.first_group(line, X.RX_OFFER_PCT).try_cast("double")).alias("pct"),
        if_any(["exchange"], T.first_group(line, X.RX_OFFER_EXCHANGE)).alias("exchange_text"),
        if_any(["bank", "card", "credit", "debit"], F.trim(T.first_group(line, X.RX_OFFER_BANK))).alias("bank_name"),
        if_any(["get", "earn", "save", "extra"], F.trim(T.first_group(line, X.RX_OFFER_MEMBER))).alias("member"),
        if_any(["code", "coupon"], F.upper(T.first_group(line, X.RX_OFFER_COUPON))).alias("code"),
        if_any(["order", "min"], number(T.first_group(line, X.RX_OFFER_MIN))).alias("minimum"),
        F.coalesce(if_any(["emi"], T.found(line, X.RX_OFFER_EMI)), F.lit(False)).alias("is_emi"),
        T.contains_any(low, ["bank", "card"]).alias("is_tied"),
    )
    return marked.select(
        "*", number(F.col("inst_text")).alias("inst"), F.col("inst_text").isNotNull().alias("is_inst"),
        number(F.col("exchange_text")).alias("exchange"), F.col("exchange_text").isNotNull().alias("is_exchange"),
    )


def line_offers() -> Column:
    """Offers of one marked line. EMI and exchange come on top; of the other kinds the first that fits counts."""
    line, inst, pct, exchange = F.col("line"), F.col("inst"), F.col("pct"), F.col("exchange")
    bank, member, code, minimum = F.col("bank_name"), F.col("member"), F.col("code"), F.col("minimum")
    text = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    rupees = lambda v: F.concat(F.lit("₹"), T.money_text(v))
    has_min = F.coalesce(minimum != 0, F.lit(False))
    plain = ~F.col("is_tied")
    emi = _offer("emi", F.lit("No-cost EMI available"), line, F.concat(F.lit("emi:"), line),
                 is_conditional=True, is_applicable=False)
    swap = _offer("exchange",
                  F.when(F.coalesce(exchange, F.lit(0.0)) != 0, F.concat(F.lit("Exchange offer: "), rupees(exchange), F.lit(" off")))
                  .otherwise("Exchange offer"),
                  line, F.concat(F.lit("exchange:"), text(exchange)), discount_value=exchange,
                  is_conditional=True, is_applicable=False)
    by_bank = _offer("bank_offer", F.concat(F.lit("Bank offer: "), bank), line,
                     F.concat(F.lit("bank:"), F.lower(bank), F.lit(":"), text(inst), F.lit(":"), text(pct)),
                     bank=bank, discount_value=inst, discount_percentage=pct, is_conditional=True, is_applicable=False)
    by_member = _offer("membership", F.concat(F.lit("Membership offer: "), member), line,
                       F.concat(F.lit("membership:"), F.lower(member), F.lit(":"), text(inst)),
                       membership=member, discount_value=inst, is_conditional=True, is_applicable=False)
    by_code = _offer("coupon", F.concat(F.lit("Coupon code: "), code), line, F.concat(F.lit("coupon:"), code),
                     coupon_code=code, discount_value=inst, discount_percentage=pct, is_conditional=True, is_applicable=True)
    flat = _offer("instant_discount",
                  F.when(F.coalesce(inst, F.lit(0.0)) != 0, F.concat(F.lit("Instant discount: "), rupees(inst), F.lit(" off")))
                  .otherwise("Instant discount"),
                  line, F.concat(F.lit("instant:"), text(inst)), discount_value=inst, minimum_purchase=minimum,
                  is_conditional=has_min, is_applicable=~has_min)
    share = _offer("instant_discount", F.concat(pct.cast("string"), F.lit("% discount")), line,
                   F.concat(F.lit("pct:"), text(pct)), discount_percentage=pct, is_conditional=False, is_applicable=True)
    main = (
        F.when(bank.isNotNull(), by_bank).when(member.isNotNull(), by_member).when(code.isNotNull(), by_code)
        .when(F.col("is_inst") & plain, flat).when(pct.isNotNull() & plain, share)
    )
    every = F.array(F.when(F.col("is_emi"), emi), F.when(F.col("is_exchange"), swap), main)
    return F.filter(every, lambda o: o.isNotNull())


def extract_offers(texts: DataFrame, fields: list[str] = None) -> DataFrame:
    """Offers per listing from ``listing_id, text``; the first occurrence of a key counts. With ``fields`` only these columns of an offer."""
    lined = texts.select("listing_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    # every offer needs a digit or one of these words; other lines skip the patterns
    marks = r"(?i)\d|emi|code|coupon|get|earn|save|extra"
    found = offer_marks(lined.where(F.col("line").rlike(marks))).select(
        "listing_id", "line_no", F.posexplode(line_offers()).alias("slot", "o")
    )
    seq = (F.col("line_no") * 3 + F.col("slot")).alias("seq")
    offer = F.struct(*[F.col(f"o.{c}") for c in fields]).alias("o") if fields else F.col("o")
    keyed = found.select("listing_id", F.col("o.offer_key").alias("offer_key"), F.struct(seq, offer).alias("v"), seq)
    return keyed.groupBy("listing_id", "offer_key").agg(F.min_by("v", "seq").alias("v")).select("listing_id", "v.seq", "v.o.*")


def best_offers(offers: DataFrame) -> DataFrame:
    return offers.groupBy("listing_id").agg(F.max("discount_value").alias("best_offer"))


def effective_prices(listings: DataFrame, offers: DataFrame) -> DataFrame:
    """Listed price less applicable discounts plus fees; conditional savings are shown apart."""
    v = F.coalesce("discount_value", F.lit(0.0)).cast(T.MONEY)
    ok, cond = F.col("is_applicable"), F.col("is_conditional") & ~F.col("is_applicable")
    sums = offers.groupBy("listing_id").agg(
        F.sum(F.when(ok, v)).cast(T.MONEY).alias("applicable"),
        F.sum(F.when(cond, v)).cast(T.MONEY).alias("conditional"),
        F.count_if(cond & (v > 0)).alias("n_conditional"),
    )
    zero = F.lit(0).cast(T.MONEY)
    j = listings.where(F.col("listed_price") > 0).join(sums, "listing_id", "left").select(
        "listing_id", "compare_id", "listed_price",
        F.coalesce(F.col("delivery_charge").cast(T.MONEY), zero).alias("fees"),
        F.coalesce("applicable", zero).alias("applicable"), F.coalesce("conditional", zero).alias("conditional"),
        F.coalesce("n_conditional", F.lit(0)).alias("n_conditional"),
    ).withColumn("payable", (F.col("listed_price") - F.col("applicable") + F.col("fees")).cast(T.MONEY))
    r = lambda c: F.concat(F.lit("₹"), T.money_text(F.col(c)))
    note = F.concat_ws(
        " ", F.concat(F.lit("Listed: "), r("listed_price")),
        F.when(F.col("applicable") > 0, F.concat(F.lit("- "), r("applicable"), F.lit(" (applicable discount)"))),
        F.when(F.col("fees") > 0, F.concat(F.lit("+ "), r("fees"), F.lit(" (mandatory fees)"))),
        F.concat(F.lit("= "), r("payable")),
    )
    return j.withColumn("note", note)


# --- reviews -----------------------------------------------------------------

def review_signals(reviews: DataFrame) -> DataFrame:
    """Sentences with a complaint, one signal each; ``reviews``: review_id, listing_id, compare_id, text."""
    sentence = F.trim("sentence")
    kind = None
    for rx, name in X.REVIEW_SIGNALS:
        kind = F.when(T.found(sentence, rx), name) if kind is None else kind.when(T.found(sentence, rx), name)
    keep = [c for c in ("review_id", "listing_id", "compare_id", "marketplace") if c in reviews.columns]
    parts = F.posexplode(F.split("text", r"(?<=[.!?\n])\s+")).alias("pos", "sentence")
    return (
        reviews.select(*keep, parts)
        .select(*keep, "pos", sentence.alias("snippet"), kind.alias("signal_type"), F.lit(X.REVIEW_CONFIDENCE).alias("confidence"))
        .where("signal_type is not null")
    )


def review_clusters(signals: DataFrame, key="compare_id") -> DataFrame:
    """Clusters per signal type with the first snippet as their face."""
    n = F.count("*")
    return signals.groupBy(key, "signal_type").agg(
        n.alias("review_count"), F.min_by("snippet", F.struct("review_id", "pos")).alias("snippet"),
        F.round(F.least(F.lit(0.95), 0.6 + n * 0.1), 2).alias("confidence"),
    )


def review_evidence(clusters: DataFrame, key="compare_id", comparisons: DataFrame = None) -> DataFrame:
    """Overall corroboration; at most eight signal types per key are listed, most frequent first.

    Keys of ``comparisons`` without any signal are CLEAN; without that table only keys with signals are returned.
    """
    total = F.sum("review_count")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("review_count")).alias("n"), "signal_type")))
    found = clusters.groupBy(key).agg(
        total.alias("total_signals"), F.array_join(F.transform(ranked, lambda s: s["signal_type"]), ",").alias("concerns")
    )
    if comparisons is not None:
        found = comparisons.select(key).distinct().join(found, key, "left").fillna({"total_signals": 0, "concerns": ""})
    n = F.col("total_signals")
    level = F.when(n >= 3, "CORROBORATED").when(n >= 1, "WEAK_SIGNAL").otherwise("CLEAN")
    return found.select(key, "total_signals", level.alias("corroboration"), "concerns")


# --- summary -----------------------------------------------------------------

BLOCKED = ["BOT_CHALLENGE", "ACCESS_BLOCKED", "PAGE_NOT_FOUND", "PRODUCT_NOT_FOUND"]


def comparison_summary(listings: DataFrame) -> DataFrame:
    """Status per comparison, its best price and its cleanest listing.

    Needs compare_id, listing_id, status, payable and findings_count.
    """
    ok = F.col("status").isin("PRODUCT_CAPTURED", "CAPTURED")
    g = listings.groupBy("compare_id").agg(
        F.count("*").alias("n_listings"), F.count_if(ok).alias("captured"),
        F.count_if(F.col("status").isin(BLOCKED)).alias("blocked"),
        F.min(F.when(ok & F.col("payable").isNotNull(), F.struct("payable", "listing_id"))).alias("cheapest"),
        F.min(F.when(ok, F.struct("findings_count", "listing_id"))).alias("cleanest"),
    )
    status = F.when((F.col("blocked") > 0) & (F.col("captured") > 0), "PARTIAL").when(F.col("captured") == 0, "ERROR").otherwise("DONE")
    return g.select(
        "compare_id", "n_listings", "captured", "blocked", status.alias("status"),
        F.col("cheapest.listing_id").alias("cheapest_listing"), F.col("cheapest.payable").alias("lowest_payable"),
        F.col("cleanest.listing_id").alias("cleanest_listing"),
    )
