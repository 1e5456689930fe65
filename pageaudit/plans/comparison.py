"""End-to-end comparison of listings."""

from pyspark.sql import DataFrame

from pageaudit.operators import compare
from pageaudit.session import written


def compare_listings(listings: DataFrame, offer_texts: DataFrame, reviews: DataFrame) -> dict:
    """All parts of a comparison, each as a table keyed by compare_id or listing_id.

    ``listings``: compare_id, listing_id, title, brand, sku, mpn, gtin, seller,
    condition, status, marketplace, listed_price, delivery_charge, findings_count.
    """
    # titles and offer lines are costly to take apart and read by several parts: written once
    fingerprints = written(compare.with_fingerprint(listings), "fingerprints")
    offers = written(compare.extract_offers(offer_texts), "offers")
    payable = compare.effective_prices(listings, offers)
    clusters = compare.review_clusters(compare.review_signals(reviews))
    return {
        "fingerprints": fingerprints,
        "matches": compare.canonical_match(fingerprints),
        "offers": offers,
        "effective_prices": payable,
        "inconsistencies": compare.price_inconsistencies(fingerprints, compare.best_offers(offers)),
        "review_clusters": clusters,
        "review_evidence": compare.review_evidence(clusters, comparisons=listings),
        "summary": compare.comparison_summary(listings.join(payable.select("listing_id", "payable"), "listing_id", "left")),
    }
