"""Classification of pages, access results, platforms and listings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import contains_any, found, let, path_of


def page_state(url: Column, text: Column) -> Column:
    """Purchase stage a page belongs to, from its address, then its text."""
    u, t = F.lower(url), F.lower(text)
    late = F.when(contains_any(t, ["pay now", "place order", "upi", "card number"]), "payment").otherwise("checkout")
    return (
        F.when(contains_any(u, ["/cart", "/basket", "/bag", "/trolley"]), "cart")
        .when(contains_any(u, ["/checkout", "/order-summary", "/review-order"]), late)
        .when(contains_any(u, ["/product", "/item", "/dp/", "/p/"]), "product")
        .when(contains_any(t, ["add to cart", "buy now"]), "product")
        .otherwise("unknown")
    )


def page_type(url: Column, html: Column) -> Column:
    path = F.regexp_replace(path_of(url), "^/+|/+$", "")
    low = F.lower(path)
    category = contains_any(low, X.CATEGORY_WORDS) & ~low.rlike("/products?/[^/]+$")
    return (
        F.when((path == "") | path.isin(X.HOME_PATHS), "HOMEPAGE")
        .when(contains_any(low, X.CART_WORDS), "CART")
        .when(contains_any(low, X.CHECKOUT_WORDS), "CHECKOUT")
        .when(category, "CATEGORY")
        .when(contains_any(low, X.PRODUCT_PATHS), "PRODUCT")
        .when(contains_any(F.coalesce(html, F.lit("")), X.PRODUCT_MARKUP), "PRODUCT")
        .when(path.contains("/"), "PRODUCT")
        .otherwise("UNKNOWN")
    )


def access_status(http_status: Column, html: Column, text: Column, error: Column) -> Column:
    """Why a page could or could not be read; the order of the tests matters."""
    h, t = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))
    failed = F.coalesce(error, F.lit("")) != ""
    return let(F.lower(F.concat(t, F.lit(" "), h)), lambda low: (
        F.when(failed & F.lower(error).contains("timeout"), "TIMEOUT")
        .when(failed, "NETWORK_ERROR")
        .when((F.coalesce(http_status, F.lit(0)) == 0) & (h == ""), "NETWORK_ERROR")
        .when((http_status == 404) | contains_any(low, X.NOT_FOUND_SIGNALS), "PAGE_NOT_FOUND")
        .when(http_status == 401, "LOGIN_REQUIRED")
        .when(http_status == 429, "RATE_LIMITED")
        .when((http_status == 403) & contains_any(low, X.BOT_SIGNALS), "BOT_CHALLENGE")
        .when(http_status == 403, "FORBIDDEN")
        .when(http_status == 503, "RATE_LIMITED")
        .when(http_status >= 500, "NETWORK_ERROR")
        .when(contains_any(low, X.CAPTCHA_SIGNALS), "CAPTCHA_PRESENT")
        .when(contains_any(low, X.BOT_SIGNALS), "BOT_CHALLENGE")
        .when(low.contains("enable javascript"), "JS_REQUIRED")
        .otherwise("ACCESS_OK")
    ))


def platform(html: Column, url: Column) -> Column:
    """Shop system, first match in a fixed order."""
    h = F.coalesce(html, F.lit(""))
    low = F.lower(h)
    shop_url = contains_any(url, ["myshopify.com", "/collections/", "/products/"])
    return (
        F.when(
            (shop_url & low.contains("shopify"))
            | contains_any(h, ["cdn.shopify.com", "window.Shopify", 'name="shopify-features"']),
            "shopify",
        )
        .when(low.contains("woocommerce"), "woocommerce")
        .when(contains_any(h, ["mage/cookies.js", "text/x-magento-init", "data-mage-init"]), "magento")
        .when(contains_any(h, ["cdn11.bigcommerce.com", "stencil-utils"]) | low.contains("bigcommerce"), "bigcommerce")
        .otherwise("generic")
    )


def listing_status(access: Column, http_status: Column, title: Column, product_state: Column, p0: Column) -> Column:
    missing = (
        (access == "PAGE_NOT_FOUND") | http_status.isin(404, 410) | found(F.coalesce(title, F.lit("")), X.RX_TITLE_NOT_FOUND)
    )
    captured = F.coalesce(product_state == "CAPTURED", F.lit(False)) | (F.coalesce(p0, F.lit(0)) != 0)
    return (
        F.when(F.coalesce(missing, F.lit(False)), "PAGE_NOT_FOUND")
        .when(access.isin("BOT_CHALLENGE", "CAPTCHA_PRESENT"), "BOT_CHALLENGE")
        .when(access.isin("FORBIDDEN", "NETWORK_ERROR", "TIMEOUT", "ACCESS_BLOCKED"), "ACCESS_BLOCKED")
        .when(~captured, "PRODUCT_NOT_FOUND")
        .otherwise("PRODUCT_CAPTURED")
    )


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.85, "HIGH").when(c >= 0.50, "MEDIUM").otherwise("LOW")
