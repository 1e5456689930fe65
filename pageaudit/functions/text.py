"""Text predicates and extractors as Column expressions."""

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageaudit import fixed as X


def icase(rx: str) -> str:
    """Case-insensitive; ``.`` stops only at a line feed."""
    return "(?id)" + rx


def plain_spaces(c: Column) -> Column:
    """Unicode blanks become ASCII blanks, so that ``\\s`` sees them."""
    blanks = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    return F.translate(c, blanks, " " * len(blanks))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def contains_any(c: Column, words) -> Column:
    """``c`` contains one of the words; ``c`` is evaluated once however many words there are."""
    if not words:
        return F.lit(False)
    return let(c, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))


def found(c: Column, rx: str) -> Column:
    return c.rlike(icase(rx))


def matches(c: Column, rx: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(icase(rx)), F.lit(group))


def first_group(c: Column, rx: str, group: int = 1) -> Column:
    """Group of the first match, NULL when nothing matches."""
    return F.get(matches(c, rx, group), F.lit(0))


def user_facing(c: Column) -> Column:
    """Readable page text rather than code or markup."""
    return ~contains_any(c, X.CODE_MARKERS) & c.rlike("[A-Za-z0-9]")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\u000b\u000c"))


def lines(c: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(c, "\r\n|[\n\r\u000b\u000c\u0085\u2028\u2029]"), lambda x: strip(x)), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def money_text(c: Column) -> Column:
    return F.format_number(c, 0)


# --- money ---------------------------------------------------------------

MONEY = "decimal(14,2)"


def parse_inr(c: Column) -> Column:
    """Amount within the plausible range, NULL otherwise."""
    v = F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("decimal(24,6)")
    return F.when((v >= X.INR_MIN) & (v <= X.INR_MAX), F.bround(v, 2).cast(MONEY))


def first_inr(c: Column) -> Column:
    """First currency-marked amount that is plausible."""
    amounts = F.transform(
        matches(c, X.RX_INR), lambda m: parse_inr(F.regexp_extract(m, r"([\d,]+(?:\.\d{1,2})?)", 1))
    )
    return F.get(F.filter(amounts, lambda v: v.isNotNull()), F.lit(0))


def prices_in_text(c: Column) -> Column:
    """Every distinct number from one to ten million, ascending; the currency mark is optional."""
    values = F.transform(
        matches(c, X.RX_LOOSE_PRICE, 1),
        lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"),
    )
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.between(1, 10_000_000))))


def clean_price(c: Column) -> Column:
    """Positive number left after dropping everything but digits and dots."""
    v = F.regexp_replace(c, r"[^\d.]", "").try_cast("double")
    return F.when(v > 0, v)


# --- titles --------------------------------------------------------------

def _folds():
    """Compatibility decomposition of the Latin, letter-like and full-width blocks.

    A combining mark is not a word character, so each one becomes a blank.
    """
    blocks = [(0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
    out = {}
    for lo, hi in blocks:
        for code in range(lo, hi + 1):
            ch = chr(code)
            plain = unicodedata.normalize("NFKD", ch)
            if plain != ch:
                out[ch] = "".join(" " if unicodedata.combining(p) else p for p in plain)
    return out


def fold_accents(c: Column) -> Column:
    folds = _folds()
    table = F.create_map(*[F.lit(v) for pair in folds.items() for v in pair])
    folded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(ch > "\u007f", F.coalesce(F.element_at(table, ch), ch)).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def normalise_title(c: Column) -> Column:
    t = F.regexp_replace(fold_accents(c), r"(?U)[^\w\s]", " ")
    t = F.regexp_replace(t, icase(X.RX_TITLE_NOISE), " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of the token sets of two normalised titles."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0))
        .when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


# --- hardware attributes in a title ---------------------------------------

def storage_of(c: Column) -> Column:
    explicit = matches(c, X.RX_STORAGE)
    first = F.get(explicit, F.lit(0))
    amount = F.regexp_extract(first, r"(\d+)", 1)
    unit = F.upper(F.regexp_extract(first, r"(?i)\d+\s*(gb|tb)", 1))
    kind = F.upper(F.regexp_extract(first, r"(?i)([a-z]+)$", 1))
    loose = F.get(matches(c, X.RX_STORAGE_LOOSE), F.lit(0))
    return F.coalesce(
        F.concat(amount, unit, F.lit(" "), kind), F.upper(F.regexp_replace(loose, r"\s", ""))
    )


def ram_of(c: Column, storage: Column) -> Column:
    explicit = first_group(c, X.RX_RAM)
    loose = F.filter(
        matches(c, X.RX_RAM_LOOSE, 1),
        lambda n: storage.isNull() | ~F.lower(storage).contains(F.concat(n, F.lit("gb"))),
    )
    return F.concat(F.coalesce(explicit, F.get(loose, F.lit(0))), F.lit("GB"))


def processor_of(c: Column) -> Column:
    return F.lower(F.trim(first_group(c, X.RX_PROCESSOR, 0)))


def screen_of(c: Column) -> Column:
    return F.concat(first_group(c, X.RX_SCREEN), F.lit(" inch"))


def color_of(c: Column) -> Column:
    return F.lower(F.trim(first_group(c, X.RX_COLOR, 0)))


# --- urls ------------------------------------------------------------------

def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def _without_dots(url: Column) -> Column:
    """``url`` with the segments ``.`` and ``..`` of its path worked off."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    step = lambda acc, seg: (
        F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))
    )
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*/)?\.\.?([/?#]|$)"),
                  F.concat(origin, F.lit("/"), F.array_join(closed, "/"), tail)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link found on page ``base``."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.regexp_extract(page, r"://[^/]*(/)", 1) == "", F.concat(page, F.lit("/"))).otherwise(
        F.regexp_replace(page, r"[^/]*$", "")
    )
    h = F.trim(href)
    return _without_dots(
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), h))
        .when(h == "", base)
        .otherwise(F.concat(folder, h))
    )


def marketplace_of(url: Column) -> Column:
    u = F.lower(url)
    out = F.lit("unknown")
    for key, _, domain in reversed(X.MARKETPLACES):
        out = F.when(u.contains(domain), F.lit(key)).otherwise(out)
    return out
