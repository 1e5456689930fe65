"""Marks handed down by the parse against a plain search of all ancestors; cost of large pages."""

import random
import time

from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions import marks
from pageaudit.functions.htmlrows import page_rows
from pageaudit.operators import prices as P
from pageaudit.operators import structure as H


def all_selectors():
    return [s for s in marks._selectors()]


def random_page(rng, n):
    """Nested elements that carry parts of the selectors; some are left open."""
    steps = [step for s in all_selectors() for step in s] + [("label",), ("header",), ("div",), ("ins",), ("del",)]
    out, depth = [], []
    for k in range(n):
        tag, *given = rng.choice(steps)
        tag = tag or rng.choice(["div", "span", "b"])
        classes = [m for m in given if m and m[0] not in "-~#@"] + [m[1:] for m in given if m and m[0] in "~-" and rng.random() < 0.5]
        attrs = "".join(f' {m[1:].replace("*", "=")}' if "=" in m or "*" in m else f" {m[1:]}=1" for m in given if m and m[0] == "@")
        name = next((f' id="{m[1:]}"' for m in given if m and m[0] == "#"), f' id="i{rng.randint(0, 30)}"')
        out.append(f'<{tag} class="{" ".join(classes)}"{name}{attrs}>₹{rng.randint(1, 99)}00')
        depth.append(tag)
        if rng.random() < 0.1:
            out.append(f'<input type="{rng.choice(["checkbox", "text"])}" id="i{rng.randint(0, 30)}"><label for="i{rng.randint(0, 30)}">L{k}</label>')
        while depth and (rng.random() < 0.45 or len(depth) > 12):
            gone = depth.pop()
            if rng.random() < 0.9:
                out.append(f"</{gone}>")
    return "".join(out)


def plain_fits(elements, e, steps):
    tag, *given = steps[-1]
    pairs = dict(e["attrs"])
    if (tag and e["tag"] != tag) or not all(marks._passes(m, pairs, e["classes"], e["cls"]) for m in given if m):
        return False
    return len(steps) == 1 or any(a["pos"] < e["pos"] <= a["last"] and plain_fits(elements, a, steps[:-1]) for a in elements)


def test_marks_equal_a_search_of_all_ancestors(page):
    rng = random.Random(11)
    pages = [random_page(rng, 60) for _ in range(25)]
    parsed = H.parse_pages(page(*[("https://a.com", h) for h in pages])).cache()
    selectors = [s for s in all_selectors() if len(s) > 1]
    found = parsed.select("page_id", *[F.transform(P.elements_fitting([s]), lambda e: e["pos"]).alias(f"s{k}") for k, s in enumerate(selectors)]).collect()
    hits = 0
    for row in found:
        rows = page_rows(pages[row["page_id"]])
        for k, s in enumerate(selectors):
            want = [e["pos"] for e in rows.elements if plain_fits(rows.elements, e, s)]
            assert row[f"s{k}"] == want, (s, pages[row["page_id"]])
            hits += len(want)
    assert hits > 100
    inner = parsed.select("page_id", *[
        F.transform(F.filter("elements", test), lambda e: e["pos"]).alias(n)
        for n, test in (("label", lambda e: H.inside(e, ("label",))), ("header", lambda e: H.inside(e, ("header",))), ("box", lambda e: e["box"]))
    ], F.transform(F.filter("elements", lambda e: e["label"].isNotNull()), lambda e: F.struct(e["pos"], e["label"])).alias("named")).collect()
    for row in inner:
        es = page_rows(pages[row["page_id"]]).elements
        for tag in ("label", "header"):
            assert row[tag] == [e["pos"] for e in es if any(a["tag"] == tag and a["pos"] < e["pos"] <= a["last"] for a in es)]
        box = [e["pos"] for e in es if e["tag"] == "input" and dict(e["attrs"]).get("type") == "checkbox"]
        assert row["box"] == [e["pos"] for e in es if any(e["pos"] < b <= e["last"] for b in box)]
        first = {}
        for e in es:
            if e["tag"] == "label":
                first.setdefault(dict(e["attrs"]).get("for"), e["pos"])
        assert [tuple(x) for x in row["named"]] == [(e["pos"], first[e["id"]]) for e in es if e["tag"] == "input" and e["id"] in first]


def shop_page(n):
    """A cart of n elements: fee rows with labelled checkboxes below price containers."""
    rows = "".join(
        f'<div class="fee-row price-list" id="r{k}"><span class="price">Delivery fee ₹{k % 900 + 1}</span><label for="c{k}">Add insurance ₹{k % 700 + 5}</label>'
        f'<input type="checkbox" id="c{k}" checked></div>' for k in range(n // 4)
    )
    return f"<html><body><div class='summary'>{rows}</div></body></html>"


def test_large_pages_cost_in_proportion(page, spark):
    def seconds(n):
        parsed = H.parse_pages(page(("https://a.com/cart", shop_page(n), "cart")).withColumn("platform", F.lit("shopify"))).cache()
        parsed.count()
        best = 99.0
        for _ in range(3):
            start = time.time()
            parsed.select(F.size(P.dedup_components(P.raw_components())), P.platform_array(), P.product_price_struct(), P.stage_total_struct()).collect()
            H.checkbox_labels(parsed).count()
            best = min(best, time.time() - start)
        return best

    seconds(400)
    small, large = seconds(3000), seconds(12000)
    assert large < 5 * small + 0.5, (small, large)


def test_components_are_deduplicated_in_order(page):
    html = "".join(f'<div class="fee-row"><span>{w} ₹{a}</span></div>' for w, a in [("Delivery fee", 40), ("Packing fee", 9), ("Delivery fee", 40), ("Delivery fee", 41), ("Packing fee", 9)])
    parsed = H.parse_pages(page(("https://a.com/cart", html, "cart")))
    raw = [(c["component_type"], c["amount"]) for c in parsed.select(P.raw_components().alias("c")).first()["c"]]
    got = [(c["component_type"], c["amount"]) for c in parsed.select(P.dedup_components(P.raw_components()).alias("c")).first()["c"]]
    assert got == list(dict.fromkeys(raw)) and len(raw) > len(got) > 1
