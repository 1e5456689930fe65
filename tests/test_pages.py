"""Parser, element rules and the cheap page test on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from pageaudit.functions.htmlrows import page_rows
from pageaudit.operators import element_rules as ER
from pageaudit.operators import structure as H

FLASH = """<html><head><title>Deal</title></head><body><div class="countdown">04:32</div><p>Hurry! Only 2 left in stock</p>
<p>18 people viewing</p><span class="price">₹2,499</span><s>₹6,999</s></body></html>"""
FLIGHT = "<html><body><h1>Flight</h1><p>Departure 06:15 AM</p><div class='fare'>Fare: ₹4,890</div></body></html>"
SEAT = """<html><body><label><input type="checkbox" checked>Join the loyalty care club</label><a href="/next" style="font-size: 10px">Skip</a></body></html>"""
COURSE = """<html><body><input type="checkbox" id="d" checked><label for="d">Donation to the welfare foundation ₹10</label></body></html>"""
ADDONS = """<html><body><div><button>No thanks, I prefer full price</button></div>
<label><input type="checkbox" checked> Extended warranty</label><label><input type="checkbox" checked> Gift wrap</label>
<label><input type="checkbox" checked> Newsletter with premium tips</label></body></html>"""
CLEAN = "<html><body><h1>Chair</h1><p>Price ₹8,990, all included.</p><label><input type='checkbox'> Care plan ₹799</label><button>No thank you</button></body></html>"


def rules_of(page, html, url="https://a.com/product/1"):
    f = ER.detect_all(H.parse_pages(page((url, html))))
    return sorted(r.rule_id for r in f.collect())


@pytest.mark.parametrize("html,expected", [
    (FLASH, ["FU_COUNTDOWN_TIMER", "FU_DEADLINE_TEXT", "FU_SCARCITY_CLAIM", "FU_SOCIAL_PROOF"]),
    (FLIGHT, []),
    (SEAT, ["BS_PRE_TICKED_CHECKBOX", "II_VISUAL_ASYMMETRY"]),
    (COURSE, ["BS_PRE_TICKED_CHECKBOX"]),
    (ADDONS, ["BS_PRE_TICKED_CHECKBOX", "BS_PRE_TICKED_CHECKBOX", "CS_SHAME_DECLINE"]),
    (CLEAN, []),
])
def test_fixture_pages(page, html, expected):
    assert rules_of(page, html) == expected


def test_second_timer_phase_needs_the_first_to_be_empty(page):
    marked = "<div class='timer'>10:00</div><p>Offer expires in 09:59 mins</p>"
    p = H.parse_pages(page(("https://a.com/x", marked), ("https://a.com/x", "<p>Offer expires in 09:59 mins</p>"), ("https://a.com/x", "<pre>ends in 09:59 mins</pre>")))
    got = {r.page_id: r.s for r in p.select("page_id", ER.timer_snippets().alias("s")).collect()}
    assert got == {0: ["10:00"], 1: ["Offer expires in 09:59 mins"], 2: []}


def test_code_is_no_evidence(page):
    assert rules_of(page, "<div class='timer'>var t = '10:00';</div>") == []


def test_hidden_text_is_ignored(page):
    assert rules_of(page, "<script>var a='Only 2 left'</script><template><p>Only 2 left</p></template><noscript>Hurry</noscript><p>x</p>") == []


def test_parser_closes_what_authors_leave_open():
    p = page_rows("<ul><li>a<li>b</ul><p><b>x<br><p>y<table><tr><td>1<td>2<tr><td>3</table><div>z</i></div>")
    tags = [(e["tag"], e["parent"], e["last"]) for e in p.elements]
    assert [t[0] for t in tags] == ["ul", "li", "li", "p", "b", "br", "p", "table", "tr", "td", "td", "tr", "td", "div"]
    by = p.elements
    assert by[2]["parent"] == 0 and by[6]["parent"] == -1 and by[10]["parent"] == 8 and by[13]["parent"] == -1
    assert [n["text"] for n in p.nodes] == ["a", "b", "x", "y", "1", "2", "3", "z"]


def test_parser_keeps_intervals_nested():
    import random
    rnd = random.Random(5)
    names = ["div", "p", "li", "ul", "span", "b", "table", "tr", "td", "br", "label", "input"]
    for _ in range(200):
        html = "".join(rnd.choice(["<{}>", "</{}>", "t{}", "<{} a=1 class='x y'>"]).format(rnd.choice(names)) for _ in range(40))
        els = page_rows(html).elements
        for e in els:
            assert e["pos"] <= e["last"] < len(els) and e["t0"] <= e["t1"]
            if e["parent"] >= 0:
                up = els[e["parent"]]
                assert up["pos"] < e["pos"] and e["last"] <= up["last"] and up["t0"] <= e["t0"] and e["t1"] <= up["t1"]


def test_labels(page):
    html = """<input type=checkbox id=a><label for=a>By id</label><label>Around <input type=checkbox></label><input type=checkbox> after
    <div><input type=checkbox><span>next</span></div><p><input type=checkbox> </p>"""
    got = [r.label for r in H.checkbox_labels(H.parse_pages(page(("https://a.com", html)))).orderBy("pos").collect()]
    assert got == ["By id", "Around", "after", "next", ""]


def test_links_identity_redaction(page):
    html = """<head><meta property="og:title" content="Lamp X - Flipkart.com"></head><body><div class="pdp-details"><a href="../b?c=1#d">B</a><a href="//o.com/x">O</a>
    <a href="mailto:x@y.z">M</a></div><input name="card_number" value="4111"><input name="qty" value="2"><input type="password" value="s"></body>"""
    p = H.parse_pages(page(("https://a.com/x/y/z", html)))
    got = [(r.dst_url, r.same_host) for r in H.links(p).orderBy("seq").collect()]
    assert got == [("https://a.com/x/b?c=1#d", True), ("https://o.com/x", False), ("mailto:x@y.z", False)]
    i = H.identity(p).first()
    assert (i.title, i.container) == ("Lamp X", ".pdp-details")
    e = H.elements_table(H.redact(p)).where("tag = 'input'").orderBy("pos").collect()
    assert [("value" in r.attrs) for r in e] == [False, True, False]


def test_struck_and_unrelated(page, one):
    p = H.parse_pages(page(("https://a.com", "<div class='was-price'><b>₹9</b></div><del>₹8</del><i>₹7</i>")))
    assert [r.tag for r in H.elements_table(p).where("struck").orderBy("pos").collect()] == ["div", "b", "del"]
    assert one(H.in_unrelated_section(F.lit("price"), F.lit("x"), F.lit("Trending now"))) is True
    assert one(H.in_unrelated_section(F.lit("price"), F.lit("x"), F.lit("Chair"))) is False


def test_cheap_test_lets_every_finding_pass(page):
    htmls = [FLASH, SEAT, COURSE, ADDONS, "<p>Hurry</p>", "<p>limited&nbsp;<b>time</b></p>", "<button>I ha<i>te</i> saving money</button>",
             "<p>don&apos;t miss out</p>", "<p>Only\n 2\tleft</p>", "<p>do not <em>uncheck</em></p>",
             "a < b. Hurry, last chance", "Only <a title='a>b'>3</a> left in stock", "Only <!-- x > y -->3 left", "Only <script>var a=1</script>3 left",
             "Only <svg><title>icon</title></svg> 3 left", "<p>a</p><![foo[bar]]><p>Only 3 left in stock</p>"]
    df = page(*[("https://a.com/cart", h) for h in htmls])
    full = {r.page_id for r in ER.detect_all(H.parse_pages(df)).collect()}
    passed = {r.page_id for r in ER.with_page_text(H.parse_pages(df)).where(ER.may_raise()).select("page_id").collect()}
    assert full and full <= passed
    clean = page(("https://a.com", CLEAN.replace("No thank you", "Back")), ("https://a.com", "<p>oak &amp; pine</p>"))
    assert ER.with_page_text(H.parse_pages(clean)).where(ER.may_raise()).count() == 0


def test_odd_pages_are_read(page):
    odd = ["<p>a</p><![foo[bar]]><p>b</p>", "<![CDATA[x]]>", "<![", "<!foo", "<" * 3000, "<div>" * 20_000 + "x", "</p>" * 5000, None, ""]
    rows = H.parse_pages(page(*[("https://a.com", h) for h in odd])).select("page_id", "parse_error", F.size("nodes").alias("n"), F.size("elements").alias("e")).collect()
    assert len(rows) == len(odd) and all(r.parse_error is None for r in rows)
    got = {r.page_id: (r.n, r.e) for r in rows}
    assert got[0] == (2, 2) and got[5] == (1, 20_000)
