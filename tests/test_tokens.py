"""The short way through plain markup and the standard tokenizer give the same rows."""

import random

import pytest

from pageaudit.functions import htmlrows as R

NAMES = ["div", "p", "li", "ul", "table", "tr", "td", "br", "label", "input", "script", "style", "title", "textarea", "a", "meta", "header", "SCRIPT", "Div", "s", "iframe"]
ATTRS = [
    "", ' class="x y"', " class='price old-price'", ' type="checkbox" checked', " id=c1", ' for="c1"', ' href="a/b?x=1&amp;y=2"', " href=a/b", " href=a/", ' x="a>b"', " a=b/",
    ' CLASS="product-single"', ' b ="c"', ' class="a"class="b"', " =x", "/", " /", ' class="a" class="b"', ' t="ü &copy y"', '\n id="q"\t', " b ='c",
]
TEXTS = [
    "t", "a &amp; b", "&copyx", "a<b", "1 < 2", " ", "<", "<>", "</>", "&", "₹ 99", "</ p>", "<!-- c -->", "<!---->", "<!-->", "<!-- a > b -->", "<!-- <p> -->", "<!--a--b-->",
    "<!DOCTYPE html>", "<![CDATA[x]]>", "<![if x]>", "<?php x?>", 'var a="</";', "if(a<b){}", "</script >", "</SCRIPT>", '{"a":"<p>"}', "<!--", "</p", '<p class="',
]


def rows(tokens, error=None):
    p = R.Pages()
    p.build(tokens)
    return p.elements, p.nodes, p.scripts, error


def test_short_way_equals_the_standard_tokenizer():
    rng, short = random.Random(8), 0
    for k in range(4000):
        html = ""
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.45:
                html += "<" + rng.choice(NAMES) + rng.choice(ATTRS) * (rng.random() < 0.5) + rng.choice(ATTRS) * (rng.random() < 0.2) + ">"
            elif kind < 0.7:
                html += "</" + rng.choice(NAMES) + ">"
            else:
                html += rng.choice(TEXTS[:8] if k % 2 else TEXTS)
        tokens = R.plain_tokens(html)
        if tokens is not None:
            short += 1
            found, error = R.any_tokens(html)
            assert error is None and rows(tokens) == rows(found), html
    assert short > 500


@pytest.mark.parametrize("html", [
    '<!DOCTYPE html><p class="a b" hidden>x &amp; y<br/><!-- c --><script type="x">if (a < b) {}</script><title>t</title>',
    "plain text &copy", "", '<a href="x?a=1&amp;b=2">y</a>',
])
def test_plain_markup_takes_the_short_way(html):
    assert rows(R.plain_tokens(html)) == rows(*R.any_tokens(html))


@pytest.mark.parametrize("html", ['<a title="x>y">z</a>', "1 < 2", "<p", "<a href=x/>", "<textarea><b></textarea>", "<title>a<b></title>", "<script>x", "<![if x]>", "<a b ='c>d'>"])
def test_other_markup_takes_the_standard_tokenizer(html):
    assert R.plain_tokens(html) is None


def test_pages_of_one_slice_keep_their_rows():
    htmls = ["<p>a<b>b</b>", "", "<script>1</script><input id=i><label for=i>x</label>", "a<b", "<label for='i'>y</label><input type=checkbox id=i>"]
    p = R.Pages()
    for h in htmls:
        p.add(h)
    for k, h in enumerate(htmls):
        one = R.page_rows(h)
        a, b = p.element_ends[k : k + 2]
        assert [dict(zip(p.elements, row)) for row in zip(*(c[a:b] for c in p.elements.values()))] == one.elements
        a, b = p.node_ends[k : k + 2]
        assert [dict(zip(p.nodes, row)) for row in zip(*(c[a:b] for c in p.nodes.values()))] == one.nodes
        a, b = p.script_ends[k : k + 2]
        assert p.scripts[a:b] == one.scripts


def test_tags_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(R, "KNOWN_TAGS", 10)
    for k in range(100):
        R.plain_tokens(f'<p id="x{k}">')
    assert len(R._known) <= 10


def test_queries_ask_for_the_parts_they_read(spark, monkeypatch):
    from pageaudit.operators import structure as H
    from pageaudit.registry import QUERIES

    asked, parse = [], H.parse_pages
    monkeypatch.setattr(H, "parse_pages", lambda pages, parts=tuple(H.STRUCTURE): asked.append(tuple(parts)) or parse(pages, parts))
    for name in ("h5_struck", "x1_json_walk", "p5_jsonld", "r5_preticked"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [("elements",), ("state",), ("scripts",), H.RULE_PARTS]
    with pytest.raises(ValueError, match="no such parts"):
        parse(spark.createDataFrame([("x",)], "html string"), ("elementz",))


LEAN_PAGES = [
    "", None, "<script></script><script> </script>", "<script>a<!-- b --></script>c<SCRIPT id='x' src=y>1 < 2</script >d", "<script/>t<script type=a>un",
    "<p>a<p id=1 class='x  y'>b<br/><input type=checkbox checked>&amp;", "<div><script>x</script><b>y</div>z</b>", "<![foo <a href='q'>r</a>", "<textarea><script>v</script></textarea>",
    "<title>a<script>b</script></title><style>p{}</style><a href=/ href=/2>h</a>", "<li>1<li>2<script>3", "<svg><script>4</script></svg>", "<!--c--><script>5</script><!--", "&#x110000;<script>&lt;</script>",
]


def test_scripts_and_tags_without_a_tree_are_those_of_the_tree():
    whole, scripts, tags = R.Pages(), R.Pages(("state",)), R.Pages(("elements",), tuple(R.OWN))
    for p in (whole, scripts, tags):
        for h in LEAN_PAGES:
            p.add(h)
    assert scripts.scripts == whole.scripts and len(whole.scripts) > 8 and scripts.script_ends == whole.script_ends
    assert all(tags.elements[f] == whole.elements[f] for f in R.OWN) and tags.element_ends == whole.element_ends
    assert whole.errors == scripts.errors == tags.errors
    assert not scripts.elements["pos"] and not tags.elements["pos"] and not tags.nodes["text"]


def test_queries_look_for_the_shop_system_only_where_they_read_it(spark, monkeypatch):
    from pageaudit.registry import QUERIES, page_queries

    asked, real = [], page_queries.platform
    monkeypatch.setattr(page_queries, "platform", lambda *c: asked.append(1) or real(*c))
    for name in ("x1_json_walk", "h7_redact", "r5_preticked", "p13_raw_components", "m1_attribute_map", "p5_jsonld", "n4_labels_by_for", "h6_links_shop", "r_all_rules", "h4_checkbox_labels"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not asked
    QUERIES["e9_reached"](spark, "/root/testdata/sf0.001")
    assert asked


def test_elements_leave_the_parser_with_the_fields_asked_for(spark):
    from pageaudit.operators import structure as H

    page = spark.createDataFrame([(1, h) for h in LEAN_PAGES], "page_id long, html string")
    for parts in (H.Parts(("elements",), ("attrs", "tag")), H.RULE_PARTS, H.Parts(("elements",), ("t1", "cls"))):
        lean = H.parse_pages(page, parts)
        assert lean.schema["elements"].dataType.elementType.names == list(parts.fields)
        whole = H.elements_table(H.parse_pages(page)).select("page_id", *parts.fields)
        assert sorted(map(str, H.elements_table(lean).collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(ValueError, match="no such fields"):
        H.Parts(("elements",), ("tags",))
