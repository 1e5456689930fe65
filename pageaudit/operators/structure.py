"""Page structure: HTML is tokenised once, everything else is expressions on the result.

``parse_pages`` keeps a page in one row: its elements, text nodes and scripts
are arrays. Element rules are then narrow expressions over these arrays and
need no shuffle; the size of a row is bounded by the size of its document.
Columns that a query does not use are dropped before the arrays leave the
projection above the parser.
"""

from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageaudit import fixed as X
from pageaudit.functions.htmlrows import ELEMENT, Pages
from pageaudit.functions.jsonrows import state_rows
from pageaudit.functions.marks import bit_of
from pageaudit.functions.text import contains_any, host_of, lines, resolve

STRUCTURE = {
    "elements": "array<struct<pos:int,parent:int,last:int,depth:int,tag:string,id:string,cls:string,classes:array<string>,"
                "attrs:map<string,string>,after:string,hidden:boolean,chrome:boolean,struck:boolean,t0:int,t1:int,"
                "up:bigint,box:boolean,label:int>>",
    "nodes": "array<struct<text:string,tag:string,parent:int,hidden:boolean,chrome:boolean>>",
    "scripts": "array<struct<type:string,id:string,src:string,body:string>>",
    "state": "array<struct<source:string,blob:int,ord:int,depth:int,path:string,key:string,kind:string,value:string>>",
}
_ELEMENT = pa.struct([
    ("pos", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("id", pa.string()), ("cls", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("after", pa.string()),
    ("hidden", pa.bool_()), ("chrome", pa.bool_()), ("struck", pa.bool_()), ("t0", pa.int32()), ("t1", pa.int32()),
    ("up", pa.int64()), ("box", pa.bool_()), ("label", pa.int32()),
])
_NODE = pa.struct([
    ("text", pa.string()), ("tag", pa.string()), ("parent", pa.int32()), ("hidden", pa.bool_()), ("chrome", pa.bool_()),
])
_SCRIPT = pa.struct([("type", pa.string()), ("id", pa.string()), ("src", pa.string()), ("body", pa.string())])
_STATE = pa.struct([
    ("source", pa.string()), ("blob", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("path", pa.string()),
    ("key", pa.string()), ("kind", pa.string()), ("value", pa.string()),
])
SLICE_ROWS = 64


def _strings(lists) -> pa.Array:
    """Lists of strings, written column by column."""
    ends = pa.array(accumulate(map(len, lists), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array([x for row in lists for x in row], pa.string()))


def _pairs(lists) -> pa.Array:
    ends = pa.array(accumulate(map(len, lists), initial=0), pa.int32())
    flat = [x for row in lists for x in row]
    return pa.MapArray.from_arrays(ends, pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))


def _columns(kind, columns, ends) -> pa.Array:
    """One list per page of the rows that ``columns`` hold; much cheaper than rows as dictionaries."""
    special = {"classes": _strings, "attrs": _pairs}
    made = [special[f.name](columns[f.name]) if f.name in special else pa.array(columns[f.name], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kind)))


def _elements(rows: Pages, fields) -> pa.Array:
    return _columns([f for f in _ELEMENT if f.name in fields], rows.elements, rows.element_ends)


def _nodes(rows: Pages, _) -> pa.Array:
    return _columns(_NODE, rows.nodes, rows.node_ends)


def _scripts(rows: Pages, _) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.script_ends, pa.int32()), pa.array(rows.scripts, _SCRIPT))


def _state(rows: Pages, _) -> pa.Array:
    return pa.array([state_rows(rows.scripts[a:b]) for a, b in pairwise(rows.script_ends)], pa.list_(_STATE))


class Parts(tuple):
    """Names of the parts of a page that a job reads, and of the fields of its elements (all unless named)."""

    def __new__(cls, names, fields=ELEMENT):
        wrong = set(fields) - set(ELEMENT)
        if wrong:
            raise ValueError(f"no such fields of an element: {sorted(wrong)}")
        self = super().__new__(cls, names)
        self.fields = tuple(f for f in ELEMENT if f in fields)
        return self


#: What the element and text rules read.
RULE_PARTS = Parts(("elements", "nodes"), ("pos", "parent", "last", "tag", "id", "cls", "attrs", "after", "hidden", "t0", "t1", "label"))
#: What boxes and selectors with their texts read besides.
PRICE_PARTS = Parts(RULE_PARTS)


def parse_pages(pages: DataFrame, parts=tuple(STRUCTURE)) -> DataFrame:
    """Replaces ``html`` by ``parse_error`` (null for a page read whole) and the arrays named in ``parts``.

    Output of a Python stage cannot be pruned by the optimizer, so a job that
    needs fewer arrays, or elements with fewer fields (``Parts``), says so; the rules need ``RULE_PARTS``.
    """
    unknown = set(parts) - set(STRUCTURE)
    if unknown:
        raise ValueError(f"no such parts of a page: {sorted(unknown)}")
    keep = [f for f in pages.schema.fields if f.name != "html"]
    fields = parts.fields if isinstance(parts, Parts) else ELEMENT
    schema = T.StructType(keep + T.StructType.fromDDL("parse_error string, " + ", ".join(f"{k} {STRUCTURE[k]}" for k in parts)).fields)
    if "elements" in parts:
        of = schema["elements"].dataType
        of.elementType = T.StructType([f for f in of.elementType if f.name in fields])
    names = [f.name for f in keep]
    build = {"elements": _elements, "nodes": _nodes, "scripts": _scripts, "state": _state}

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):  # bounds the memory of the output batch
                part = batch.slice(start, SLICE_ROWS)
                rows = Pages(parts, fields)
                for h in part.column("html").to_pylist():
                    rows.add(h)
                made = [pa.array(rows.errors, pa.string())] + [build[p](rows, fields) for p in parts]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names=names + ["parse_error"] + list(parts))

    return pages.mapInArrow(run, schema)


# --- expressions on a parsed page ---------------------------------------------

ELEMENTS, NODES = "elements", "nodes"


def visible(e: Column) -> Column:
    return ~e["hidden"]


def element_text(e: Column, sep: str = " ", with_hidden: bool = False) -> Column:
    """Text of an element's subtree, its pieces joined by ``sep``."""
    inside = F.slice(NODES, e["t0"] + 1, F.greatest(e["t1"] - e["t0"], F.lit(0)))
    if not with_hidden:
        inside = F.filter(inside, lambda n: ~n["hidden"])
    return F.array_join(F.transform(inside, lambda n: n["text"]), sep)


def page_text(sep: str = " ") -> Column:
    return F.array_join(F.transform(F.filter(NODES, lambda n: ~n["hidden"]), lambda n: n["text"]), sep)


def snapshot_text() -> Column:
    """Visible text of a snapshot, taken from its HTML where none was stored."""
    return F.coalesce(F.when(F.col("visible_text") != "", F.col("visible_text")), page_text())


def has_class(e: Column, name: str) -> Column:
    return F.array_contains(e["classes"], name)


def class_has(e: Column, part: str) -> Column:
    return e["cls"].contains(part)


def attr(e: Column, name: str) -> Column:
    return F.element_at(e["attrs"], name)


def inside(e: Column, *steps) -> Column:
    """Some proper ancestor of ``e`` passes the steps (see ``functions.marks``); the parse has handed that down."""
    return e["up"].bitwiseAND(F.lit(bit_of(steps)).cast("bigint")) != 0


def having(test):
    """``test`` as a total predicate: unknown counts as no."""
    return lambda e: F.coalesce(test(e), F.lit(False))


def first_where(test) -> Column:
    """First element in document order that passes ``test``."""
    return F.get(F.filter(ELEMENTS, having(test)), F.lit(0))


def is_checkbox(e: Column) -> Column:
    return (e["tag"] == "input") & (attr(e, "type") == "checkbox")


def is_checked(e: Column) -> Column:
    return F.map_contains_key(e["attrs"], "checked")


def label_text(e: Column, with_sibling: bool = True) -> Column:
    """Label of a checkbox: by ``for``, else its parent label, else what follows it."""
    by_for = F.get(ELEMENTS, e["label"])
    up = F.when(e["parent"] >= 0, F.get(ELEMENTS, e["parent"]))
    around = F.when(up["tag"] == "label", element_text(up))
    labelled = F.when(e["label"].isNotNull(), element_text(by_for))
    if not with_sibling:
        return F.coalesce(F.when(labelled != "", labelled), around, F.lit(""))
    nxt = F.get(ELEMENTS, e["last"] + 1)
    beside = F.when(nxt["parent"] == e["parent"], element_text(nxt))
    return F.coalesce(labelled, around, e["after"], beside, F.lit(""))


def in_unrelated_section(cls: Column, el_id: Column, parent_text: Column) -> Column:
    text = F.lower(F.concat_ws(" ", cls, el_id, parent_text))
    return contains_any(text, X.UNRELATED_TERMS)


# --- table forms ---------------------------------------------------------------

def elements_table(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    return parsed.select("page_id", F.inline("elements"))


def text_lines(parsed: DataFrame) -> DataFrame:
    """Non-empty visible lines of a page in order."""
    return parsed.select("page_id", F.posexplode(lines(page_text("\n"))).alias("line_no", "line"))


def links(parsed: DataFrame) -> DataFrame:
    """Absolute link targets with a same-host flag; ``parsed`` carries url."""
    anchors = F.filter(ELEMENTS, lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], "href"))
    rows = parsed.select("page_id", "url", F.posexplode(F.transform(anchors, lambda e: attr(e, "href"))).alias("seq", "href"))
    out = rows.withColumn("dst_url", resolve(F.col("url"), F.col("href")))
    same = F.coalesce(host_of(F.col("dst_url")) == host_of(F.col("url")), F.lit(False))
    return out.select("page_id", F.col("url").alias("src_url"), "seq", "href", "dst_url", same.alias("same_host"))


def checkbox_labels(parsed: DataFrame) -> DataFrame:
    """Every checkbox with its label text and state."""
    boxes = F.transform(
        F.filter(ELEMENTS, is_checkbox),
        lambda e: F.struct(e["pos"].alias("pos"), is_checked(e).alias("checked"), label_text(e).alias("label")),
    )
    return parsed.select("page_id", F.inline(boxes))


def labels_by_for(parsed: DataFrame) -> DataFrame:
    """Every input that a label names by ``for``, with the text of the first such label."""
    named = F.transform(
        F.filter(ELEMENTS, lambda e: e["label"].isNotNull()), lambda e: F.struct(e["id"].alias("id"), element_text(F.get(ELEMENTS, e["label"])).alias("label"))
    )
    return parsed.select("page_id", F.inline(named))


def sensitive(e: Column) -> Column:
    empty = F.lit("")
    return (e["tag"] == "input") & (
        (F.lower(F.coalesce(attr(e, "type"), empty)) == "password")
        | F.coalesce(attr(e, "name"), empty).rlike(X.SENSITIVE_NAME)
        | F.coalesce(attr(e, "autocomplete"), empty).rlike(X.SENSITIVE_AUTOCOMPLETE)
    )


def redact(parsed: DataFrame) -> DataFrame:
    """Elements without the values of sensitive inputs."""
    secret = r"(?i)value|data-val|auth"
    clean = F.transform(ELEMENTS, lambda e: e.withField(
        "attrs", F.map_filter(e["attrs"], lambda k, _: ~(sensitive(e) & k.rlike(secret))),
    ))
    return parsed.withColumn("elements", clean)


CONTAINERS = [
    ("div[itemtype*=schema.org/Product]", lambda e: (e["tag"] == "div") & attr(e, "itemtype").contains("schema.org/Product")),
    (".product-single", lambda e: has_class(e, "product-single")),
    (".product-details", lambda e: has_class(e, "product-details")),
    ("#product-details", lambda e: e["id"] == "product-details"),
    (".pdp-details", lambda e: has_class(e, "pdp-details")),
    (".product-info-main", lambda e: has_class(e, "product-info-main")),
    ("#centerCol", lambda e: e["id"] == "centerCol"),
    ("div._2c7YLP", lambda e: (e["tag"] == "div") & has_class(e, "_2c7YLP")),
    (".pdp-price-info", lambda e: has_class(e, "pdp-price-info")),
]


def identity(parsed: DataFrame) -> DataFrame:
    """Product title and primary container of a page."""
    meta = lambda key, name: first_where(lambda e: (e["tag"] == "meta") & (attr(e, key) == name))
    content = F.coalesce(attr(meta("property", "og:title"), "content"), attr(meta("name", "twitter:title"), "content"))
    social = F.trim(F.regexp_replace(F.trim(content), X.RX_SITE_SUFFIX, ""))
    h1 = element_text(first_where(lambda e: e["tag"] == "h1"), "")
    container = None
    for name, test in CONTAINERS:
        hit = F.exists(ELEMENTS, having(test))
        container = F.when(hit, name) if container is None else container.when(hit, name)
    title = F.coalesce(F.when(social != "", social), F.when(F.length(h1) > 3, h1), F.lit("Target Product"))
    return parsed.select("page_id", title.alias("title"), container.alias("container"))


def page_profile(parsed: DataFrame) -> DataFrame:
    """Element, form, input and link counts per page."""
    count = lambda tags: F.size(F.filter(ELEMENTS, lambda e: e["tag"].isin(tags)))
    return parsed.select(
        "page_id", F.size("elements").alias("n_elements"), count(["form"]).alias("n_forms"),
        count(["input", "select", "textarea"]).alias("n_inputs"), count(["button"]).alias("n_buttons"),
        count(["a"]).alias("n_links"), count(["li"]).alias("n_items"), count(["p"]).alias("n_paragraphs"),
        F.size("scripts").alias("n_scripts"),
    )
