"""Pages of HTML as columns of element, text and script rows (the per-row part of the structure job).

A page becomes tokens, by a short way where its markup is plain and by the standard tokenizer else; one builder makes
the tree from either.
"""

import re
from html import unescape
from html.parser import HTMLParser
from operator import itemgetter

from pageaudit.fixed import CHROME_TAGS, HIDDEN_TAGS, STRUCK_CLASSES, STRUCK_TAGS
from pageaudit.functions.marks import own_entries

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
# start tag -> (open elements it closes, elements that stop the search)
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    **{t: ({"p"}, {"button", "td", "th", "li", "body", "table"}) for t in BLOCK},
}
HIDDEN, CHROME, STRUCK = set(HIDDEN_TAGS), set(CHROME_TAGS), set(STRUCK_TAGS)
STRUCK_CLASS = re.compile("|".join(map(re.escape, STRUCK_CLASSES)), re.I)

# What the short way reads: tags whose attributes are apart and whose quotes are closed. A page that holds anything else goes
# through the standard tokenizer, which takes all pages and on these says the same.
_NAME, _BLANK = "[a-zA-Z][a-zA-Z0-9_:-]*", r"[ \t\n\r\f]"
_ATTR = rf"{_BLANK}+([a-zA-Z_:@][a-zA-Z0-9_:.@-]*)(?:=(\"[^\"<>]*\"|'[^'<>]*'|[a-zA-Z0-9_.:#%-]+))?"
_START = re.compile(rf"({_NAME})((?:{_ATTR})*){_BLANK}*(/?)")
_ATTRS = re.compile(_ATTR)
_END = re.compile("/([a-zA-Z][a-zA-Z0-9-]*)")
_RAW = {"script", "style"}
_CLOSED = _RAW | {"title"}  # read only up to their own end tag
# versions of the tokenizer differ on the content of these
_UNSURE = {"textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"}
START, END, BREAK, ON = range(4)  # tokens: a start tag, an end tag, a comment, and what does not part a text
KNOWN_TAGS, KNOWN_CHARS = 1 << 14, 512  # tags remembered, the longest of them
_known = {}
ELEMENT = (
    "pos", "parent", "last", "depth", "tag", "id", "cls", "classes", "attrs", "after", "hidden", "chrome", "struck", "t0", "t1", "up", "box", "label",
)
NODE = ("text", "tag", "parent", "hidden", "chrome")
# what a start tag says without its surroundings, and where ``start_tag`` has it
OWN = {"tag": 0, "id": 1, "cls": 2, "classes": 3, "attrs": 4}


def start_tag(tag, attrs, closed=False):
    """What a start tag says on its own."""
    pairs = {}
    for k, v in attrs:
        pairs.setdefault(k, v if v is not None else "")
    classes = pairs.get("class", "").split()
    cls = " ".join(classes)
    return (
        tag, pairs.get("id"), cls, classes, list(pairs.items()), tag in HIDDEN, tag in CHROME, tag in STRUCK or bool(cls and STRUCK_CLASS.search(cls)),
        tag in VOID, CLOSES.get(tag), closed, tag == "input" and pairs.get("type") == "checkbox", pairs.get("for") if tag == "label" else None,
        own_entries(tag, pairs, classes, cls),
    )


class Tokens(HTMLParser):
    """Tokens (kind, value, text behind it) of a page by the standard tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_starttag(self, tag, attrs):
        self.found.append((START, start_tag(tag, attrs), ""))

    def handle_startendtag(self, tag, attrs):
        self.found.append((START, start_tag(tag, attrs, True), ""))

    def handle_endtag(self, tag):
        self.found.append((END, tag, ""))

    def handle_data(self, data):
        self.found.append((ON, None, data))

    def handle_comment(self, data):
        self.found.append((BREAK, None, ""))

    def parse_marked_section(self, i, report=1):
        """A marked section of an unknown kind is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            if end < 0:
                return -1
            self.handle_comment(self.rawdata[i + 3 : end])
            return end + 1


def any_tokens(html):
    """Tokens of any page, and what the tokenizer could not read; the page ends there."""
    p = Tokens()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError) as e:
        return p.found, f"{type(e).__name__}: {e}"
    return p.found, None


def plain_tag(raw):
    """Token of a tag, given without its brackets; None if the short way does not read it."""
    if raw[:1] == "/":
        m = _END.fullmatch(raw)
        return m and (END, m[1].lower())
    if raw[:1] == "!":
        inner = raw[3:-2]
        if raw[:3] == "!--" and len(raw) > 5 and raw[-2:] == "--" and "--" not in inner and inner[:1] not in "->" and inner[-1:] not in "!-":
            return BREAK, None
        return (ON, None) if raw[:8].lower() == "!doctype" and re.fullmatch("[a-zA-Z0-9 ]*", raw[8:]) else None
    m = _START.fullmatch(raw)
    tag = m and m[1].lower()
    if not m or tag in _UNSURE or m[5] and (tag in _RAW or m[4] and m[4][0] not in "'\""):
        return None
    if "&" in raw:  # entities in attributes as the tokenizer reads them
        tokens, error = any_tokens(f"<{raw}>")
        return tokens[0][:2] if len(tokens) == 1 and tokens[0][0] == START and not error else None
    attrs = [(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v else v or None) for k, v in _ATTRS.findall(m[2])]
    return START, start_tag(tag, attrs, bool(m[5]))


def plain_tokens(html):
    """Tokens of a page of plain markup; None if there is more to it."""
    head, *pieces = html.split("<")
    out = [(ON, None, unescape(head) if "&" in head else head)] if head else []
    inside = None  # the element whose content is not markup
    for piece in pieces:
        raw, close, text = piece.partition(">")
        if inside and raw.lower() != "/" + inside:
            if inside == "title" or raw[:1] == "!" or raw[:1] == "/" and not (close and _END.fullmatch(raw)):
                return None
            out.append((ON, None, "<" + piece))
            continue
        token = _known.get(raw) if close else None
        if token is None:
            token = plain_tag(raw) if close else None
            if token is None:
                return None
            if len(raw) <= KNOWN_CHARS:
                if len(_known) >= KNOWN_TAGS:
                    _known.clear()
                _known[raw] = token
        kind, value = token
        inside = value[0] if kind == START and value[0] in _CLOSED else None
        out.append((kind, value, unescape(text) if "&" in text and inside not in _RAW else text))
    return None if inside else out


def script_row(start, texts):
    a = dict(start[4])
    return {"type": a.get("type"), "id": a.get("id"), "src": a.get("src"), "body": "".join(texts)}


class Pages:
    """Columns of the elements, text pieces and scripts of several pages; ``*_ends`` tell where a page's rows end.

    ``parts`` and ``fields`` (of elements) say what will be read: without elements and text pieces, or with elements
    of which only the tag's own fields are read, no tree is built. Columns that are not asked for may stay empty.
    """

    def __init__(self, parts=("elements", "nodes", "scripts"), fields=ELEMENT):
        self.elements = {k: [] for k in ELEMENT}
        self.nodes = {k: [] for k in NODE}
        self.scripts, self.errors = [], []
        self.element_ends, self.node_ends, self.script_ends = [0], [0], [0]
        if not {"elements", "nodes"} & set(parts):
            self.build = self.build_scripts
        elif set(parts) == {"elements"} and set(fields) <= set(OWN):
            self.own = [(self.elements[f].extend, itemgetter(OWN[f])) for f in fields]
            self.build = self.build_own
        else:
            self.build = self.build_all

    def add(self, html):
        """Adds the rows of a page; what the tokenizer cannot read ends the page there and is named in ``errors``."""
        tokens, error = plain_tokens(html or ""), None
        if tokens is None:
            tokens, error = any_tokens(html)
        self.errors.append(error)
        self.build(tokens)

    def build_own(self, tokens):
        """Elements by what their tags say; where they stand in the tree is not asked."""
        starts = [value for kind, value, _ in tokens if kind == START]
        for extend, field in self.own:
            extend(map(field, starts))
        self.element_ends.append(self.element_ends[-1] + len(starts))

    def build_scripts(self, tokens):
        """Scripts alone; markup does not go on inside one, so no tree is needed."""
        script, buffer = None, []
        for kind, value, text in tokens:
            if kind != ON:
                if buffer:
                    self.scripts.append(script_row(script, buffer))
                    buffer = []
                if kind == START:
                    script = value if value[0] == "script" and not value[10] else None
                elif kind == END and value == "script":
                    script = None
            if script and text:
                buffer.append(text)
        if buffer:
            self.scripts.append(script_row(script, buffer))
        self.script_ends.append(len(self.scripts))

    def build_all(self, tokens):
        columns, n_columns, scripts = self.elements, self.nodes, self.scripts
        add = [columns[k].append for k in ELEMENT]
        (add_pos, add_parent, add_last, add_depth, add_tag, add_id, add_cls, add_classes, add_attrs, add_after, add_hidden, add_chrome,
         add_struck, add_t0, add_t1, add_up, add_box, add_label) = add
        n_text, n_tag, n_parent, n_hidden, n_chrome = (n_columns[k].append for k in NODE)
        lasts, ends, boxed, after, named = columns["last"], columns["t1"], columns["box"], columns["after"], columns["label"]
        base, first_node = len(lasts), len(n_columns["text"])
        size = nodes = boxes = 0  # elements, text pieces and checkboxes so far
        opened, n_open = [], {}  # (pos, start tag, hidden, chrome, struck, marks, checkboxes before its content); open elements by tag
        inputs, labels = [], {}  # inputs with an id; the first label of each ``for``
        buffer, leaf = [], None  # text not yet written; the element that it follows

        def flush():
            nonlocal leaf, nodes
            raw = buffer[0] if len(buffer) == 1 else "".join(buffer)
            buffer.clear()
            words = raw.strip()
            if leaf is not None:
                after[base + leaf] = words
                leaf = None
            if opened:
                pos, start, hidden, chrome, _, _, _ = opened[-1]
                tag = start[0]
                if tag in _RAW:
                    if tag == "script":
                        scripts.append(script_row(start, [raw]))
                    return
            else:
                pos, tag, hidden, chrome = -1, "", False, False
            if words:
                nodes += 1
                n_text(words)
                n_tag(tag)
                n_parent(pos)
                n_hidden(hidden)
                n_chrome(chrome)

        def shut(index):
            """Closes the open elements from ``index`` on."""
            nonlocal leaf
            for pos, start, _, _, _, _, before in reversed(opened[index:]):
                at = base + pos
                lasts[at], ends[at], boxed[at] = size - 1, nodes, boxes > before
                tag = start[0]
                if n_open[tag] > 1:
                    n_open[tag] -= 1
                else:
                    del n_open[tag]
                leaf = pos
            del opened[index:]

        def end(tag):
            if tag in n_open:
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i][1][0] == tag:
                        shut(i)
                        return

        for kind, value, text in tokens:
            if kind != ON and buffer:
                flush()
            if kind == START:
                tag, el_id, cls, classes, attrs, hidden, chrome, struck, void, closes, closed, is_box, label_for, entries = value
                if closes and not closes[0].isdisjoint(n_open):
                    for i in range(len(opened) - 1, -1, -1):
                        name = opened[i][1][0]
                        if name in closes[0]:
                            shut(i)
                            break
                        if name in closes[1]:
                            break
                parent, marks, depth = -1, 0, len(opened)
                if opened:
                    parent, _, up_hidden, up_chrome, up_struck, marks, _ = opened[-1]
                    hidden, chrome, struck = hidden or up_hidden, chrome or up_chrome, struck or up_struck
                own = marks
                for bit, need in entries:
                    if not need or marks & need:
                        own |= bit
                add_pos(size)
                add_parent(parent)
                add_last(size)
                add_depth(depth)
                add_tag(tag)
                add_id(el_id)
                add_cls(cls)
                add_classes(classes)
                add_attrs(attrs)
                add_after(None)
                add_hidden(hidden)
                add_chrome(chrome)
                add_struck(struck)
                add_t0(nodes)
                add_t1(nodes)
                add_up(marks)
                add_box(False)
                add_label(None)
                if is_box:
                    boxes += 1
                elif label_for is not None:
                    labels.setdefault(label_for, size)
                if el_id and tag == "input":
                    inputs.append((size, el_id))
                leaf = None
                if void:
                    leaf = size
                    size += 1
                else:
                    opened.append((size, value, hidden, chrome, struck, own, boxes))
                    n_open[tag] = n_open.get(tag, 0) + 1
                    size += 1
                    if closed:
                        end(tag)
            elif kind == END:
                leaf = None
                end(value)
            if text:
                buffer.append(text)
        if buffer:
            flush()
        shut(0)
        if labels:
            for pos, el_id in inputs:
                named[base + pos] = labels.get(el_id)
        self.element_ends.append(base + size)
        self.node_ends.append(first_node + nodes)
        self.script_ends.append(len(scripts))


class PageRows:
    """The rows of one page."""

    def __init__(self, html):
        p = Pages()
        p.add(html)
        self.elements, self.nodes = ([dict(zip(c, row)) for row in zip(*c.values())] for c in (p.elements, p.nodes))
        self.scripts, self.error = p.scripts, p.errors[0]


def page_rows(html):
    """Rows of a page; what the tokenizer cannot read ends the page there and is named in ``error``."""
    return PageRows(html)
