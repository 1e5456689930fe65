"""Entries of one JSON document in document order."""

import json
import re

from pageaudit.fixed import HYDRATION_NEGATIVE, RX_WINDOW_STATE


def json_rows(value, blocked, max_depth=None, max_items=None):
    """Yields (depth, path, key, kind, value) of every object entry, parents before children.

    VARIANT sorts the keys of an object, and what settles ties between prices
    is their order in the document; so this is a small generator. Entries whose
    key holds one of ``blocked`` are not entered. Depth and list items are not
    limited unless asked for.
    """
    stack = [(value, 0, "$")]
    while stack:
        node, depth, path = stack.pop()
        if isinstance(node, tuple):
            yield (depth, path, *node)
            continue
        if max_depth is not None and depth > max_depth:
            continue
        todo = []
        if isinstance(node, dict):
            for k, v in node.items():
                here = f"{path}.{k}"
                nested = isinstance(v, (dict, list))
                if nested or v is None:
                    entry = (str(k), "nested", None)
                elif isinstance(v, str):
                    entry = (str(k), "string", v)
                else:
                    entry = (str(k), "number", str(int(v) if isinstance(v, bool) else v))
                todo.append((entry, depth, here))
                low = str(k).lower().replace("_", "")
                if nested and not any(b in low for b in blocked):
                    todo.append((v, depth + 1, here))
        elif isinstance(node, list):
            todo = [(v, depth + 1, f"{path}[{i}]") for i, v in enumerate(node[:max_items]) if isinstance(v, (dict, list))]
        stack.extend(reversed(todo))


def state_rows(scripts):
    """Entries of the framework state a page embeds: page data, product JSON, window state, in this order."""
    blocked = [k for k, _ in HYDRATION_NEGATIVE]
    blobs = [[], [], []]
    for s in scripts:
        body, sid = s["body"], s["id"] or ""
        if sid == "__NEXT_DATA__" and not blobs[0]:
            blobs[0].append(("next_data", body))
        if re.search("ProductJson|product-json", sid, re.I):
            blobs[1].append(("shopify_embedded", body))
        if not s["src"] and "window.__" in body:
            m = re.search(RX_WINDOW_STATE, body)
            if m:
                blobs[2].append(("window_hydration_state", m.group(1)))
    out = []
    for n, (source, text) in enumerate(b for group in blobs for b in group):
        try:
            value = json.loads(text)
            for depth, path, key, kind, v in json_rows(value, blocked):
                out.append({"source": source, "blob": n, "ord": len(out), "depth": depth, "path": path, "key": key, "kind": kind, "value": v})
        except (ValueError, RecursionError):
            continue
    return out
