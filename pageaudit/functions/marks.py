"""Marks that the parse hands down from element to child: which selector steps some ancestor passes, in order.

A step is a tag (None: any) and marks: a class; -class (absent); ~part (class contains); #id; @attribute,
@attribute=value or @attribute*part. Every proper beginning of a selector in the tables of ``fixed`` has a bit. So
"passes the last step below ancestors that pass the others" is one test of the element and one of a bit,
however many elements a page has.
"""

from pageaudit import fixed as X

#: Tags whose descendants are asked for by name.
TAGS = ("label", "header")


def _selectors():
    for _, _, _, _, alternatives in X.SELECTORS:
        yield from alternatives
    yield from X.SALE_SELECTORS
    yield from X.SUMMARY_SELECTORS
    for _, shapes, total, action in X.CART.values():
        for _, alternatives in shapes:
            yield from alternatives
        yield from total + action
    for _, _, shape, _, total, _ in X.CHECKOUT.values():
        yield from shape + total


_BITS: dict[tuple, int] = {((tag,),): 1 << k for k, tag in enumerate(TAGS)}
for _steps in _selectors():
    for _n in range(1, len(_steps)):
        _BITS.setdefault(tuple(map(tuple, _steps[:_n])), 1 << len(_BITS))
if len(_BITS) > 63:
    raise ValueError("more beginnings of selectors than a long has bits")


def bit_of(steps) -> int:
    """The mark of elements below ancestors that pass ``steps``."""
    return _BITS[tuple(map(tuple, steps))]


def _passes(mark, pairs, classes, cls) -> bool:
    kind, rest = mark[:1], mark[1:]
    if kind == "-":
        return rest not in classes
    if kind == "~":
        return rest in cls
    if kind == "#":
        return pairs.get("id") == rest
    if kind == "@":
        if "=" in rest:
            name, value = rest.split("=")
            return pairs.get(name) == value
        if "*" in rest:
            name, part = rest.split("*")
            return part in pairs.get(name, "")
        return rest in pairs
    return mark in classes


# the beginnings by what their last step surely needs: a class, an id or a tag
_BY_CLASS: dict[str, list] = {}
_BY_ID: dict[str, list] = {}
_BY_TAG: dict[str, list] = {}
_OTHERS: list = []
for _steps, _bit in _BITS.items():
    _tag, *_marks = _steps[-1]
    _marks = [m for m in _marks if m]
    _entry = (_bit, _BITS[_steps[:-1]] if len(_steps) > 1 else 0, _tag, _marks)
    _class = next((m for m in _marks if m[0] not in "-~#@"), None)
    _id = next((m[1:] for m in _marks if m[0] == "#"), None)
    if _class:
        _BY_CLASS.setdefault(_class, []).append(_entry)
    elif _id:
        _BY_ID.setdefault(_id, []).append(_entry)
    elif _tag:
        _BY_TAG.setdefault(_tag, []).append(_entry)
    else:
        _OTHERS.append(_entry)


def own_entries(tag: str, pairs: dict, classes: list, cls: str) -> tuple:
    """The beginnings whose last step an element passes: (bit, mark that an ancestor must have, 0 for none)."""
    return tuple(
        (bit, need)
        for entries in (_BY_TAG.get(tag, ()), _BY_ID.get(pairs.get("id"), ()), _OTHERS, *[_BY_CLASS[c] for c in classes if c in _BY_CLASS])
        for bit, need, want, marks in entries
        if (not want or want == tag) and all(_passes(m, pairs, classes, cls) for m in marks)
    )
