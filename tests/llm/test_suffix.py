"""Repeated strings: induced sorting against plain sorting, removal against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from pageaudit.llm import induced_sort, suffix_dedup


def plain_suffixes(strings):
    suffixes, at = [], 0
    for n, s in enumerate(strings):
        suffixes += [(s[j:] + [0], n, at + j) for j in range(len(s))]
        at += len(s) + 1
    return sorted(suffixes)[::-1]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
        n += 1
    return n


def test_suffixes_and_common_prefixes_equal_a_plain_sort():
    rng = random.Random(2)
    for _ in range(250):
        strings = [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))]
        strings += [list(x) for x in strings[: rng.choice([0, 3])]]
        symbols = np.concatenate([np.array([*s, 0], np.uint16) for s in strings])
        want = plain_suffixes(strings)
        for options in ({}, {"limit": 5, "base": 2}, {"limit": 40, "base": 8}):  # in memory; run files and recursion
            store = induced_sort.Store()
            got = list(induced_sort.suffixes(symbols, store=store, **options))
            assert np.concatenate([p for p, _ in got]).tolist() == [w[2] for w in want]
            assert np.concatenate([c for _, c in got]).tolist() == [0] + [common(a[0], b[0]) for a, b in zip(want, want[1:])]
            assert options.get("limit") != 5 or len(symbols) < 60 or store.written


def test_runs_lie_in_files_and_go_with_the_store(tmp_path):
    from pageaudit.llm.token_pack import open_folder

    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(1, 5, 20_000), 0).astype(np.uint16)
    store = induced_sort.Store(*open_folder(f"file:{tmp_path}/runs"))
    hit = induced_sort.repeated(symbols, 6, store=store, limit=500, base=300)
    assert len(store.files) > 20 and store.written > 20 * 16 * 500 // 2
    n = Counter(symbols[k : k + 6].tobytes() for k in range(19_995))
    assert [bool(x) for x in hit[:19_995]] == [n[symbols[k : k + 6].tobytes()] > 1 for k in range(19_995)]
    store.close()
    assert not list((tmp_path / "runs").iterdir())


def plain(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    passage, short = words(rng, 60), words(rng, 30)[:199]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k]) for k in range(8)] * 2  # exact copies, repeated rows
    for k in range(40):  # near copies: one character changed, cut, or moved
        t = rng.choice(base)
        at = rng.randint(0, len(t))
        rows.append((200 + k, rng.choice([t[:at] + "X" + t[at + 1 :], t[at:], t[:at], words(rng, 9) + t, t + t])))
    rows += [(300 + k, words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 40))) for k in range(25)]
    rows += [(400 + k, f"{k} " + short + f" {k}") for k in range(6)]  # one byte too short
    rows += [(500, None), (501, ""), (None, passage[:250]), (None, None), (502, "a" * 199), (503, "a" * 200), (504, "b" * 200), (505, "b" * 201), (506, "xyz" * 90), (507, "c" * 3000 + "d" * 700)]
    rows += [(508, words(rng, 8000)), (509, "".join(rng.choice("ab") for _ in range(900)) * 2), (510, "\0\1" * 300), (511, words(rng, 40) + "\0" * 210 + words(rng, 50))]
    return rows


def removed(docs, **options):
    return sorted((str(r["doc_id"]), *r[1:5]) for r in suffix_dedup.remove_repeats(docs, **options).collect())


def test_removal_equals_a_dictionary_of_all_strings(docs_of):
    rows = corpus(7)
    assert removed(docs_of(*rows)) == plain(rows)


def test_small_shards_run_files_and_crowded_anchors(docs_of):
    rows = corpus(8)
    docs = docs_of(*rows).repartition(5)
    assert removed(docs, shard=3000, limit=200, base=100) == plain(rows)
    assert removed(docs, hot=3) == plain(rows)


def test_kept_bytes_and_empty_tables(docs_of):
    rows = [(1, "a b c " * 50), (2, "other " + "a b c " * 50 + "end"), (3, "alone")]
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs_of(*rows), keep=True).collect()}
    assert kept == {1: b"", 2: b"otherend", 3: b"alone"}  # the blank before the passage belongs to its period
    assert removed(docs_of((1, None))) == plain([(1, None)])
    assert removed(docs_of(*rows).limit(0)) == []
