"""Centroid clustering against plain Lloyd rounds, and conversation repair against all edits."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pageaudit.llm import chat_grammar, chat_repair, drift_clusters


# clustering


def lloyd(rows, k, rounds, seed=2, scale=256, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [p for _, p in order[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centroids)) for _, p in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [p for (_, p), (_, a) in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = {j: sum(d for d, a in at if a == j) for j in range(len(centroids))}
    return sorted(
        (str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)
    )


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string, lower double")


def clustered(df, **options):
    return sorted((str(r["vec_id"]), *r[1:6]) for r in drift_clusters.cluster_vectors(df, **options).collect())


def test_clusters_equal_plain_rounds(shared):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (9, 6))
    rows = [(int(i), [float(x) for x in middle[i % 9] + rng.normal(0, 0.3, 6)]) for i in range(700)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, [0.0] * 6)]  # repeated ids, null ids
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1.0] * 7)]
    rows += [(910 + i, [0.0] * 6) for i in range(120)]  # many equal vectors
    for k, rounds in ((12, 5), (1, 3), (40, 2)):
        assert clustered(vectors(shared, rows), k=k, rounds=rounds, size=6) == lloyd(rows, k, rounds, size=6)


def test_ties_go_to_the_smaller_number(shared):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(itertools.product(range(-4, 5), repeat=2))] * 2
    assert clustered(vectors(shared, rows), k=8, rounds=5, size=2, scale=1) == lloyd(rows, 8, 5, size=2, scale=1)


def test_few_and_no_vectors(shared):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -4.0])]
    assert clustered(vectors(shared, rows), k=40, size=2) == lloyd(rows, 40, 5, size=2)
    assert clustered(vectors(shared, [(1, None)]), size=2) == []
    assert clustered(vectors(shared, rows).limit(0), size=2) == []
    with pytest.raises(Exception, match="squared distances"):
        clustered(vectors(shared, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), size=2)


def test_bounds_hold_and_are_below_the_full_drift(shared):
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-300, 300, (6, 4))
        new = old + rng.integers(-40, 40, (6, 4))
        radius = rng.uniform(1, 250, 6)
        bound = drift_clusters.approach(old, new, radius)
        path = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(6):
            others = [j for j in range(6) if j != i]
            steps = rng.normal(size=(300, 4))
            inside = old[i] + steps / np.sqrt((steps**2).sum(1))[:, None] * radius[i] * rng.uniform(0, 1, 300)[:, None] ** 0.1
            nearer = max((np.sqrt(((inside - old[j]) ** 2).sum(1)) - np.sqrt(((inside - new[j]) ** 2).sum(1))).max() for j in others)
            assert nearer <= bound[i] + 1e-6 <= path[others].max() + 1e-5
            tighter += bound[i] < 0.9 * path[others].max()
    assert tighter > 200


def test_later_rounds_scan_few_vectors(shared):
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 3, (10, 8))
    rows = [(i, [float(x) for x in middle[i % 10] + rng.normal(0, 0.2, 8)]) for i in range(3000)]
    out = drift_clusters.cluster_vectors(vectors(shared, rows), k=10, size=8)
    assert out.where("scanned").count() < 600


# conversations


def all_edits(symbols):
    """Cost and audit by trying edits state by state with whole audit strings."""
    best = {0: (0, "")}  # states: 0 nothing, 1 after s, 2 after u, 3 after a
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        for _ in range(4):
            for p, (c, t) in list(states.items()):
                for role in "ua":
                    if (p, role) in follow:
                        q = follow[p, role]
                        states[q] = min(states.get(q, (10**9, "")), (c + 3, t + "I"))
        return states

    for role, fault in symbols:
        best, now = inserted(best), {}
        for p, (c, t) in best.items():
            options = [(p, c + 4, t + "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                options += [(follow[p, role], c + extra, t + "K")] if (p, role) in follow else []
                options += [(follow[p, r], c + 3 + extra, t + "R") for r in "ua" if (p, r) in follow]
            for q, cost, text in options:
                now[q] = min(now.get(q, (10**9, "")), (cost, text))
        best = now
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows, every=20):
    """rows: (conv, turn, role, text). The contract, step by step."""
    kept, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % every
        role, text = " " if role is None else role, " " if text is None else text
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        role = "user" if pick == 4 else role
        kept.setdefault(conv, []).extend([(turn, role, text)] * (2 if pick == 3 else 1))
    out = {}
    for conv in ids:
        own = kept.get(conv, [])
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for turn, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = all_edits([(i, f) for i, f in zip(initials, faults)])
        turns = [r[0] for r in own if r[0] is not None]
        result, left, last = [], iter(own), None
        for edit in audit:
            row = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                last = row[1] if edit == "K" else "assistant" if last is not None and last[0] == "u" else "user"
                result.append((last, row[2]))
        text = "\n".join(f"{r}:{t}" for r, t in result)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def chats(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 1, -3])
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            text = rng.choice(["Yes.", "No!", "Why?", "so", "", " \n", "A long answer.  \t", "é…", "Yes. " * 50, "x" + str(rng.random()) + ".", None])
            rows.append((conv if conv else None, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ursa"]), text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d") for r in rows], "conv_id long, turn long, role string, text string, audit string, n int, digest string")


def repaired(df):
    return {r[0]: tuple(r[1:]) for r in chat_repair.summaries(chat_repair.damaged(df)).collect()}


def test_grammar_products_equal_all_edits():
    rng = random.Random(1)
    for n in range(400):
        symbols = [(rng.choice("suaxu"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 14))]
        text = "".join(chat_grammar.terminal(*s) for s in symbols)
        grammar = chat_grammar.Grammar([("Ā", "BC"), ("ā", "ĀĀ"), ("Ă", "ZB"), ("ă", "āā")])
        for g in (chat_grammar.Grammar(), grammar):
            assert chat_grammar.finish(chat_grammar.transfer(text, g, g.matrices())) == all_edits(symbols), symbols


def test_repair_equals_the_plain_one(shared):
    rows = chats(250, 4) + [(900, k, r, f"{r} {k}.") for k, r in enumerate(["system", *["user", "assistant"] * 700])] + [(901, None, "user", "same.")] * 40 + [(902, 7, "user", "same.")] * 30
    rows += rows[:50]
    assert repaired(table(shared, rows)) == plain_repair(rows)


def test_cut_conversations_are_joined(shared, monkeypatch):
    rows = [(conv, k, random.Random(conv * 1000 + k).choice(["user", "assistant", "assistant", "system"]), random.Random(k % 50).choice(["a.", "b", "", "c!", f"{k}."])) for conv in (1, 2) for k in range(400)] + chats(30, 9)
    monkeypatch.setattr(chat_repair.segments, "__defaults__", (7,))
    monkeypatch.setattr(chat_repair.solved, "__defaults__", (3,))
    assert repaired(table(shared, rows)) == plain_repair(rows)


def test_repaired_rows_and_empty_tables(shared):
    rows = chats(60, 12)
    df = table(shared, rows)
    damaged = chat_repair.damaged(df)
    found = {}
    for r in chat_repair.repair(damaged).collect():
        found.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    want = plain_repair(rows)
    for conv, facts in want.items():
        own = sorted(found.get(conv, []))
        assert [k for k, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == facts[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in own))
    assert repaired(df.limit(0)) == {}
    assert chat_repair.repair(chat_repair.damaged(df.limit(0))).count() == 0
