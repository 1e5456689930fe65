"""URL filter, quality classifier, WARC chains, decontamination, Jaccard join and components."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pageaudit.llm import decontaminate, partenum_join, quality_nbsvm, url_filter, warc_chain
from pageaudit.llm.components import components


# URL filter


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules_equal_a_plain_search(shared):
    rng = random.Random(1)
    labels, paths = ["a", "b", "www", "org", "com", "x-y", "é"], ["", "/", "/e", "/en", "/en/", "/en/1", "/é", "/z/../q"]
    rules = {}
    for _ in range(150):
        rules[(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(paths))] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = []
    for k in range(1500):
        host = ".".join(rng.choice([*labels, "ORG", ""]) for _ in range(rng.randint(1, 5)))
        urls.append((k % 1400, rng.choice(["http://", "https://", "", "x://y://"]) + host + rng.choice(paths) + rng.choice(["", "?q=://a", "#f", "/more/of/it"])))
    urls += [(1, None), (2, ""), (None, "http://a.org/en"), (None, "http://a.org/en"), (3, "http://" + "a." * 400 + "org/" + "p" * 100_000)]
    pages = shared.createDataFrame([(*u, "h", "r") for u in urls], "page_id long, url string, host string, rule string")
    got = Counter(tuple(r) for r in url_filter.judge(pages, shared.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == Counter((i, *plain_verdict(u, rules)) for i, u in urls)


def test_url_filter_without_rules_or_pages(shared):
    rules = shared.createDataFrame([(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    pages = shared.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules, default="block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert url_filter.judge(pages.limit(0), rules).count() == 0


# quality


def junk(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    return rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + "***" for w in words)])


def prose(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30)).capitalize() + "."


def test_quality_on_held_out_labels(shared, docs_of):
    rng = random.Random(8)
    rows = [(i, prose(rng) if i % 3 else junk(rng)) for i in range(900)]
    docs = docs_of(*rows, (1, None), (2, ""), (None, "x"), (5, "w " * 50_000))
    labels = shared.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_nbsvm.fit(docs, labels)
    out = quality_nbsvm.score(docs, model).collect()
    assert len(out) == 904 and all(0 <= r["score"] <= 1 for r in out)
    import zlib

    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0} - {1, 2, 5}
    assert len(held) > 100
    assert np.mean([(r["score"] >= quality_nbsvm.THRESHOLD) == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] in held]) > 0.97
    kept = quality_nbsvm.score(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "quality_score"] and kept.count() == 904


def test_fitting_gives_the_driver_s_memory_back(shared, docs_of, monkeypatch):
    given, plain = [], quality_nbsvm.train
    monkeypatch.setattr(quality_nbsvm, "train", lambda *x: given.append("train") or plain(*x))
    monkeypatch.setattr(quality_nbsvm.tb, "release", lambda: given.append("release"))
    labels = shared.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality_nbsvm.fit(docs_of(*[(k, f"w{k} x") for k in range(40)]), labels)
    assert given == ["train", "release"]


def test_quality_without_labels(shared, docs_of):
    none = shared.createDataFrame([], "doc_id long, quality int, toxic int")
    one = shared.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of((1, "a"), (2, "b"), (3, "c"))
    assert {r["score"] for r in quality_nbsvm.score(docs, quality_nbsvm.fit(docs, none)).collect()} == {0.5}
    assert len({r["score"] for r in quality_nbsvm.score(docs, quality_nbsvm.fit(docs, one)).collect()}) == 1
    assert quality_nbsvm.score(docs.limit(0), quality_nbsvm.fit(docs, none)).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    examples = [np.unique(rng.integers(0, 50, 8) + 100 * (k % 2)) for k in range(200)]
    labels = np.arange(200) % 2
    weights, bias = quality_nbsvm.dual_coordinate_descent(examples, np.ones(quality_nbsvm.BUCKETS), labels)
    assert all((weights[x].sum() / np.sqrt(len(x)) + bias > 0) == (y == 1) for x, y in zip(examples, labels))


# WARC


def plain_records(pages):
    groups = defaultdict(list)
    for i, _, h in pages:
        body = (h or "").encode()
        if len(body) >= warc_chain.REVISIT_BYTES and i is not None:
            groups[body].append(i)
    out = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        first = max(groups[body], default=None) if body in groups else None
        again = first is not None and i != first and len([1 for p in pages if (p[2] or "").encode() == body]) > 1
        out[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    return out


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n"


def test_archives_round_trip_and_false_records(shared, tmp_path):
    rng = random.Random(3)
    same, other = "s" * 1500, "é" * 499 + "ab"
    pages = [(i, f"http://h/{i} x\n", rng.choice([same, other, "short", None, "", "x" * rng.randint(0, 5000)])) for i in range(200)]
    pages += [(500, None, FAKE.format(n) + "y" * 300) for n in (0, 10, 40, 10**9, 10**17)] + [(501, "u", "WARC/1.1\r\n" * 500), (7, "u", same), (None, "u", same), (None, "u", "z")]
    pages += [(502, "u", "big " * 60_000)]
    table = shared.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    files = warc_chain.write_archives(table, str(tmp_path.as_uri()) + "/w")
    for step in (1 << 23, 4096, 700):
        rows = warc_chain.read_archives(files, step).select(
            warc_chain.page_id("record_id").alias("i"), "payload_bytes", "payload_digest", "record_type", warc_chain.page_id("refers_to").alias("r"), "intact"
        ).collect()
        assert Counter(tuple(r)[:5] for r in rows) == plain_records(pages)
        assert all(r["intact"] for r in rows if r["record_type"] == "response")


def test_cut_off_archives_and_no_pages(shared, tmp_path):
    page = warc_chain.record("response", [("WARC-Record-ID", "<urn:page:1>")], b"HTTP/1.1 200 OK\r\n\r\nabc")
    (tmp_path / "a.warc").write_bytes(page * 3 + page[:-9])
    (tmp_path / "b.warc").write_bytes(b"not an archive" + page)
    (tmp_path / "c.warc").write_bytes(b"")
    files = shared.createDataFrame([((tmp_path / f"{n}.warc").as_uri(), (tmp_path / f"{n}.warc").stat().st_size, 0) for n in "abc"], "file string, bytes long, records long")
    rows = warc_chain.read_archives(files, 64).collect()
    assert [(r["file"][-6:], r["offset"], bytes(r["payload"])) for r in sorted(rows, key=lambda r: r["offset"])] == [("a.warc", k * len(page), b"abc") for k in range(3)]
    none = shared.createDataFrame([], "page_id long, url string, html string")
    assert warc_chain.read_archives(warc_chain.write_archives(none)).count() == 0


def test_headers_of_any_length_and_the_count_of_records(shared, tmp_path):
    pages = [(i, ("http://h/" + "é y" * 66_667 if i == 3 else f"u{i}"), f"page {i}") for i in range(8)] + [(8, "u8", "x:WARC/1.1\r\n" * 300)]
    table = shared.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    files = warc_chain.write_archives(table, tmp_path.as_uri() + "/w")
    for step in (1 << 23, 70_000, 4096):
        rows = warc_chain.read_archives(files, step).collect()
        assert sorted((warc_id(r["record_id"]), r["url"].replace("%20", " "), bytes(r["payload"]).decode()) for r in rows) == pages
    with pytest.raises(ValueError, match="9 of 10"):
        warc_chain.read_archives(files.selectExpr("file", "bytes", "records + 1 AS records"))


def warc_id(urn):
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


# decontamination


def test_alignment_equals_the_plain_recurrence():
    rng, left, right = random.Random(0), [], []
    for _ in range(200):
        left.append(np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 20))], np.uint64))
        right.append(np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 40))], np.uint64))
    score, matched, start, end = decontaminate.align(left, right)
    for k, (x, y) in enumerate(zip(left, right)):
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert score[k] == table.max()
        assert score[k] == 0 or (0 <= start[k] < end[k] <= len(y) and 2 * matched[k] >= score[k])


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(["zeta", "eta", "theta"]) if x < share else w)
        if x > 1 - share / 3:
            out.append("added")
    return out


def test_copies_are_found_and_clean_documents_left(shared, docs_of):
    rng = random.Random(6)
    vocabulary = ["of", "the", "and", "in"] * 40 + [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(15, 60))) for i in range(40)]
    rows, want = [], set()
    for k in range(400):
        body = text(rng.randint(5, 300))
        if k % 4 == 0:
            i, words = items[k // 4 % 40]
            copy = [words, [w.upper() + "," for w in words], edited(words, rng, 0.15)][k // 4 % 3]
            at = rng.randint(0, len(body))
            body = body[:at] + copy + body[at:]
            want.add((k, i))
        rows.append((k, " ".join(body)))
    for k in range(1000, 1300):  # a passage that many documents hold
        rows.append((k, " ".join(text(20) + items[0][1] + text(20))))
        want.add((k, 0))
    rows += [(2000, None), (2001, ""), (2002, "of the"), (None, " ".join(items[1][1])), (0, rows[0][1])]
    want |= {(None, 1)}
    bench = shared.createDataFrame([(i, " ".join(w), "t") for i, w in items] + [(90, None, "t"), (91, "", "t"), (92, "of the", "t"), (0, " ".join(items[0][1]), "t")], "item_id long, text string, doc_id string")
    found = decontaminate.contaminated(docs_of(*rows), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(found) == len(pairs)
    assert pairs - want == set()
    assert len(want - pairs) <= 1
    left = {r["doc_id"] for r in decontaminate.clean(docs_of(*rows), bench).select("doc_id").collect()}
    assert left == {i for i, _ in rows if i is None or i not in {p[0] for p in pairs}}


def test_edited_copies_of_a_short_item_that_many_documents_hold(shared, docs_of):
    rng = random.Random(8)
    items = [(i, [f"w{i}x{k}" for k in range(15)]) for i in range(3)]
    number = defaultdict(lambda: len(number) + 1)
    rows, want = [], set()
    for k in range(3000):
        i, words = items[k % 3]
        body = words if k < 1500 else [w if rng.random() > 0.25 else f"q{rng.randint(0, 10**6)}" for w in words]
        body = [f"a{k}", *body, f"b{k}"]
        rows.append((k, " ".join(body)))
        score = decontaminate.align([np.array([number[w] for w in words], np.uint64)], [np.array([number[w] for w in body], np.uint64)])[0][0]
        runs = {tuple(words[j : j + 3]) for j in range(13)}
        if score >= decontaminate.LEAST_SHARE * 2 * 15 and any(tuple(body[j : j + 3]) in runs for j in range(len(body))):
            want.add((k, i))
    bench = shared.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(*rows), bench).collect()} == want


def test_decontamination_of_empty_tables(shared, docs_of):
    bench = shared.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = docs_of((1, "x a b c d e f y"))
    assert [(r["doc_id"], r["item_id"], r["from_word"], r["to_word"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1, 1, 7)]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# Jaccard join


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, plain_sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    linked = {i for i, s in sets if s}
    return Counter((i, len(s), None if i is None else root(i) if s else i) for i, s in sets), linked


def near_copies(rng, n):
    """Texts with copies at every similarity, short ones, chains, a shared passage and a large group."""
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows, passage = [], [word() for _ in range(30)]
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 80, 150, 300]))]
        if rng.random() < 0.2:
            base += passage
        rows.append(base)
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            copy = list(base if rng.random() < 0.5 else rows[-1])
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [word()]
            rows.append([w.upper() if rng.random() < 0.1 else w for w in copy])
    group = [word() for _ in range(60)]
    for k in range(60):
        copy = list(group)
        copy[rng.randrange(60)] = word()
        rows.append(copy)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_join_equals_brute_force(docs_of):
    rng = random.Random(11)
    rows = near_copies(rng, 500)
    rng.shuffle(rows)
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, rows[0][1]), (3003, "x"), (3004, "X"), (3005, "w " * 3000), (3006, "w " * 2000), (rows[5][0], rows[9][1])]
    got = Counter(tuple(r) for r in partenum_join.similar_components(docs_of(*rows)).collect())
    want, _ = plain_components(rows)
    assert got == want
    assert max(Counter(c for _, _, c in want.elements()).values()) >= 50


def test_blocks_of_groups_bring_no_loss(docs_of, monkeypatch):
    """With tiny blocks every group is cut into many."""
    monkeypatch.setattr(partenum_join, "BLOCK_MEMBERS", 2)
    rows = near_copies(random.Random(12), 120)
    got = Counter(tuple(r) for r in partenum_join.similar_components(docs_of(*rows)).collect())
    assert got == plain_components(rows)[0]


def test_groups_of_alike_texts_that_hardly_link(docs_of, monkeypatch):
    """Copies of one text, each with its own edits, look alike in pairs by the thousand; few pairs reach the similarity."""
    rng = random.Random(31)
    text = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        mine = list(text)
        for at in rng.sample(range(0, 120, 3), rng.choice([3, 4, 5])):
            mine[at] = f"x{rng.randrange(6)}"
        rows.append((k, " ".join(mine)))
    rows += [(150, ""), (7, rows[7][1]), (9, "")]
    compared, plain = [], partenum_join.exact_links
    monkeypatch.setattr(partenum_join, "exact_links", lambda members, *rest: compared.append(members.count()) or plain(members, *rest))
    monkeypatch.setattr(partenum_join, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(partenum_join, "CANDIDATES", 0)  # whole sets decide
    got = Counter(tuple(r) for r in partenum_join.similar_components(docs_of(*rows)).collect())
    assert got == plain_components(rows)[0]
    assert compared and len({c for _, _, c in got}) > 10


def test_no_table_of_the_join_is_sent_whole_to_the_driver(shared, docs_of):
    store = shared._jsparkSession.sharedState().statusStore()
    plans = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    before = plans()
    assert partenum_join.similar_components(docs_of(*near_copies(random.Random(14), 60))).where("component_id < doc_id").collect()
    shared.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = [p for i, p in plans().items() if i not in before]
    assert sum("SortMergeJoin" in p for p in new) > 5
    assert not any("BroadcastExchange" in p for p in new)


def test_join_of_an_empty_table(docs_of):
    assert partenum_join.similar_components(docs_of((1, "x")).limit(0)).count() == 0


@pytest.mark.parametrize("num,den", [(75, 100), (6, 10), (9, 10)])
def test_similar_sets_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    sets, pairs = [], []
    while len(pairs) < 1500:
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 50, 80, 150, 300]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop, add = int(rng.integers(0, n // 3 + 1)), int(rng.integers(0, n // 2 + 1))
        if (n - drop) > 0 and den * (n - drop) >= num * (n + add):
            sets += [np.sort(a), np.sort(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))]
            pairs.append(len(sets) - 2)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found, row, _, slack = partenum_join.signatures(np.concatenate(sets), first, num, den)
    of = defaultdict(set)
    for s, r in zip(found.tolist(), row.tolist()):
        of[r].add(s)
    assert all(of[k] & of[k + 1] for k in pairs)
    assert (slack >= 0).all()


def test_sketches_never_rule_out_similar_sets():
    rng, ruled_out = np.random.default_rng(4), 0
    for _ in range(2000):
        n, base = int(rng.integers(1, 400)), rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
        a = np.unique(base[:n])
        b = np.unique(np.concatenate([base[: int(n * rng.random())], rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64) * np.uint64(2)]))
        cells, first = partenum_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        common = len(np.intersect1d(a, b))
        may = partenum_join.may_link(cells[: first[1]], cells[first[1] :], len(a), len(b), 75, 100)
        assert may or 100 * common < 75 * (len(a) + len(b) - common)
        ruled_out += not may
    assert ruled_out > 1500


def test_packing_of_signatures():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    low, doc, tag = rng.integers(0, 1 << 40, 50, dtype=np.uint64), rng.integers(-(1 << 62), 1 << 62, 50), rng.integers(0, 1 << 16, 50).astype("<u2")
    side = np.concatenate([doc.astype("<i8").view(np.uint8).reshape(-1, 8), tag.view(np.uint8).reshape(-1, 2)], 1)
    block = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + pa.compress(side.T.tobytes(), "zstd", asbytes=True)
    assert all((a == b).all() for a, b in zip(partenum_join.unpack(50, block), (low, doc, tag)))


def test_components_of_chains_and_stars(shared):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(shared.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} | {6000: 6000, 6001: 6000}
    assert components(shared.createDataFrame([], "a long, b long")).count() == 0


def test_archives_are_read_by_many_tasks(shared):
    pages = shared.range(160).selectExpr("id AS page_id", "concat('http://a.b/', id) AS url", "repeat(cast(id AS string), 4000) AS html")
    files = warc_chain.write_archives(pages.repartition(4))
    total = files.agg({"bytes": "sum"}).first()[0]
    assert warc_chain.tasks_for(files, 1 << 14) == -(-total // (1 << 14)) > 60
    for frame in (warc_chain.candidates(files, 1 << 14), warc_chain.read_archives(files, 1 << 14)):
        parts = frame.rdd.getNumPartitions()
        assert parts == warc_chain.tasks_for(files, 1 << 14)
    assert warc_chain.read_archives(files, 1 << 14).count() == 160


def test_false_magic_costs_no_second_read(tmp_path):
    class Counted:
        def __init__(self, raw):
            self.raw, self.at, self.read_bytes = raw, 0, 0

        def size(self):
            return len(self.raw)

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.raw[self.at : self.at + n]
            self.at, self.read_bytes = self.at + len(out), self.read_bytes + len(out)
            return out

    raw = warc_chain.record("response", [("X", "y")], (warc_chain.MAGIC + b"no field here " * 9) * 4000)
    source = Counted(raw)
    found = [warc_chain.header_at(source, m.start(), raw, 0) for m in re.finditer(re.escape(warc_chain.MAGIC), raw)]
    assert found[0][2] == len(raw) and not any(found[1:]) and source.read_bytes == 0
