"""The corpus pipeline and each of its stages against plain readings of small tables."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from pageaudit.llm import byte_bpe, quality_nbsvm, secret_scan

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SECRET = "password = abcdefgh12345678"


def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(f.read())) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def prose(rng, n=40):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n))


def small_rows():
    rng = random.Random(12)
    item = prose(rng, 20)
    rows = [(i, prose(rng)) for i in range(30)]
    rows += [(30, rows[1][1]), (31, rows[1][1] + " more"), (32, f"{prose(rng)} {item} {prose(rng)}"), (33, f"{prose(rng)} {SECRET} end"), (34, "\u00e9\U0001f600 \u4e2d\u6587 " + prose(rng))]
    rows += [(35, None), (36, ""), (None, prose(rng)), (None, None), (2, rows[2][1]), (37, f"{SECRET} \u00e9"), (37, prose(rng))]
    return rows, item


@pytest.fixture()
def folder(shared, docs_of, tmp_path):
    rows, item = small_rows()
    docs_of(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    shared.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_encoding_decodes_and_says_whether_the_text_comes_back(shared, docs_of, folder):
    rows, _ = small_rows()
    docs, other = docs_of(*rows), tiktoken_encoding()
    want = Counter((i, tuple(other.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in rows)
    out = corpus_pipeline.encoding(shared, docs, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"]
    found = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"], r["round_trip"]) for r in found) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    assert corpus_pipeline.encoding(shared, docs.limit(0), folder).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert Counter((r["doc_id"], hashlib.sha256(r["data"]).hexdigest()) for r in back.collect()) == Counter((w[0], w[2]) for w in want.elements())


def test_a_column_of_the_score_s_name_is_kept(shared, docs_of, folder):
    docs = docs_of(*small_rows()[0]).selectExpr("*", "'own' AS quality_score")
    out = corpus_pipeline.quality(shared, docs, folder)
    assert out.columns == docs.columns and {r["quality_score"] for r in out.collect()} <= {"own"}
    assert quality_nbsvm.score(docs, quality_nbsvm.fit(docs, shared.read.parquet(f"{folder}/labels.parquet")), keep=True).columns.count("quality_score") == 1


def test_stages_and_the_whole_equal_plain_readings(shared, docs_of, folder):
    rows, item = small_rows()
    docs = docs_of(*rows)
    model = quality_nbsvm.fit(docs, shared.read.parquet(f"{folder}/labels.parquet"))
    scored = quality_nbsvm.score(docs, model, keep=True).collect()
    good = Counter((r["doc_id"], r["text"]) for r in scored if r["quality_score"] >= quality_nbsvm.THRESHOLD)
    assert rows_of(corpus_pipeline.quality(shared, docs, folder)) == good

    single = rows_of(corpus_pipeline.near_duplicates(shared, docs, folder))
    copies = {30, 31}
    assert {i for i, _ in single} == {i for i, _ in rows} - copies
    assert all(n == 1 for (i, _), n in single.items() if i is not None) and single[(None, None)] == 1
    assert Counter(i for i, _ in single.elements())[37] == 1

    assert rows_of(corpus_pipeline.decontamination(shared, docs, folder)) == Counter((i, t) for i, t in rows if not t or item not in t)
    masked = Counter((i, t and secret_scan.cover(t, secret_scan.scan(t), "<SECRET>")) for i, t in rows)
    found = corpus_pipeline.secrets(shared, docs, folder).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == masked
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)

    # the stages in turn, as plain steps over the rows that the classifier keeps
    kept = list(good.elements())
    other, first = tiktoken_encoding(), {t: min(i for i, u in kept if u == t and i is not None) for i, t in kept if i is not None}
    near = {t + " more": t for _, t in kept if t}
    want = set()
    for i, t in kept:
        if i is not None and t and (first[t] != i or t in near and near[t] in first or item in t):
            continue
        if t and item in t:
            continue
        text = secret_scan.cover(t, secret_scan.scan(t), "<SECRET>") if t else ""
        want.add((i, tuple(other.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest(), True))
    out = corpus_pipeline.run(shared, folder).collect()
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"], r["round_trip"]) for r in out)
    assert all(w in got for w in want if w[0] != 37) and set(got) <= want
    assert all(n == 1 for (i, *_), n in got.items() if i is not None)


def test_pipeline_of_no_documents(shared, docs_of, folder, tmp_path):
    docs_of((1, "x")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("benchmark", "labels"):
        shared.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(shared, str(tmp_path / "none")).count() == 0
