"""The registered queries of the operators: thin digests of what the operators return."""

import public_tokenizers
from pyspark.sql import functions as F

from pageaudit.llm import byte_bpe, chat_repair, decontaminate, drift_clusters, partenum_join, pii_boost, quality_nbsvm, rule_ledger, secret_scan, suffix_dedup, token_pack, url_filter, warc_chain
from pageaudit.llm.piece_encoder import word_encoder

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def span_text(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


# Fixed values of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op1_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages"), rules)


ORACLE["op1_url_filter"] = """
WITH rules(rhost, rpath, v) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hit AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
        FROM u, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hit USING (k)
""".format(rules=", ".join(map(str, URL_RULES)))


@query
def op3_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality_nbsvm.fit(docs, table(spark, folder, "labels"))
    return quality_nbsvm.score(docs, model).select(
        "doc_id", (quality_nbsvm.remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality_nbsvm.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op4_token_files(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())
    manifest = token_pack.write_tokens(table(spark, folder, "documents"), lambda: word_encoder(definition.value), 49_408, 2)
    return token_pack.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_rule_ledger(spark, folder):
    book = rule_ledger.ledger(table(spark, folder, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.passes(("base", 1))).alias("base_failed"), rule_ledger.passes(("full", 1)).alias("kept"), "failed_bits",
    )


ORACLE["op5_rule_ledger"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT k, i, list_aggregate(words[i:i + 4], 'string_agg', chr(32)) AS g FROM (SELECT k, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY k),
ln AS (SELECT k, line FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
      FROM d JOIN w USING (k) LEFT JOIN cov USING (k) LEFT JOIN dup USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
       + (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END) AS failed_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits FROM b
"""


@query
def op6_warc(spark, folder):
    files = warc_chain.write_archives(table(spark, folder, "pages"))
    return warc_chain.read_archives(files).select(
        warc_chain.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc_chain.page_id(F.col("refers_to")).alias("refers_to"),
    )


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM q LEFT JOIN g USING (payload_digest)
"""


@query
def op7_byte_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path, text=False).select(
        "doc_id", F.floor(F.octet_length("packed") / 4).alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


@query
def op8_secrets(spark, folder):
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return secret_scan.find_secrets(table(spark, folder, "documents")).select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"),
    )


@query
def op9_personal(spark, folder):
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["strict"])
    return pii_boost.find_personal(table(spark, folder, "documents")).select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in pii_boost.KINDS],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"),
    )


@query
def op2_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_jaccard_join(spark, folder):
    return partenum_join.similar_components(table(spark, folder, "documents"))


ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT k, doc_id, list_aggregate(w[i:i + 4], 'string_agg', chr(32)) AS s
      FROM (SELECT k, doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
i AS (SELECT a.k AS ka, b.k AS kb, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
l AS (SELECT DISTINCT a, b FROM i JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE coalesce(m.c, d.doc_id) END AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN m ON m.doc_id = d.doc_id
"""


@query
def op11_drift_clusters(spark, folder):
    return drift_clusters.cluster_vectors(table(spark, folder, "embeddings")).drop("scanned")


def _cluster_sql(k=40, size=64, rounds=5):
    """Assignment and update written out once for each round; sums of products of whole numbers below 2^53 are exact in doubles."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS (SELECT v.r, arg_min(j, (n - 2 * list_inner_product(p, c) + cn, j)) AS j, CAST(min(n - 2 * list_inner_product(p, c) + cn) AS BIGINT) AS d
       FROM v, c{t} GROUP BY v.r)""")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT a.j, i, floor(sum(CAST(v.p[i] AS HUGEINT)) // count(*) - CASE WHEN sum(CAST(v.p[i] AS HUGEINT)) % count(*) < 0 THEN 1 ELSE 0 END) AS m
       FROM a{t} a JOIN v USING (r), (SELECT unnest(generate_series(1, {size})) AS i) GROUP BY a.j, i) GROUP BY j)""")
            steps.append(f"c{t + 1} AS (SELECT j, c, list_inner_product(c, c) AS cn FROM (SELECT c{t}.j, CAST(coalesce(s{t}.c, c{t}.c) AS DOUBLE[]) AS c FROM c{t} LEFT JOIN s{t} USING (j)))")
    body = ",\n".join(steps)
    return f"""
WITH v AS (SELECT r, vec_id, p, list_inner_product(p, p) AS n FROM (SELECT row_number() OVER () AS r, vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS p
     FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, p AS c, n AS cn FROM (SELECT sha256('2:' || vec_id) AS h, p, n FROM v ORDER BY h LIMIT {k})),
{body},
f AS (SELECT j, sum(d) AS ci FROM a{rounds} GROUP BY j)
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(f.ci AS BIGINT) AS cluster_inertia, CAST((SELECT sum(ci) FROM f) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c{rounds}.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN f USING (j) JOIN c{rounds} USING (j)
"""


ORACLE["op11_drift_clusters"] = _cluster_sql()


@query
def op12_chat_repair(spark, folder):
    return chat_repair.summaries(chat_repair.damaged(table(spark, folder, "conversations")))


@query
def op13_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))
