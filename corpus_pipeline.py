"""From raw documents to token ids: five stages over whole tables, each written and read by the next.

The quality classifier drops what it rejects, the Jaccard join keeps one document of each group, decontamination drops
copies of test items, the secret scan masks what it finds, and byte-level BPE gives the ids and reads them back.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageaudit.llm import byte_bpe, decontaminate, partenum_join, quality_nbsvm, secret_scan
from pageaudit.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold. The model is fitted on labelled documents among those of the stage."""
    model = quality_nbsvm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "quality_score"
    while name in docs.columns:  # a column of the documents stays what it is
        name += "_"
    return quality_nbsvm.score(docs, model, keep=True, name=name).where(F.col(name) >= quality_nbsvm.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows that share that id one stays. Rows without an id stay."""
    found = written(partenum_join.similar_components(docs), "components").where("doc_id IS NOT NULL")
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    dropped = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    left = docs.join(dropped, "doc_id", "left_anti")
    one = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are masked in the text, n_chars follows."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, the SHA-256 of the decoded bytes, and whether they are those of the text (a null text is empty)."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", encoding),
]
#: The stages learn, align and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that the first three stages keep. Null and empty texts have no tokens; rows without an id stay apart from each
    other; repeated rows give one; an empty table gives an empty result; columns with clashing names stay what they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
