"""A corpus made ready for training, stage by stage.

Each stage takes the documents that the stage before has kept and returns
documents with the same columns, whatever these are called; the last returns
token ids. Texts are handled whole, however long; an empty table gives an empty
one. A null or empty text has no letter, so it goes in the first stage; given to
a later one it is like no other text, holds no benchmark window and no secret,
and has no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stackpulse.llm import bpe, decontaminate, language, near_dup, secret_scan
from stackpulse.llm.names import spare
from stackpulse.session import materialise, prepare

# A text whose best language reaches less than this is in none of them.
LEAST_STRENGTH = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in no learned language."""
    prepare(spark)
    return language.filter_known(docs, language.train(docs), LEAST_STRENGTH)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group. Rows are told apart
    by id and text; of rows equal in both the one stays whose other columns come
    first as JSON."""
    prepare(spark)
    text_hash, place, same, row = spare(docs.columns, "text_hash", "kept_hash", "kept_id", "row")
    keep = near_dup.near_duplicates(docs, hashed=True).filter("kept").select(F.col("doc_id").alias(same), F.col("text_hash").alias(place)).distinct()
    marked = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    stay = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(same)) & (F.col(text_hash) == F.col(place)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = F.to_json(F.struct(F.lit(0).alias(row), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    one = stay.groupBy("doc_id", text_hash).agg(F.min_by(F.struct(*columns), others).alias(row))
    return one.select(f"{row}.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_spans(docs, decontaminate.find_contamination(docs, benchmark), coverage=0.0)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts that the ledger names."""
    prepare(spark)
    return secret_scan.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and whether they decode to its text."""
    prepare(spark)
    return bpe.encode_documents(docs, decode=True).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

# Language identification is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
