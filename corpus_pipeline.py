"""From raw documents to packed training sequences, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.decontaminate import mark_contaminated
from folio.llm.lang_id import UNDETERMINED, fit, held_out, predict
from folio.llm.near_dedup import near_duplicates
from folio.llm.packing import pack
from folio.llm.pii import replace_entities
from folio.llm.queries import pii_key, tokenizer
from folio.llm.store import cut, read, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determinable language: null texts and texts without a letter."""
    named = predict(docs, fit(docs, ~held_out()))
    return named.where(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near-duplicates (five-word shingles, similarity 0.8).

    Documents without shingles stay. Rows that repeat an id, or have none, are documents by their text: repeated rows stay once, different
    texts of one id are told apart and stay each, unless they are near-duplicates.
    """
    again = cut(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id", F.lit(True).alias("_again")))
    if again.isEmpty():
        return docs.join(near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    marked = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left").select(*(docs[c] for c in docs.columns), "_again")
    one, more = marked.where("_again IS NULL").drop("_again"), marked.where("_again").drop("_again")
    first = Window.partitionBy("_id").orderBy(*(F.col(c) for c in docs.columns if c != "text"))
    more = more.withColumn("_id", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    named = one.withColumn("_id", F.col("doc_id").cast("long")).unionByName(more)
    kept = near_duplicates(named, id_col="_id", shingle=5, percent=80).where("kept").select("_id")
    return named.join(kept, "_id", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts hold none."""
    marked = mark_contaminated(docs, read(spark, sf_dir, "benchmark"), fine=60)
    return marked.where(F.size("matches") == 0).select(*docs.columns)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data and secrets; n_chars follows the text, but a null stays null. Null texts stay null."""
    done = replace_entities(docs, pii_key(spark))
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"]))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens. A null text is packed as an empty one."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", replace_private_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
