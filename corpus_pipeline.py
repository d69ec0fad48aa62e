"""From raw documents to packed sequences: quality, near-duplicates, mixture, packing.

Every stage takes the documents its predecessor kept and returns documents with the same columns, the last one pieces of
sequences. Between stages documents are written to the shared folder and read back, so a lost executor costs at most
part of one stage.

Rows without an id are never duplicates of others; rows of one id are one document, of which the least text stays.
Mixing repeats documents (its rates are between 1 and 4). Only documents of `LOWERED` domains, in proportion to their
posterior, may be taken less than once, where the corpus has more of them than wanted; targets missed are logged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm import queries as llm
from wearline.llm.common import stored, table
from wearline.llm.mixing import copies, mix_to_targets
from wearline.llm.near_dedup import near_duplicates
from wearline.llm.packing import pack_documents
from wearline.llm.quality import score_documents, train

#: Shares of tokens after mixing, and all tokens as a multiple of those that came in.
TARGETS, TOTAL = {"clean": 0.9, "toxic": 0.1}, 1.25
LEAST_RATE, MOST_RATE = 1.0, 4.0
LOWERED = ("toxic",)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    # Rows of one id: the least text stays. Rows without an id stay all, each in a group of its own text.
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    first = Window.partitionBy("doc_id", lone).orderBy("text")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1 or doc_id is null").drop("_nth")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that tokens of clean and toxic documents approach their targets."""
    mixture = mix_to_targets(docs, llm.domains(spark, sf_dir), TARGETS, total=TOTAL, least=LEAST_RATE, most=MOST_RATE,
                             lowered=LOWERED)
    times = copies(F.col("_rate"), F.col("doc_id"))
    # An empty array for no copies: such a document goes. (A sequence from 1 to 0 would count down, and double it.)
    repeated = mixture.rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    return repeated.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; `ids` are their token ids as little-endian unsigned 32-bit bytes."""
    return pack_documents(docs, llm.tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Fitted models and the tokenizer have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
