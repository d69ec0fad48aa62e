"""The queries of the operators: thin readers of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import sql
from wearline.llm.byte_bpe import decode_documents, encode_documents
from wearline.llm.chat import format_conversations, read_back
from wearline.llm.common import table
from wearline.llm.fingerprints import neighbour_fingerprints
from wearline.llm.licenses import scan_licenses
from wearline.llm.merkle import fold, merkle_manifest, siblings
from wearline.llm.mixing import copies, mix_to_targets
from wearline.llm.near_dedup import near_duplicates
from wearline.llm.neighbours import nearest
from wearline.llm.packing import pack_documents
from wearline.llm.quality import score_documents, train
from wearline.llm.sharding import assign_shards
from wearline.llm.spelling import spelling_variants
from wearline.llm.url_filters import Rule, host_of, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where the installed public vocabulary files lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The added conversation, both turns alike.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"
#: The rules of the URL query.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
             Rule("allow", "org", "/fr/")]
#: Shares of tokens that the mixing query aims at.
MIX_TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
#: Words of host labels that put a host on the query's block list.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)],
                                  turns.schema)
    coding = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(format_conversations(turns.unionByName(added), *coding), *coding)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = "|".join(BLOCKED_WORDS)
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    return judge_urls(pages, URL_RULES, hosts.where(F.col("host").rlike(rf"(^|[.-])({words})([.-]|$)")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = neighbour_fingerprints(table(spark, sf_dir, "documents"))
    return compared.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                           "edited_fingerprint", "near_edited", "near_next")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents"))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"),
        listed(F.concat("base.label", "spans.label")).alias("labels"), "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "content_score", "form_score", "quality_score", "accepted")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by domain: toxic, else low quality, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixture = mix_to_targets(docs, domains(spark, sf_dir), MIX_TARGETS, keep=["doc_id"])
    return mixture.rows.select(
        "doc_id", F.col("_tokens").alias("tokens"),
        *(F.get("_p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixture.domains)), F.col("_rate").alias("rate"),
        copies(F.col("_rate"), F.col("doc_id")).alias("copies"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coding = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), *coding), *coding)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                      F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    manifest = merkle_manifest(table(spark, sf_dir, "documents"), altered={"text": tampered})
    folded = manifest.withColumn("folded_root", fold(F.col("altered_leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_chat, op2_fingerprints, op3_url_filter, op4_license_scan, op5_neighbours,
                                    op6_sharding, op7_quality, op8_near_dedup, op9_mixing, op10_packing, op11_byte_bpe,
                                    op12_spelling, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return sql.statements() | {"op3_url_filter": sql.judged_urls(URL_RULES, BLOCKED_WORDS)}
