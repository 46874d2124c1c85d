"""The operators of this folder as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    language,
    merkle,
    minhash,
    quality,
    shards,
    simhash,
    sql,
    toxicity,
    transcripts,
    url_filter,
)
from kerbline.llm.common import fold
from kerbline.session import scratch_path

#: The vocabulary of the byte-level BPE query; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fold of crc32(conv_id) that the transcript model does not learn from.
CHAT_FOLDS, CHAT_HELD_OUT = 5, 0


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns recovered from every message, without use of its stated role; learned from other conversations."""
    chats = table(spark, sf_dir, "conversations")
    held_out = fold(F.col("conv_id"), CHAT_FOLDS) == CHAT_HELD_OUT
    model = transcripts.fit(chats.where(~held_out))
    turns = transcripts.format_chats(chats, model)
    return turns.select("conv_id", "turn", "part", held_out.alias("held_out"), "role", "rendered")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.add_score(docs, model, keep=["doc_id"])
    held_out = fold(F.col("doc_id"), toxicity.HELD_OUT_FOLDS) == toxicity.HELD_OUT_FOLD
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", toxicity.is_toxic(F.col("score")).cast("int").alias("predicted")
    )


#: Rules of the URL filter query.
URL_RULES = [
    url_filter.Rule.parse(text, verdict)
    for text, verdict in [
        ("com/", "allow"),
        ("example.com/en/", "block"),
        ("www.example.com/en/", "allow"),
        ("net/es/", "block"),
        ("net/fr/", "block"),
    ]
]


def pages_by_document(pages: DataFrame) -> DataFrame:
    """``doc_id, host`` of the pages that show a document: its id is the last number in the path."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    return pages.select(
        number.try_cast("bigint").alias("doc_id"), url_filter.host_of(F.col("url")).alias("host")
    ).where("doc_id is not null")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, bad`` of each page whose document is labelled: 1 if it is toxic or of low quality."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    labelled = labels.select("doc_id", bad.alias("bad")).where("bad is not null")
    return pages_by_document(pages).join(labelled, "doc_id").select("host", "bad")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds a benchmark passage, and the items with their edit distances."""
    marked = decontaminate.mark_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return marked.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.col("leaks.item_id").alias("item_ids"),
        F.col("leaks.distance").alias("distances"),
    )


#: Key of the training order, and the layout of its shards.
ORDER_KEY = "training-order-1"
SHARD_LAYOUT = shards.Layout()


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every sequence of byte ids of the documents stands, read back from the shards that were written."""
    path = scratch_path(spark, "training-shards")
    shards.write_shards(shards.byte_ids(table(spark, sf_dir, "documents")), path, ORDER_KEY, SHARD_LAYOUT)
    rows = shards.read_shards(spark, path, SHARD_LAYOUT)
    return rows.select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


#: Fold of crc32(doc_id) that language identification does not learn from.
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    predicted = language.add_language(docs, language.fit(docs.where(~held_out)), keep=["doc_id"])
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = pages_by_document(table(spark, sf_dir, "pages"))
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hosts)


def digests(round_trip: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, and the length and digests of the columns ``ids`` and ``decoded``."""
    return round_trip.select(
        *keep,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.ByteBpe.load(VOCABULARY, public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents")
    return digests(bpe.encode(docs, tokenizer, keep=["doc_id"], decoded_col="decoded"), ["doc_id"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every so many documents, by crc32 of the id, are tampered with before their proofs are checked.
TAMPERED = 3


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, checked against the root with its text as it is or tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    leaf = merkle.leaf_hash(*fields, F.col("text"))
    given = F.when(fold(F.col("doc_id"), TAMPERED) == 0, merkle.leaf_hash(*fields, lowered))
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), given.alias("tampered"))
    proven = merkle.prove(merkle.build(leaves))
    folded = merkle.fold_proof(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("places"))
    rows = proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Links of the near-duplicate query: three words, a similarity of 85 in 100; texts without words are linked with nothing.
NEAR = minhash.Settings(words=3, similarity=(85, 100), bands=40, link_empty=False)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_chat_formatting,
        op2_simhash_near_dedup,
        op3_toxicity,
        op4_url_filter,
        op5_benchmark_decontamination,
        op6_training_order,
        op7_exact_dedup,
        op8_language_id,
        op9_quality,
        op10_byte_bpe,
        op11_filter_audit,
        op12_merkle_manifest,
        op13_minhash_near_dedup,
    )
}

#: SQL for the queries that it can express.
ORACLES: dict[str, str] = {
    "op4_url_filter": sql.url_verdicts(URL_RULES),
    "op7_exact_dedup": sql.EXACT_DEDUP,
    "op11_filter_audit": sql.filter_audit(),
    "op12_merkle_manifest": sql.merkle_manifest(merkle.ARITY),
    "op13_minhash_near_dedup": sql.near_duplicates(NEAR.words, NEAR.similarity),
}
