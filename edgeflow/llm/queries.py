"""The ``opN_`` queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.llm import chat, ctw, language, mixing, packing, runs, search, sharding, simhash, suffix, tokencount, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(table(spark, sf_dir, "documents"), least=400, keep="none")
    gone = (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed")
    spans = F.size("spans").cast("long").alias("n_spans")
    # A span may end inside a character; what is left of it shows as U+FFFD in the text, not in the digest.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return rows.select("doc_id", "n_bytes", gone, spans, F.sha2("kept", 256).alias("kept_sha256"), text)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return rows.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "filled")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_links(table(spark, sf_dir, "embeddings"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "copy", "text")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.find_runs(table(spark, sf_dir, "documents"), changed=runs.repeated_tail)
    digests = (runs.runs_sha256("runs").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(table(spark, sf_dir, "documents"), n_shards=40)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    return rows.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    import corpus_pipeline

    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": chat.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op11_ranked_search": search.ORACLE_SQL, "op13_sharding": sharding.ORACLE_SQL}
