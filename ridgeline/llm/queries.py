"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bit_packing, bpe_codec, conversation_repair, golay_simhash, hamerly, histogram_sort, line_dedup, m_tree, oracles, quality_rules, secret_scan, source_mix, token_counts, url_filter
from ridgeline.llm.common import table, text_batches


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The production mix: domains are made of sources by number, and weighted like the languages.
DOMAINS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 1}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (6, 10), 2, 17
#: Fixed by the query's contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def domain_of(source: Column) -> Column:
    """d0 to d3, by the number that ends a source's name; other sources are d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(number != "", number.cast("int") % 4), F.lit(0)).cast("string"))


def weighted(name: str, weights: dict[str, int], other: int = 1) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out


def mixed(docs: DataFrame) -> DataFrame:
    weights = {"domain": weighted("__domain", DOMAINS), "lang": weighted("__lang", LANGUAGES), "source": F.lit(1)}
    return source_mix.mix(docs, domain_of(F.col("source")), weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", "longest_repeat", F.md5("text").alias("text_md5"))


def op2_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bit_packing.write_packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return bit_packing.read_packed(spark, folder)


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.hex_column("fp").alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_counts.count_column(F.col("text"), tokenizer_path("word_bpe_49k.json")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_tree.top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch", source_mix.tokens(F.col("text")).alias("n_tokens"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("found", secret_scan.digest_column(F.col("text"))).select("doc_id", "found.*")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("trip", bpe_codec.round_trip_column(F.col("text"), tokenizer_path("byte_bpe_50k.json"))).select("doc_id", "trip.*")


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed=1)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_bit_packing": op2_bit_packing,
        "op3_histogram_sort": op3_histogram_sort,
        "op4_golay_simhash": op4_golay_simhash,
        "op5_token_counts": op5_token_counts,
        "op6_quality_rules": op6_quality_rules,
        "op7_m_tree": op7_m_tree,
        "op8_source_mix": op8_source_mix,
        "op9_secret_scan": op9_secret_scan,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_hamerly": op11_hamerly,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": oracles.OP1,
        "op7_m_tree": oracles.OP7,
        "op8_source_mix": oracles.op8(DOMAINS, LANGUAGES, MIX_SHARE, MIX_EPOCHS, MIX_SEED),
        "op11_hamerly": oracles.op11(16, 3, 64, 64, 1),
        "op12_conversation_repair": oracles.OP12,
        "op13_url_filter": oracles.op13(URL_RULES),
    }
