"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level vocabulary on this box; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.pfor import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end=2)


def op2_containment_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.linechunks import remove_repeated_chunks

    return remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.linechunks import remove_repeated_passages

    return remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.chat import format_conversations, with_probe

    return format_conversations(with_probe(table(spark, sf_dir, "conversations")))


def op8_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.subspace import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.parity import Join, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Join(words=4, p=85, q=100))


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.hashtree import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op11_block_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from larkspur.llm import oracles

    return dict(oracles.SQL)
