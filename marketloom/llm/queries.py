"""One registered query per operator: whole tables, production parameters, digest columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, decontaminate, jaccard_join, language, neighbours, packing, quality, ranked_search, secret_scan, substrings, token_files, toxicity
from .checks_sql import CONVERSATION_REPAIR, DECONTAMINATION, RANKED_SEARCH
from .common import read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Only where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op11_decontamination": DECONTAMINATION,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_ranked_search": RANKED_SEARCH,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files written in ascending doc_id order and read back."""
    docs = read_table(spark, sf_dir, "documents")
    return token_files.write_and_read(spark, docs, scratch_path(spark, "token-files"), byte_bpe(), end_id=2).drop("ids")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.8 and more between sets of five-word runs, as classes and counts."""
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), every=20, top=20)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause scores of the grammar, fitted on labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic packing into sequences of 2048 ids."""
    return packing.pack(read_table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=1)


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and those of the further rules, found through a trigram index."""
    return secret_scan.told_spans(secret_scan.scan_secrets(read_table(spark, sf_dir, "documents")))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict by adaptive thresholds."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside windows of 50 that also start in a smaller document."""
    return substrings.deduplicate(read_table(spark, sf_dir, "documents"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ids by dynamic programming, and the text decoded from them."""
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), byte_bpe())


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by code length, learned outside the held-out fold."""
    return language.identify(read_table(spark, sf_dir, "documents"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest edits of every conversation after the damage that the crc32 of its rows asks for."""
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, found under bounds from max-sketches."""
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
