"""Registers the queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import byte_bpe, compact_windows, conversation_trie, decontamination, embedding, exact_dedup, mixing, pii, simhash, suffix_dedup, token_counts, toxicity, vector_codes
from wayfare.session import ensure_utc, ship_package


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(ensure_utc(ship_package(spark)), folder)

    run.__name__ = query.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: _ready(query)
    for query in (
        exact_dedup.op1_exact_dedup,
        toxicity.op2_toxicity,
        simhash.op3_simhash,
        mixing.op4_mixing,
        byte_bpe.op5_byte_bpe,
        compact_windows.op6_compact_windows,
        token_counts.op7_token_counts,
        pii.op8_pii,
        suffix_dedup.op9_suffix_dedup,
        embedding.op10_embedding,
        vector_codes.op11_vector_codes,
        conversation_trie.op12_conversation_trie,
        decontamination.op13_decontamination,
    )
}

#: Queries that SQL can express. The others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op10_embedding": embedding.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_decontamination": decontamination.SQL,
}
