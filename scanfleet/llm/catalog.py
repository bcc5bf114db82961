"""Queries of this subpackage, by name, with DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanfleet.llm import automata, columnwise, fingerprints, langid, lm, manifest, minhash, mixing, packing, quality, sharding, simhash, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mix": mixing.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_language_id": langid.op3,
    "op4_quality_ratio": quality.op4,
    "op5_backoff_automaton": lm.op5,
    "op6_hypergeometric_shards": sharding.op6,
    "op7_threshold_sketch": fingerprints.op7,
    "op8_suffix_automata": automata.op8,
    "op9_simhash_components": simhash.op9,
    "op10_columnwise_suffix_order": columnwise.op10,
    "op11_minhash_components": minhash.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_prefix_trie": trie.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hierarchical_mix": mixing.oracle(),
    "op11_minhash_components": minhash.oracle(),
    "op12_merkle_manifest": manifest.oracle(),
    "op13_prefix_trie": trie.oracle(),
}
