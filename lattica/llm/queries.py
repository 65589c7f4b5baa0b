"""Queries of this subpackage and their SQL, for `__spark_entry__`."""

from . import decontaminate, divergence, exact_dedup, jaccard, language_id, lm_scoring, mixing, secrets, sharding, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_lattice_likelihood": lm_scoring.op1_lattice_likelihood,
    "op2_wu_manber": decontaminate.op2_wu_manber,
    "op3_link_propagation": url_filter.op3_link_propagation,
    "op4_marginal_unigrams": language_id.op4_marginal_unigrams,
    "op5_external_shuffle": sharding.op5_external_shuffle,
    "op6_hash_thresholds": mixing.op6_hash_thresholds,
    "op7_interval_tree": suffix_dedup.op7_interval_tree,
    "op8_grace_hash": exact_dedup.op8_grace_hash,
    "op9_token_groups": jaccard.op9_token_groups,
    "op10_blob_ledger": secrets.op10_blob_ledger,
    "op11_radix_tries": divergence.op11_radix_tries,
    "op12_trie_join": simhash.op12_trie_join,
}
ORACLE_SQL = {
    "op2_wu_manber": decontaminate.SQL,
    "op3_link_propagation": url_filter.SQL,
    "op6_hash_thresholds": mixing.SQL,
    "op7_interval_tree": suffix_dedup.SQL,
    "op8_grace_hash": exact_dedup.SQL,
    "op9_token_groups": jaccard.SQL,
    "op10_blob_ledger": secrets.SQL,
    "op11_radix_tries": divergence.SQL,
}
