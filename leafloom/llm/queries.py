"""The registered queries of this subpackage, and the SQL that says the same."""

from . import byte_bpe, exact_dedup, fingerprint, language_id, line_dedup, packing, prefix_trie, runs, simhash, substring_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_language_id": language_id.op4_language_id,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_topk_search": topk_search.OP11_SQL,
    "op12_periodic_runs": runs.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
