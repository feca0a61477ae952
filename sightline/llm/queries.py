"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import cotrain, dedup, filteraudit, graph, jaccard, langid, linededup, maxent, mixing, pieces, prefixtrie, sharding, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_vector_graph": graph.op2_vector_graph,
    "op3_language_id": langid.op3_language_id,
    "op4_exact_dedup": dedup.op4_exact_dedup,
    "op5_warc": warc.op5_warc,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_maxent_lm": maxent.op7_maxent_lm,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_hash_tree": sharding.op9_hash_tree,
    "op10_co_training": cotrain.op10_co_training,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_filter_audit": filteraudit.op12_filter_audit,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}
ORACLES = {"op1_mix_sources": mixing.SQL, "op4_exact_dedup": dedup.SQL, "op5_warc": warc.SQL, "op6_ngram_jaccard": jaccard.SQL, "op9_hash_tree": sharding.SQL, "op11_line_dedup": linededup.SQL, "op12_filter_audit": filteraudit.SQL, "op13_prefix_trie": prefixtrie.SQL}
