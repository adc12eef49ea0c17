"""The registered queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from seine.llm import alignment, bpe, decontaminate, kdtree, licenses, pseudonyms, quality, runindex, secrets, sharding, simhash, toxicity, trie

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_byte_bpe": bpe.query,
    "op3_sharding": sharding.query,
    "op4_run_index": runindex.query,
    "op5_simhash": simhash.query,
    "op6_pseudonyms": pseudonyms.query,
    "op7_license_scan": licenses.query,
    "op8_decontaminate": decontaminate.query,
    "op9_secret_scan": secrets.query,
    "op10_kdtree_topk": kdtree.query,
    "op11_quality_rules": quality.query,
    "op12_alignment": alignment.query,
    "op13_prefix_trie": trie.query,
}
ORACLES = {
    "op3_sharding": sharding.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_secret_scan": secrets.ORACLE_SQL,
    "op10_kdtree_topk": kdtree.ORACLE_SQL,
    "op13_prefix_trie": trie.ORACLE_SQL,
}
