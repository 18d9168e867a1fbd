"""The registered queries of this subpackage and their SQL."""

from . import alignment, bpe, chat, dedup, jaccard, langid, license_scan, packing, secret_scan, sharding, suffix_tree, trie, webp

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_byte_bpe, langid.op2_language_id, chat.op3_tool_linking, jaccard.op4_jaccard_join, secret_scan.op5_secrets,
        sharding.op6_sharding, packing.op7_packing, webp.op8_webp, dedup.op9_exact_dedup, suffix_tree.op10_suffix_tree,
        trie.op11_prefix_trie, alignment.op12_alignment, license_scan.op13_licenses,
    )
}
SQL = {k: v for m in (alignment, bpe, chat, dedup, jaccard, langid, license_scan, packing, secret_scan, sharding, suffix_tree, trie, webp) for k, v in m.SQL.items()}
