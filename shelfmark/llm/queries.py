"""The queries of this subpackage, each over its whole tables, and SQL for those that it can express."""

from __future__ import annotations

from . import decontaminate, language, lines, neardup, packing, passages, repair, rules, sstable, substrings, topk, trie, warc
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    "op1_curve_packing": lambda spark, d: packing.op1_curve_packing(table(spark, d, "documents"), vocabulary()),
    "op2_line_windows": lambda spark, d: lines.op2_line_windows(table(spark, d, "documents")),
    "op3_segment_topk": lambda spark, d: topk.op3_segment_topk(table(spark, d, "embeddings")),
    "op4_lsh_forest": lambda spark, d: neardup.op4_lsh_forest(table(spark, d, "documents")),
    "op5_crf_language": lambda spark, d: language.op5_crf_language(table(spark, d, "documents")),
    "op6_sstable": lambda spark, d: sstable.op6_sstable(table(spark, d, "documents"), vocabulary()),
    "op7_bucket_refinement": lambda spark, d: substrings.op7_bucket_refinement(table(spark, d, "documents")),
    "op8_compact_windows": lambda spark, d: passages.op8_compact_windows(table(spark, d, "documents")),
    "op9_warc_index": lambda spark, d: warc.op9_warc_index(table(spark, d, "pages")),
    "op10_bm25_wand": lambda spark, d: decontaminate.op10_bm25_wand(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_structure_repair": lambda spark, d: repair.op11_structure_repair(table(spark, d, "conversations")),
    "op12_prefix_trie": lambda spark, d: trie.op12_prefix_trie(table(spark, d, "conversations")),
    "op13_rule_ledger": lambda spark, d: rules.op13_rule_ledger(table(spark, d, "documents")),
    "op13_ablations": lambda spark, d: rules.op13_ablations(table(spark, d, "documents")),
}
SQL: dict[str, str] = {"op2_line_windows": lines.OP2_SQL, "op3_segment_topk": topk.OP3_SQL, "op9_warc_index": warc.OP9_SQL, "op11_structure_repair": repair.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_rule_ledger": rules.OP13_SQL, "op13_ablations": rules.ABLATIONS_SQL}
