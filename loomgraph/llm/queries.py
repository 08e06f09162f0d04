"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, bpe, exact_dedup, langid, lm, mixing, prefix_trie, repeats, simhash, telephony, topk, url_filter, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_topk": topk.op6_topk,
    "op7_repeats": repeats.op7_repeats,
    "op8_langid": langid.op8_langid,
    "op9_lm": lm.op9_lm,
    "op10_warc": warc.op10_warc,
    "op11_media": telephony.op11_media,
    "op12_alignment": align.op12_alignment,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_topk": topk.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
}
