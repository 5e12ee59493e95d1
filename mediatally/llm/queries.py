"""The registered queries of this package, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from mediatally.llm import bpe, decontaminate, exactdedup, pii, prefixtrie, recompression, secrets, simhash, spelling, suffixdedup, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_warc": warc.op2_warc,
    "op3_bpe_codec": bpe.op3_bpe_codec,
    "op4_simhash_bktree": simhash.op4_simhash_bktree,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_exact_dedup": exactdedup.op9_exact_dedup,
    "op10_personal_data": pii.op10_personal_data,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_substring_dedup": recompression.op13_substring_dedup,
}

SQL = {
    "op2_warc": warc.SQL,
    "op5_url_filter": urlfilter.SQL,
    "op9_exact_dedup": exactdedup.SQL,
}
