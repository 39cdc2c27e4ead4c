"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidegate.llm import decontaminate, digests, infill, language, licenses, neardup, packing, pii, preferences, quality, tokencounts, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_template_decontamination": decontaminate.op3_template_decontamination,
    "op4_language_id": language.op4_language_id,
    "op5_bucket_digest": digests.op5_bucket_digest,
    "op6_weak_pii": pii.op6_weak_pii,
    "op7_order_minhash": neardup.op7_order_minhash,
    "op8_preference_format": preferences.op8_preference_format,
    "op9_vector_packing": packing.op9_vector_packing,
    "op10_line_crf": quality.op10_line_crf,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_token_counts": tokencounts.op13_token_counts,
}

ORACLES = {"op1_warc": warc.ORACLE, "op2_license_scan": licenses.oracle(), "op8_preference_format": preferences.ORACLE, "op11_conversation_trie": trie.ORACLE, "op12_fill_in_middle": infill.ORACLE}
