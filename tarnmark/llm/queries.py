"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from tarnmark.llm import centroids, conversation_trie, decontaminate, html_text, language, license_scan, line_dedup, media, near_dup, packing, pii, quality, tokens

QUERIES = {
    "op1_html_text": html_text.page_texts,
    "op2_token_files": tokens.token_ids,
    "op3_media": media.media_documents,
    "op4_personal_data": pii.personal_data_documents,
    "op5_near_duplicates": near_dup.near_duplicate_documents,
    "op6_decontaminate": decontaminate.contaminated_documents,
    "op7_language": language.language_documents,
    "op8_licenses": license_scan.scan_documents,
    "op9_quality": quality.quality_documents,
    "op10_pack": packing.pack_documents,
    "op11_line_dedup": line_dedup.dedup_documents,
    "op12_conversation_trie": conversation_trie.trie_of_conversations,
    "op13_centroids": centroids.cluster_embeddings,
}

ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": near_dup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_licenses": license_scan.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
