"""Row types of the engine and the sentinels used at its output boundary."""

from __future__ import annotations

PAGES = "doc_id string, page_num int, text string, height double"
PAGE_LINES = "doc_id string, page_num int, block_no int, line_no int, y0 double, spans array<struct<text: string, size: double>>"
PAGE_DRAWINGS = "doc_id string, page_num int, y0 double, y1 double, width double, page_width double, page_height double"
SEGMENTS = "doc_id string, segment_index int, title string, text string"
CHUNKS = (
    "chunk_id string, doc_id string, doc_title string, doc_type string, law_code string, year string, act_name string, segment_index int, "
    "type string, section_number string, section_title string, `order` string, order_title string, rule string, rule_title string, clause string, "
    "term string, chapter string, part string, hierarchy_path string, chunk_index int, parent_chunk_index int, sub_chunk int, total_chunks int, "
    "chunk_source_strategy string, chunk_char_length int, parse_strategy string, fallback_tier int, fallback_confidence string, "
    "hybrid_regex_score double, hybrid_schema_score double, source string, text string, normalized_text_hash string, stored_at timestamp, "
    "pipeline_version string, embedding_model string, extra map<string,string>"
)
EVAL_CASES = "qid string, question string, expected_sections array<string>, expected_keywords array<string>, category string, query_type string, difficulty string, meta_key string, domain string"
RANKED = "qid string, retriever string, rank int, chunk_id string, section_number string, text string, score double"

NOT_AVAILABLE = "N/A"
UNKNOWN_CHAPTER, UNKNOWN_PART, UNKNOWN_ORDER = "Unknown Chapter", "Unknown Part", "Unknown Order"
