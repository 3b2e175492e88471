"""Tables of the relational store. Keys are kept by overwriting the rows of a document as a whole, so no index is needed."""

from __future__ import annotations

SCHEMAS = {
    "documents": "doc_id string, lang string, bo_number string, date_publication string, edition_label string, num_articles int, created_at timestamp",
    "articles": "id bigint, doc_id string, number string, raw_text string",
    "entities": "id bigint, article_id bigint, text string, label string, start_pos int, end_pos int",
    "citations": "id bigint, article_id bigint, text string, target_label string, target_text string, resolved boolean",
    "entity_index": "id bigint, doc_id string, category string, canonical string, variants array<string>, articles array<string>, merged_from array<string>",
}
