"""Schemas of the catalog's tables; keys are what upserts go by."""

from __future__ import annotations

CANONICAL_FILES = "content_sha256 string, canonical_path string, display_name string, original_filename string, page_count int, file_size_bytes long, ingested_at timestamp"
SOURCE_SIGHTINGS = "content_sha256 string, source_path string, machine_id string, first_seen timestamp, last_seen timestamp"
ZOTERO_LINKS = "content_sha256 string, zotero_item_key string, zotero_attachment_key string, status string, error_message string, linked_at timestamp"
INGEST_LOG = "log_id long, content_sha256 string, action string, source_path string, detail string, timestamp timestamp"
METADATA_SOURCES = "content_sha256 string, extractor_name string, title string, authors array<string>, year int, journal string, abstract string, raw_json string, extracted_at timestamp"
METADATA_RESOLVED = "content_sha256 string, title string, authors array<string>, year int, journal string, abstract string, doc_type string, resolution_method string, source_extractors array<string>, resolved_at timestamp"
DOCUMENTS = "doc_id string, source_path string, content_hash string, title string, authors array<string>, arxiv_id string, doi string, version int, status string, added_date timestamp, updated_date timestamp, project_id string, chunk_count int"
EXTRACTIONS = "extraction_id string, doc_id string, extractor_name string, extractor_version string, extraction_path string, content string, page_count int, status string, error_message string, extraction_date timestamp"
EMBEDDINGS = "embedding_id string, doc_id string, extraction_id string, embedder_name string, embedder_version string, vector_db_path string, chunk_count int, embedding_date timestamp, error_message string"
CHUNKS = "chunk_id string, doc_id string, chunk_index int, content string, section array<string>, page_numbers array<int>, has_equations boolean, display_eq_count int, inline_eq_count int, pdf_name string, project_id string, embedding array<float>"
TRIAGE_DECISIONS = "content_sha256 string, decision string, original_path string, original_filename string, file_size_bytes long, page_count int, decided_at timestamp, staged_path string"
DECISION_HISTORY = "id long, content_sha256 string, old_decision string, new_decision string, changed_at timestamp"

KEYS = {
    "canonical_files": ["content_sha256"], "source_sightings": ["content_sha256", "source_path", "machine_id"], "zotero_links": ["content_sha256"], "metadata_sources": ["content_sha256", "extractor_name"],
    "metadata_resolved": ["content_sha256"], "documents": ["doc_id"], "extractions": ["extraction_id"], "embeddings": ["embedding_id"], "chunks": ["doc_id", "chunk_index"], "triage_decisions": ["content_sha256"],
}
# States and their domains.
DOCUMENT_STATES = ["pending", "extracting", "extracted", "indexing", "indexed", "failed"]
LINK_STATES = ["pending", "imported", "pre-existing", "failed"]
DECISIONS = ["approved", "rejected"]
EMBEDDER_THRESHOLDS = {"chroma": 0.1, "ollama": 0.1, "specter2": 0.3}
