"""Columns of the engine's tables."""

TABLES = {
    "chunks": "chunk_id long, content_hash string, content string, source_type string, source_uri string, chunk_index int, chunk_strategy string, created_at timestamp, metadata string",
    "chunk_vec": "space string, chunk_id long, embedding array<float>",
    "postings": "term string, chunk_id long, positions array<int>",
    "chunk_lengths": "chunk_id long, len int",
    "posting_blocks": "term string, shard long, n int, places binary, tfs binary, lens binary, ends binary, edge_tf binary, edge_len binary, edges binary",
    "index_totals": "n long, words long",
    "gone_chunks": "chunk_id long",
    "chunk_sessions": "chunk_id long, session_id string",
    "papers": "paper_id long, title string, authors array<string>, year int, venue string, doi string, bibtex string, abstract_chunk_id long, added_at timestamp",
    "sources": "source_uri string, file_hash string, ingested_at timestamp",
    "paper_paths": "paper_id long, path string, content_hash string, is_primary boolean, added_at timestamp",
    "relationships": "source_paper_id long, target_paper_id long, relation_type string, confidence double, evidence_chunk_id long, created_at timestamp",
    "conclusions": "id long, claim string, confidence double, source_chunk_ids array<long>, session_context string, created_at timestamp, superseded_by long",
    "methods": "id long, name string, paper_id long, description string, chunk_id long, source string",
    "datasets": "id long, name string, paper_id long, description string, chunk_id long, source string",
    "metrics": "id long, name string, value double, unit string, dataset_id long, method_id long, paper_id long, chunk_id long, source string",
    "entities": "id long, canonical_name string, entity_type string, paper_id long, description string, source string",
    "entity_mentions": "entity_id long, surface_form string, chunk_id long, confidence double",
    "folder_summaries": "folder_path string, summary string, content_hash string, embedding array<float>, updated_at timestamp",
    "embed_spaces": "name string, model string, provider string, dim int, chunk_strategy string, status string, element_type string, matryoshka_base_dim int, created_at timestamp",
    "config": "key string, value string",
    "prediction_errors": "id long, query string, query_hash string, top_score double, top_chunk_id long, error_type string, source_type_filter string, detected_at timestamp, resolved_at timestamp",
    "jobs": "id long, paper_id long, job_type string, params string, status string, progress string, result string, error string, created_at timestamp, started_at timestamp, completed_at timestamp",
}
JOB_TYPES = ("auto_relate", "extract_structure", "extract_figures")
