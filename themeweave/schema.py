"""Schemas of the logical tables."""

SCHEMAS: dict[str, str] = {
    "metadata": "filename string, technology string, year int",
    "documents": "source_file string, full_text string, blocks array<string>",
    "chunks": "chunk_id string, source_file string, chunk_index int, text string, word_count int, was_truncated boolean, chunking_method string, technology string, technology_meta string, year int",
    "extractions": "track string, chunk_id string, raw_phrases array<string>, retained_phrases array<string>, dropped_by_filter array<struct<phrase:string,tech_word:string>>, sentinel_returned boolean, error string",
    "phrases": "track string, phrase_id string, chunk_id string, phrase_idx int, phrase string, technology string, technology_meta string, year int, source_file string, cluster_id int",
    "embeddings": "track string, phrase_id string, embedding array<float>",
    "centroids": "track string, k int, cluster_id int, centroid array<double>",
    "soft_membership": "track string, phrase_id string, cluster_id int, similarity double",
    "cluster_entropy": "track string, cluster_id int, entropy_raw double, entropy_norm double, is_cross_cutting boolean",
    "cluster_tech_dist": "track string, cluster_id int, technology string, n bigint",
    "cluster_exemplars": "track string, cluster_id int, size bigint, entropy double, is_cross_cutting boolean, top_technologies map<string,bigint>, exemplars array<struct<phrase:string,technology:string,year:int,similarity:double>>",
    "cluster_labels": "track string, cluster_id int, label string, description string, key_terms array<string>, success boolean, error string",
    "lens_membership": "track string, lens string, lens_order int, description string, cluster_id int",
    "cluster_summary": "track string, cluster_id int, label string, size bigint, entropy double, type string",
    "yield_summary": "track string, total_chunks bigint, sentinel_empties bigint, filter_drops_chunks bigint, filter_drops_total bigint, error_chunks bigint, retained_phrases bigint",
}
