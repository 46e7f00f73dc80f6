"""Explicit schemas of the tables of an index; nothing is inferred from files."""

from __future__ import annotations

FILES = "filepath string, content string, sha string, mtime timestamp, length bigint"
CHUNKS = (
    "chunk_id string, text string, skeleton string, filepath string, filepath_lc string, symbol string, parent_symbol string, start_line int, end_line int, "
    "type string, doc_category string, language string, part int, parts int, ord bigint"
)
MANIFEST = "filepath string, sha string, mtime timestamp, ids array<string>, version string"  # version: where its chunks stand
# what a search filters and orders chunks by stands beside vectors and lengths, so that neither is joined with chunks
KEYS = "filepath_lc string, doc_category string, tie string"
VECTORS = f"chunk_id string, embedding array<float>, {KEYS}"
POSTINGS = "term string, chunk_id string, tf int, bucket int"
DOC_LEN = f"chunk_id string, dl bigint, {KEYS}"
TERM_STATS = "term string, df bigint, idf double"
TERM_COUNTS = "term string, df bigint"  # of a delta: less what its tombs take
TOMBS = "version string, chunk_id string"
META = "model string, chunker_version string, root string, built_at timestamp, chunk_count bigint, file_count bigint, avg_dl double, dl_total bigint, mean_idf double, size bigint, dead bigint, layout int, git_head string, git_heads map<string,string>"
COMMITS = "chunk_id string, filepath string, sha string, embedding array<float>"
SCAN = "filepath string, content string, sha string, mtime timestamp"  # content: of new and changed files
LAYOUT = 5  # of these tables; an index of another is built anew
TABLES = {"chunks": CHUNKS, "manifest": MANIFEST, "vectors": VECTORS, "postings": POSTINGS, "doc_len": DOC_LEN, "term_stats": TERM_STATS, "term_counts": TERM_COUNTS, "tombs": TOMBS, "meta": META, "scan": SCAN}
