"""Table schemas (DDL) and checked string domains."""

# String domains of the data model.
FILE_STATUSES = ("pending", "processing", "completed", "failed")
CHUNK_STATUSES = ("pending", "indexed", "stale")
JOB_STATUSES = ("queued", "running", "completed", "failed", "cancelled")
BLOCK_KINDS = ("heading", "paragraph", "list", "code", "page_break")
ACTIVE_JOB_STATUSES = ("queued", "running")

BLOCK = (
    "struct<kind:string, text:string, "
    "metadata:struct<page:int, level:int, items:array<string>, ocr:boolean, source:string>>"
)
BLOCKS = f"array<{BLOCK}>"
CHUNK_META = (
    "struct<source:string, page_start:int, page_end:int, section_path:array<string>, block_start:int, "
    "block_end:int, has_ocr:boolean, layout_hint:string, page:int>"
)
SOURCES = "array<struct<filename:string, page_ranges:array<array<int>>>>"

FILES = (
    "file_id string, filename string, mime string, size_bytes bigint, hash string, stored_path string, "
    "is_encrypted boolean, status string, "
    "policy struct<pii:boolean,confidential:boolean,raw_large:boolean,ingest:boolean>, pages int, "
    "metadata map<string,string>, error_code string, error_message string, retry_count int, "
    "next_retry_at timestamp, created_at timestamp, updated_at timestamp, user_id string, chat_id string, "
    "tags array<string>, source string"
)
CHAT_FILES = "chat_id string, file_id string, created_at timestamp"
FILE_TEXT = f"file_id string, blocks {BLOCKS}, plain_text string, created_at timestamp, updated_at timestamp"
CHUNKS = (
    f"chunk_id string, file_id string, seq int, text string, metadata {CHUNK_META}, user_id string, "
    "chat_id string, source string, tags array<string>, created_at timestamp, embedding_model string, "
    "embedding_version int, index_status string"
)
MESSAGE_CONTENT = (
    "text string, attachments array<string>, "
    "selection struct<text:string, file_id:string, page:int>, focus_document_id string, "
    f"versions array<string>, activeVersionIndex int, versionSources array<{SOURCES}>"
)
EVAL_ROWS = (
    "id string, query string, relevant_doc_ids array<string>, retrieved_doc_ids array<string>, "
    "expected_snippet string, answer string, latency_ms double"
)
REQUEST_LOG = (
    "id string, timestamp string, endpoint string, stream boolean, status int, latency_ms bigint, "
    "prompt_tokens int, completion_tokens int, total_tokens int, finish_reason string, "
    "prompt_preview string, completion_preview string"
)
LIFECYCLE_EVENTS = (
    "ts timestamp, ord bigint, type string, name string, chat_id string, file_id string, "
    "filename string, status string"
)
