"""Fixed schemas, as DDL. Nothing is inferred."""

SPAN = "struct<char_start:bigint,char_end:bigint>"
CHUNK = "chunk_key string, text string, book_id string, group_id string, book_title string, author string, chapter string, chunk_index int, char_start bigint, char_end bigint, book_chars bigint, context string, vector array<float>"
GOLD = f"id string, question string, question_en string, answer string, book_id string, spans array<{SPAN}>, qtype string, chapters array<string>, note string, source string"
GOLD_CHAPTERS = "id string, question string, question_en string, relevant_chapters array<string>, answer string, note string"
GOLD_GLOBAL = f"id string, question string, question_en string, qtype string, book_id string, rubric array<string>, spans array<{SPAN}>, chapters array<string>, note string, source string"
EXTRACTION = "key string, book_id string, chunk_index int, chapter string, model string, entities array<struct<name:string,type:string,desc:string>>, relations array<struct<source:string,target:string,rel:string>>, error string, raw string, truncated boolean, ms bigint"
REPORT = "community_id string, level int, size int, title string, summary string, findings array<struct<summary:string,explanation:string>>, text string, entities array<string>, chunk_keys array<string>, book_title string, model string, prompt_chars bigint, raw_fallback boolean"
MODEL_INFO = "name string, family string, parameter_size string, parameter_count bigint, quantization string, context_length int, cutoff_date date, source string, updated_at timestamp_ntz"
GROUPS = "id bigint, slug string, name string, kind string, description string, created_at timestamp_ntz"
BOOKS = "id bigint, group_id bigint, book_key string, title string, author string, language string, n_chunks int, status string, file_hash string, created_at timestamp_ntz"
COLLECTIONS = "id bigint, slug string, name string, created_at timestamp_ntz"
MEMBERS = "id bigint, collection_id bigint, group_id bigint"
CONVERSATIONS = "id string, title string, group_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
MESSAGES = "id bigint, conversation_id string, role string, content string, model string, sources string, created_at timestamp_ntz"
QUERY_LOG = "id bigint, ts timestamp_ntz, model string, group_id string, question string, ttft_ms double, e2e_ms double, tps double, prompt_tokens bigint, completion_tokens bigint, n_sources int"
REQUEST = "concurrency int, ok boolean, ttft_s double, e2e_s double, completion_tokens bigint, tps double"
EVENT = "query_id string, seq bigint, ts timestamp, event string, payload string"


def names(schema: str) -> list[str]:
    """Column names of one of the flat schemas above."""
    return [c.split()[0] for c in schema.split(", ")]
