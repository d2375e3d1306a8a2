"""Row types of the engine's tables, as DDL."""

PAGE = "doc_id STRING, num INT, src STRING, tgt STRING, src_chars BIGINT"
PAIR = "id STRING, source STRING, target STRING, source_path STRING, target_path STRING, notes ARRAY<STRING>"
CLEAN = PAIR + (
    ", source_len INT, target_len INT, length_ratio DOUBLE, source_plain_len INT, target_plain_len INT, source_cjk_ratio DOUBLE, target_cjk_ratio DOUBLE,"
    " source_latin_ratio DOUBLE, target_latin_ratio DOUBLE, source_sha1 STRING, target_sha1 STRING, flags ARRAY<STRING>"
)
PARAGRAPH = "doc_id STRING, side STRING, idx INT, text STRING"
EMBEDDING = "doc_id STRING, side STRING, idx INT, vec ARRAY<FLOAT>, side_hash STRING, model STRING"
MOVE = "doc STRING, pos INT, type STRING, source_ids ARRAY<INT>, target_ids ARRAY<INT>, similarity DOUBLE"
MESSAGE = "STRUCT<role STRING, content STRING>"
CHAT = f"id STRING, task STRING, messages ARRAY<{MESSAGE}>"
TOKENISED = "id STRING, input_ids ARRAY<INT>, labels ARRAY<INT>, attention_mask ARRAY<INT>"
OUTCOME = "STRUCT<checked INT, preserved INT>"
ISSUE = "STRUCT<code STRING, detail STRING>"
