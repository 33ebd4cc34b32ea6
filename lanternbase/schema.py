"""Schemas of the stored and returned tables."""

FILES = "path string, hash string, mtime double, size long"
CHUNKS = "id string, path string, start_line int, end_line int, model string, text string, embedding array<float>"
TURNS = "id long, session_id string, turn_index long, role string, content string, response_id string, ts double"
RESULTS = "query_id long, id string, path string, start_line int, end_line int, text string, score double, raw_score double, vector_score double, text_score double"
