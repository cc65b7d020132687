"""Schemas of the engine's tables, as DDL; ids are positive 32-bit integers, times are UTC."""

from __future__ import annotations

REPOSITORIES = "id int, name string, clone_url string, default_branch string, last_indexed_commit string, created_at timestamp, updated_at timestamp"
FILES = "id int, repository_id int, path string, language string, content_hash string, last_indexed_commit string, created_at timestamp, updated_at timestamp"
SYMBOLS = "id int, repository_id int, file_id int, name string, qualified_name string, kind string, start_line int, end_line int, code string, created_at timestamp"
SYNC_JOBS = "repository_id int, old_commit string, target_commit string, affected_paths array<string>, file_ids array<int>, stats map<string,int>"
GENERATIONS = "index_name string, index_uuid string, repository_id int, state string, created_at timestamp, published_at timestamp, inactive_at timestamp, deleted_at timestamp"
SYMBOL_DOCS = "symbol_id int, repository_id int, file_id int, repository string, language string, path string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string, embedding array<float>"
HITS = "score double, repository string, path string, language string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string"
CHANGES = "ordinal int, status string, old_path string, path string"

MAX_ID = 2**31 - 1


def positive_id(value: object) -> int:
    """An exact int of 1 to 2^31 - 1; booleans and anything else are refused."""
    if type(value) is not int or not 1 <= value <= MAX_ID:
        raise ValueError("an id is an integer from 1 to 2147483647")
    return value
