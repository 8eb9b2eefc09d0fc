"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    collection: str = "knowledge_base"
    num_shards: int = 4
    chunk_chars: int = 500
    child_words: int = 250
    context_words: int = 500
    default_k: int = 5
    alpha: float = 0.7
    max_upload_bytes: int = 50 * 1024 * 1024
    upload_types: tuple[str, ...] = ("pdf", "docx", "txt", "md", "csv", "xlsx", "html", "json")
    compress_tokens: int = 2000
    memory_ttl_seconds: int = 300
    ttl_seconds: int = 24 * 3600
    max_history: int = 10
    history_in_prompt: int = 3
    # Largest block of query vectors that is shipped to the scoring tasks.
    vector_block: int = 1024
    # Largest number of word queries that are scored for in one scan.
    query_block: int = 4096
    # Largest side that may be broadcast, in rows, after it was counted.
    broadcast_rows: int = 200_000
