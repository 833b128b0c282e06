"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    max_chunk_chars: int = 1000
    max_content_chars: int = 10_000
    min_printable_share: float = 0.8
    hits: int = 10
    dims: int = 384
    cells: int = 100

    # Sizes of the work, free to tune: they change no result.
    store_buckets: int = 256
    files_per_wave: int = 100_000  # of the first wave; later ones grow up to the next
    largest_wave: int = 100_000
    messages_per_block: int = 8_192
    questions_per_block: int = 4_096
    vectors_per_tile: int = 4_096
    dictionary_slice: int = 2_000
    phrases_per_pass: int = 200_000


DEFAULTS = Settings()
