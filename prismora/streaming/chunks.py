"""How many rows go into a chunk."""

from __future__ import annotations

CHUNK_BYTES = 64 << 20


def chunk_rows(width_in: int, width_out: int, itemsize: int = 8, budget: int = CHUNK_BYTES) -> int:
    """Rows of input and output together that fit the budget; one at least."""
    return max(1, budget // max(1, (width_in + width_out) * itemsize))
