"""The encoders that an index may be built for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    """dim of vectors; pieces a passage holds at most; prefixes; thresholds of the reader's and of the tool search."""

    id: str
    dim: int
    max_pieces: int
    query_prefix: str = ""
    passage_prefix: str = ""
    min_similarity: float = 0.6
    tool_min_similarity: float = 0.4
    storage: str = "f16"


MODELS = {
    m.id: m
    for m in (
        Model("lealla", 256, 126, min_similarity=0.60, tool_min_similarity=0.40, storage="json"),
        Model("e5-small", 384, 160, "query: ", "passage: ", 0.87, 0.84),
        Model("arctic-m-v2", 256, 160, "query: ", "", 0.58, 0.45),
        Model("hash64", 64, 160, min_similarity=0.2, tool_min_similarity=0.1),
    )
}
DEFAULT = "e5-small"
MAX_RESULTS = 200


def positive(value: float | None, default: float) -> float:
    """value if it is finite and above 0."""
    return value if isinstance(value, (int, float)) and 0 < value < float("inf") else default


def clamp(value: float | None, low: int, high: int, default: int) -> int:
    """value as a whole number between the bounds; default if it isn't finite."""
    if not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
        return default
    return int(max(low, min(high, value)))
