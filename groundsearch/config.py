"""Settings and their hashes. An index depends on three of them; results depend on all."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    embedding_model: str = "BAAI/bge-small-en-v1.5"
    dense_k: int = 20
    bm25_k: int = 20
    rrf_k: int = 60
    final_k: int = 8
    chunk_max_tokens: int = 480
    chunk_overlap_tokens: int = 64
    refusal_score_floor: float = 0.35
    #: What the model wants before a question, but not before a passage. A fixed value.
    query_prefix: str = "Represent this sentence for searching relevant passages: "

    @property
    def index_hash(self) -> str:
        """What an index is built with; settings of queries don't make it stale."""
        return _digest(self, "embedding_model", "chunk_max_tokens", "chunk_overlap_tokens")

    @property
    def config_hash(self) -> str:
        """What results depend on."""
        return _digest(self, "dense_k", "bm25_k", "rrf_k", "final_k", "refusal_score_floor", index=self.index_hash)


def _digest(settings: Settings, *names: str, **more: str) -> str:
    known = asdict(settings)
    return hashlib.sha256(json.dumps({n: known[n] for n in names} | more, sort_keys=True).encode()).hexdigest()[:16]
