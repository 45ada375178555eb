"""Settings of the engine, with the defaults of the retrieval semantics."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    mu: float = 100.0  # Dirichlet smoothing
    top_candidates: int = 200
    top_k: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    max_tokens: int = 1024
    overlap_percent: int = 15
    min_results: int = 3
    min_score: float = -50.0
    insufficiency_threshold: float = 0.5
    web_results_limit: int = 5
    min_article_chars: int = 500
    user_agent: str = "MiCrawler/1.0"
    analyzer: str = "spanish"

    @property
    def overlap_tokens(self) -> int:
        return int(self.max_tokens * self.overlap_percent / 100)

    @staticmethod
    def from_env(prefix: str = "TAMIZ_") -> Settings:
        """Each field from ``<prefix><FIELD>`` where that variable is set."""
        found = {}
        for f in fields(Settings):
            value = os.environ.get(prefix + f.name.upper())
            if value is not None:
                found[f.name] = type(f.default)(value)
        return Settings(**found)
