"""Settings of the retrieval engine; every operator takes them as arguments with these defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 450
    chunk_overlap: int = 64
    min_section_words: int = 20
    min_window_words: int = 10
    min_chunk_words: int = 30
    min_alpha_share: float = 0.6
    min_section_chars: int = 50
    min_index_chars: int = 10
    embed_batch: int = 32
    fetch_factor: int = 8
    rrf_k: int = 60
    rerank_words: int = 200
    top_k: int = 5
    max_top_k: int = 20
    min_question_chars: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    qa_min_words: int = 80
    qa_cap: int = 2000
    qa_grounded: float = 0.6
    qa_synthesis: float = 0.2
    qa_context_chars: int = 500
    qa_pair_chars: int = 400
    max_tokens: int = 2048
    eval_share: float = 0.05
    seed: int = 42

    @classmethod
    def from_env(cls, prefix: str = "CORPUSLOOM_") -> Settings:
        """Defaults, overridden by environment variables such as CORPUSLOOM_TOP_K."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(prefix + f.name.upper())
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)


SETTINGS = Settings()

#: Sections that hold no content of the paper itself.
EXCLUDED_SECTIONS = ("references", "bibliography", "appendix", "acknowledgments", "acknowledgements")
