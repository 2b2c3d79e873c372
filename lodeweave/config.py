"""Defaults that define results. Every operator takes these as parameters; an ``EngineConfig`` carries one set of them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from hashlib import sha256
from typing import Any

#: Fixed value: a sentence ends after . ! ? or an ellipsis and white space, before an upper-case letter or digit, with one opening mark between.
SENTENCE_REGEX = r"(?<=[.!?…])\s+(?=[«\"“(\[]?[A-ZÀ-Þ0-9])"


@dataclass(frozen=True)
class ChunkingOptions:
    """How documents become chunks; frozen, so that its checksum says whether stored chunks are still right."""

    target_tokens: int = 512
    max_tokens: int = 900
    min_tokens: int = 48
    overlap_tokens: int = 80
    hard_split_chars: int = 480
    bridge_segments: bool = True
    sentence_regex: str = SENTENCE_REGEX
    chars_per_token: float = 3.7
    normalizers: tuple[str, ...] = ("strip_control", "fix_ligatures", "dehyphenate", "collapse_whitespace")
    embed_context_header: bool = True
    context_header: str = ":document_title - :position_label"

    def checksum(self, model: str, dimensions: int) -> str:
        """Of the options, the embedding model and its width."""
        return sha256(json.dumps({"chunking": asdict(self), "model": model, "dimensions": dimensions}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def merged(self, overrides: dict[str, Any]) -> ChunkingOptions:
        """With the given values; a None leaves the default, and lists replace lists."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in overrides.items() if k in known and v is not None})


@dataclass(frozen=True)
class RetrievalOptions:
    """How a search ranks."""

    top_k: int = 8
    fetch_k: int = 60
    min_score: float = 0.25
    mmr: bool = True
    mmr_lambda: float = 0.6
    dedupe_threshold: float = 0.97
    neighbours: int = 0
    lexical: bool = True
    lexical_candidates: int = 100
    lexical_weight: float = 0.4
    rrf_k: int = 60
    expansion_weight: float = 0.7
    max_rewrites: int = 4
    rerank_candidates: int = 30
    rerank_chars: int = 1200
    max_terms: int = 8
    max_query_words: int = 32
    common_from: int = 1000
    common_share: float = 0.08
    language: str = "simple"


@dataclass(frozen=True)
class EngineConfig:
    """All settings of an engine."""

    chunking: ChunkingOptions = field(default_factory=ChunkingOptions)
    retrieval: RetrievalOptions = field(default_factory=RetrievalOptions)
    dimensions: int = 1536
    embedding_batch: int = 96
    embedding_model: str = "hashing"
    context_tokens: int = 6000
    fetch_chars: int = 24_000
    snippet_chars: int = 300


def merge_settings(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Maps merge key by key, lists and values replace, and a None leaves what is there."""
    out = dict(base)
    for k, v in over.items():
        if v is not None:
            out[k] = merge_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerce_setting(value: str | None, kind: str) -> Any:
    """A stored setting as its type says: int, float, bool, json or string."""
    if value is None:
        return None
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "json": json.loads}.get(kind, str)(value)
