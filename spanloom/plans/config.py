"""Build parameters: defaults, deep-merged with a YAML file or a dict."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Dynamic:
    enabled: bool = True
    threshold_seconds: float = 4.5
    short_chunk_repeats: int = 3
    long_chunk_repeats: int = 5


@dataclass(frozen=True)
class Alignment:
    method: str = "hybrid"
    window_tokens: int = 4000
    elastic_gap: int = 10
    min_accept: float = 0.85
    warn_accept: float = 0.78
    token_ratio_cutoff: float = 92
    coverage_min: float = 0.80
    small_sentence_coverage_min: float = 0.67
    weight_token_sim: float = 0.50
    weight_coverage: float = 0.25
    weight_gap_penalty: float = 0.20
    weight_anchor_bonus: float = 0.08
    weight_bigram_bonus: float = 0.05
    fallback_expand_window: int = 1000
    fallback_elastic_gap: int = 18
    fallback_token_ratio: float = 88
    #: Sentences or words beyond which a document is aligned on many tasks; 0 for never.
    long_document: int = 50_000


@dataclass(frozen=True)
class External:
    """The external aligner."""

    temperature: float = 0.1
    max_workers: int = 5
    max_retries: int = 3
    retry_delay: float = 1.0
    timeout: float = 30
    max_tokens: int = 200
    #: Folder of replies that later builds read too; without it each build has its own.
    journal: str | None = None
    #: Of one executor.
    calls_per_second: float | None = None


@dataclass(frozen=True)
class Config:
    tempo: float = 0.92
    repeats: int = 3
    pause_ms: int = 10000
    inter_sentence_pause_ms: int | None = 10000
    pad_ms: int = 100
    fade_ms: int = 8
    sample_rate: int = 44100
    dynamic_repetitions: Dynamic = field(default_factory=Dynamic)
    alignment: Alignment = field(default_factory=Alignment)
    external: External = field(default_factory=External)

    @property
    def after_sentence_ms(self) -> int:
        return self.pause_ms if self.inter_sentence_pause_ms is None else self.inter_sentence_pause_ms


#: Accepted, with no effect: nothing ever reads them.
INERT = {"coverage_min", "small_sentence_coverage_min", "weights", "fallback", "timeout"}


def merge(base: Any, changes: dict) -> Any:
    """base with changes, section by section; unknown names are passed over, inert ones with a warning."""
    known = {f.name for f in fields(base)}
    new = {}
    for name, value in (changes or {}).items():
        if name in INERT:
            warnings.warn(f"{name} has no effect", stacklevel=2)
        if name in known:
            old = getattr(base, name)
            new[name] = merge(old, value) if is_dataclass(old) else value
    return replace(base, **new)


def load(path: str | None = None, **changes: Any) -> Config:
    """Defaults, a YAML file, then keyword changes."""
    config = Config()
    if path:
        import yaml

        with open(path, encoding="utf-8") as text:
            config = merge(config, yaml.safe_load(text) or {})
    return merge(config, changes)
