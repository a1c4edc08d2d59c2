"""Thresholds and switches, passed to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Matching against reference corpora.
    accept_quran: float = 0.82
    quran_signal: float = 0.72
    accept_hadith: float = 0.85
    hadith_signal: float = 0.70
    hadith_match: bool = False
    candidates: int = 5
    prefer_margin: float = 8.0
    covered: float = 80.0
    # N-grams.
    ngram: int = 3
    ngram_fallback: int = 2
    fallback_max_words: int = 8
    unigram_max_words: int = 3
    # Glossary.
    glossary_dicts: tuple[str, ...] = ("terms",)
    term_df_max: float = 0.70
    term_min_words: int = 1
    phrase_max: int = 8
    # Review and audit.
    low_confidence: float = 0.3
    short_ratio: float = 0.40
    long_ratio: float = 3.0
    min_source_chars: int = 40
    min_source_words: int = 3
    dup_similarity: float = 0.55
    group_size: int = 20
    max_attempts: int = 3
    filter_batch: int = 40
    max_errors_per_row: int = 6
    #: Reference tables are broadcast up to so many rows, shuffled beyond.
    broadcast_rows: int = 200_000
