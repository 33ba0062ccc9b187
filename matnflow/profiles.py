"""The two matching profiles: where they differ is a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    verse_exact: float
    verse_close: float
    report_exact: float
    report_close: float
    ruling_same: float
    semantic_floor: float = 0.55
    semantic_least: float = 0.88
    within_sura: bool = False  # whether a verse's window stays inside its sura
    semantic_always: bool = False  # whether vectors add candidates to every search


EXTENSION = Profile(verse_exact=0.97, verse_close=0.75, report_exact=0.99, report_close=0.72, ruling_same=0.65)
SERVICE = Profile(
    verse_exact=0.98, verse_close=0.80, report_exact=0.99, report_close=0.72, ruling_same=0.6, within_sura=True, semantic_always=True
)
VERSE_CANDIDATES, VERSE_LEAST = 15, 2
REPORT_CANDIDATES, REPORT_LEAST = 10, 3
MIN_LETTERS = 12
