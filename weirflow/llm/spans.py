"""The textual form in which span detectors report what they found."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

Span = tuple[int, int, int]  # start, kind's place in the list of kinds, end


def render(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(spans))


def digest(text: str) -> str:
    """Lower-case hexadecimal SHA-256 of a text."""
    return hashlib.sha256(text.encode()).hexdigest()
