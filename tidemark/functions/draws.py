"""Repeatable random draws: a hash of seed, purpose and row identity, so a retried task draws the same."""

from __future__ import annotations

from collections.abc import Sequence


def hashed(seed: int, purpose: str, identity: Sequence[str]) -> str:
    return f"xxhash64({seed}L, '{purpose}', {', '.join(identity)})"


def draw(seed: int, purpose: str, identity: Sequence[str]) -> str:
    """Uniform double in [0, 1)."""
    return f"(shiftrightunsigned({hashed(seed, purpose, identity)}, 11) / {float(1 << 53)!r}D)"


def draw_int(low: int | str, high: int | str, seed: int, purpose: str, identity: Sequence[str]) -> str:
    """Uniform integer in [low, high], both included."""
    return f"int({low} + floor({draw(seed, purpose, identity)} * ({high} - ({low}) + 1)))"
