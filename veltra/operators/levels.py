"""Level sizes and the choice of what to compact, as functions of the bytes per level."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

# Fixed values of the store: levels, the size that the first sorted level aims at, and the growth between full levels.
LEVELS, BASE_BYTES, MULTIPLIER = 7, 64 << 20, 10
L0_FILES = 4


def targets(sizes: list[int], base: int = BASE_BYTES) -> list[float]:
    """Bytes that each level may hold: level 0 any number, level 1 base, and each further one a factor more, which is the
    LEVELS-th root of how often base goes into nine tenths of all bytes."""
    total = sum(sizes)
    factor = ((total - total // MULTIPLIER) / base) ** (1 / LEVELS)
    return [inf] + [round(base * factor**i) for i in range(len(sizes) - 1)]


@dataclass(frozen=True)
class Pick:
    level: int
    score: float
    into: int


def pick(sizes: list[int], l0_files: int, base: int = BASE_BYTES) -> Pick | None:
    """The level with the largest share of its size, if over 1. Level 0 goes by its number of files; the last stays."""
    scores = [(l0_files / L0_FILES, 0)] + [(size / max(1, goal), i) for i, (size, goal) in enumerate(zip(sizes, targets(sizes, base))) if 0 < i < len(sizes) - 1]
    score, level = max(scores)
    return Pick(level, score, level + 1) if score >= 1 else None
