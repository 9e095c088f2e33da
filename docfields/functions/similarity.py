"""String similarity used by weak labelling."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer word for all of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # zero bits: rows where the subsequence grows
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (len(a) + len(b))."""
    size = len(a) + len(b)
    return 1.0 if size == 0 else 2.0 * lcs_length(a, b) / size
