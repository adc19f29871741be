"""Which runs of a table that grows by runs are worth merging.

A merge takes runs of which none is larger than half of them all. So each row it
rewrites lands in a run at least twice the size of the one it came from, and a row
of a run of size s is rewritten at most log2(S / s) times until all runs together hold S.
"""

from __future__ import annotations

from collections.abc import Sequence


def due(sizes: Sequence[int], runs: int) -> list[int]:
    """Places of the runs to merge, in any order of age; none if fewer than ``runs`` are alike.

    With nothing due there are fewer than ``runs`` runs, or each one past the smallest
    ``runs - 1`` exceeds all smaller ones together, so their number is logarithmic.
    """
    order = sorted(range(len(sizes)), key=lambda place: sizes[place])
    return sorted(order[: _longest([sizes[place] for place in order], runs)])


def due_newest(sizes: Sequence[int], runs: int) -> int:
    """How many of the newest runs (the last ones) to merge; for runs whose order of age counts."""
    return _longest(list(sizes)[::-1], runs)


def _longest(sizes: list[int], runs: int) -> int:
    """Longest prefix of at least ``runs`` members that holds none above half of its sum."""
    total = largest = found = 0
    for count, size in enumerate(sizes, 1):
        total, largest = total + size, max(largest, size)
        if count >= max(runs, 2) and 2 * largest <= total:
            found = count
    return found
