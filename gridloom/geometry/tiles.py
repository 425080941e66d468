"""A space-filling order of cells: boxes of the plane become a few ranges of one key, which files and row groups can be pruned by.

A key interleaves the bits of a cell's column and row in a square of 2**BITS by 2**BITS bins over an extent (Z-order). A tile is the key's
leading bits: a square of bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 12
#: Boxes are taken apart down to squares of 2**(BITS - DEPTH) bins; at most some 2**DEPTH squares lie on the sides of a box.
DEPTH = 6


def _spread(v: Column) -> Column:
    """The bits of a number below 2**16 with a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


@dataclass(frozen=True)
class Tiling:
    """An extent and how many leading bits of each axis make a tile."""

    left: float
    bottom: float
    right: float
    top: float
    levels: int = 3

    def _bin(self, v: Column, low: float, high: float) -> Column:
        n = 1 << BITS
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) * (n / ((high - low) or 1.0))))).cast("long")

    def key(self, x: Column, y: Column) -> Column:
        return _spread(self._bin(x, self.left, self.right)).bitwiseOR(F.shiftleft(_spread(self._bin(y, self.bottom, self.top)), 1))

    def tile(self, key: Column) -> Column:
        return F.shiftright(key, 2 * (BITS - self.levels)).cast("int")

    def ranges(self, box: Sequence[float]) -> list[tuple[int, int]]:
        """Ranges of keys (both ends included) that hold every cell in the box, and as little else as the depth allows."""
        n = 1 << BITS
        span = lambda a, b, low, high: (max(0, min(n - 1, int((a - low) * n // ((high - low) or 1.0)))), max(0, min(n - 1, int((b - low) * n // ((high - low) or 1.0)))))
        (x0, x1), (y0, y1) = span(box[0], box[2], self.left, self.right), span(box[1], box[3], self.bottom, self.top)
        if box[0] > self.right or box[2] < self.left or box[1] > self.top or box[3] < self.bottom:
            return []
        out: list[tuple[int, int]] = []

        def visit(x: int, y: int, level: int, first: int) -> None:
            size = 1 << (BITS - level)
            if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
                return
            if level == DEPTH or (x0 <= x and x + size - 1 <= x1 and y0 <= y and y + size - 1 <= y1):
                last = first + size * size - 1
                if out and out[-1][1] == first - 1:
                    out[-1] = (out[-1][0], last)
                else:
                    out.append((first, last))
                return
            half = size // 2
            for i, (dx, dy) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
                visit(x + dx, y + dy, level + 1, first + i * half * half)

        visit(0, 0, 0, 0)
        return out

    def tiles_of(self, ranges: Sequence[tuple[int, int]]) -> list[int]:
        shift = 2 * (BITS - self.levels)
        return sorted({t for a, b in ranges for t in range(a >> shift, (b >> shift) + 1)})
